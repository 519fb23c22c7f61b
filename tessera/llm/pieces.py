"""Sampled SentencePiece segmentations: forward filtering and backward sampling over the piece lattice.

A text gets a space in front, spaces become U+2581, and the vocabulary's pieces span the lattice. No piece has U+2581
after another character, so the lattice of a text is the chain of the lattices of its units (spaces and the word after
them), and sampling a unit at a time is sampling the text. Forward sums are computed once for each distinct unit of a
chunk, over all units together, character by character; then all occurrences are walked back together, each step drawing
the piece that ends at a position in proportion to (forward sum before it) times (its weight). The random number of a step
is a hash of the row's key, the unit's place in the text and the step, so a row's result depends on nothing else.

The model has merge ranks, no probabilities: a piece weighs 1 / (rank + 10), to the power `alpha`. A character without a
piece (and a U+2581 of the text itself) falls back to its UTF-8 bytes, so decoding is lossless for every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import load
from tessera.llm.words import U, _power_tables, mix, slices, text_bytes

SPACE, OWN_SPACE = 0x2581, 0x110000
#: Characters that are walked through together.
CHUNK = 1 << 19


class PieceLattice:
    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_at = model.piece_to_id("<0x00>")
        ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i) for i in ids]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece spans words")
        self.longest = max(map(len, pieces))
        points = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in pieces]
        keys = np.array([self._hashes(p, np.array([0]), np.array([len(p)]))[0] for p in points], U)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(ids, np.int32)[order]
        self.weight = (-alpha * np.log(self.ids - min(ids) + 10.0)).astype(np.float32)
        self.byte_weight = np.float32(-alpha * np.log(model.vocab_size() + 10.0))
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.keys >> U(42)] = True
        # What each id stands for, as bytes.
        out = [bytes([i - self.bytes_at]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.vocab_size())]
        self.sizes = np.array([len(x) for x in out])
        self.blob = np.frombuffer(b"".join(out), np.uint8)
        self.places = np.cumsum(self.sizes) - self.sizes

    @staticmethod
    def _hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        power, inverse = _power_tables(len(code) + 1)
        sums = np.concatenate([[U(0)], np.cumsum(mix(code.astype(U) + U(1)) * power[: len(code)])])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))

    def _lattice(self, code: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct units (longest first): cumulative chances and ids of the pieces that end at each node, by length - 1.

        Unit u has nodes base[u] to base[u] + size[u], one before each character and one at its end.
        """
        n, widest = len(code), self.longest
        power, inverse = _power_tables(n + 1)
        sums = np.concatenate([[U(0)], np.cumsum(mix(code.astype(U) + U(1)) * power[:n])])
        at = np.arange(n)
        unit = np.repeat(np.arange(len(size)), size)
        left = np.repeat(start + size, size) - at
        weight = np.full((n + len(size), widest), -np.inf, np.float32)
        ids = np.full((n + len(size), widest), -1, np.int32)
        for k in range(1, widest + 1):
            i = at[left >= k]
            if not len(i):
                break
            h = mix((sums[i + k] - sums[i]) * inverse[i] + U(k))
            likely = self.maybe[h >> U(42)]
            i, h = i[likely], h[likely]
            j = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[j] == h
            i, j = i[hit], j[hit]
            weight[i + k + unit[i], k - 1] = self.weight[j]
            ids[i + k + unit[i], k - 1] = self.ids[j]
            if k == 1:
                bare = np.ones(n, bool)
                bare[i] = False
                bare = np.flatnonzero(bare)
                weight[bare + 1 + unit[bare], 0] = self.byte_weight * _utf8_sizes(code[bare])
        base = start + np.arange(len(size))
        forward = np.full(n + len(size), -np.inf, np.float64)
        forward[base] = 0
        chance = np.zeros(weight.shape, np.float32)
        back = np.arange(1, widest + 1)
        for level in range(1, int(size[0]) + 1 if len(size) else 1):
            live = int(np.searchsorted(-size, -level, "right"))
            width = min(level, widest)
            node = base[:live] + level
            term = forward[node[:, None] - back[:width]] + weight[node, :width]
            top = term.max(1)
            p = np.exp(term - top[:, None])
            total = np.cumsum(p, 1)
            forward[node] = top + np.log(total[:, -1])
            chance[node, :width] = total / total[:, -1:]
            chance[node, width:] = 1
        return chance, ids, base

    def _walk(self, code: np.ndarray, starts: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all units in order, and how many each unit has. code: characters; starts: of units; key: of each unit."""
        ends = np.append(starts[1:], len(code))
        names = self._hashes(code, starts, ends)
        _, first, which = np.unique(names, return_index=True, return_inverse=True)
        order = np.argsort(-(ends - starts)[first], kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        first = first[order]
        which = place[which]
        size = (ends - starts)[first]
        start = np.cumsum(size) - size
        own = code[np.repeat(starts[first] - start, size) + np.arange(size.sum())]
        chance, ids, base = self._lattice(own, start, size)
        unit = np.arange(len(starts))
        begin = base[which]
        node = begin + size[which]
        got, steps, step = [], np.zeros(len(starts), np.int64), 0
        while len(unit):
            u = (mix(key[unit] + U(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U(40)).astype(np.float32) / np.float32(1 << 24)
            k = (chance[node] <= u[:, None]).sum(1)
            chosen = ids[node, k]
            # A byte fall-back is marked by its character for now.
            chosen = np.where(chosen >= 0, chosen, -1 - own[np.maximum(node - 1 - which[unit], 0)].astype(np.int64))
            got.append((unit, chosen))
            steps[unit] += 1
            node = node - k - 1
            more = node > begin[unit]
            unit, node, step = unit[more], node[more], step + 1
        offset = np.cumsum(steps) - steps
        flat = np.empty(int(steps.sum()), np.int64)
        for s, (unit, chosen) in enumerate(got):
            flat[offset[unit] + steps[unit] - 1 - s] = chosen
        marks = np.flatnonzero(flat < 0)
        if len(marks):
            wide = np.ones(len(flat), np.int64)
            raw = [_utf8(int(-1 - c)) for c in flat[marks]]
            wide[marks] = [len(r) for r in raw]
            owner = np.repeat(np.arange(len(steps)), steps)
            to = np.cumsum(wide) - wide
            out = np.repeat(flat, wide)
            for m, r in zip(marks, raw, strict=True):
                out[to[m] : to[m] + len(r)] = np.frombuffer(r, np.uint8).astype(np.int64) + self.bytes_at
            steps = np.bincount(owner, wide, len(steps)).astype(np.int64)
            flat = out
        return flat.astype(np.int32), steps

    def encode(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Sampled ids of each text; an empty text has none."""
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        sizes = np.array([len(p) + 1 if len(p) else 0 for p in points])
        code = np.empty(int(sizes.sum()), np.uint32)
        at = np.cumsum(sizes) - sizes
        for a, p in zip(at, points, strict=True):
            if len(p):
                code[a] = SPACE
                code[a + 1 : a + 1 + len(p)] = np.where(p == SPACE, OWN_SPACE, np.where(p == 32, SPACE, p))
        begin = np.zeros(len(code), bool)
        begin[1:] = (code[1:] == SPACE) & (code[:-1] != SPACE)
        begin[at[sizes > 0]] = True
        starts = np.flatnonzero(begin)
        bounds = np.searchsorted(starts, np.append(at, len(code)))
        counts = np.diff(bounds)
        place = np.arange(len(starts)) - np.repeat(bounds[:-1], counts)
        key = mix(np.repeat(keys, counts) + place.astype(U) * U(0xBF58476D1CE4E5B9))
        ids, steps, a = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + CHUNK)))
            low, high = starts[a], starts[b] if b < len(starts) else len(code)
            i, s = self._walk(code[low:high], starts[a:b] - low, key[a:b])
            ids.append(i)
            steps.append(s)
            a = b
        flat, total = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(steps))])
        return [flat[total[x] : total[y]] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's UTF-8 bytes."""
        n = self.sizes[ids]
        to = np.cumsum(n) - n
        raw = self.blob[np.repeat(self.places[ids] - to, n) + np.arange(n.sum())].tobytes()
        return raw[1:]


def _utf8(c: int) -> bytes:
    return chr(SPACE if c == OWN_SPACE else c).encode("utf-8", "surrogatepass")


def _utf8_sizes(code: np.ndarray) -> np.ndarray:
    size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    return np.where(code == OWN_SPACE, 3, size).astype(np.float32)


_lattices: dict[tuple[str, float], PieceLattice] = {}


def lattice(path: str, alpha: float) -> PieceLattice:
    """One lattice for each worker process, model and power."""
    if (path, alpha) not in _lattices:
        _lattices[path, alpha] = PieceLattice(path, alpha)
    return _lattices[path, alpha]


def sampled_pieces(docs: DataFrame, model: str, seed: int = 1, alpha: float = 1.0) -> DataFrame:
    """doc_id, n_pieces, piece_ids, n_bytes, lossless for each row of docs (doc_id, text).

    The sample is seeded by doc_id and seed (a null doc_id by the seed alone); rows that repeat both doc_id and text repeat
    the result. lossless says that decoding gave back every byte. Null and empty texts have no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model, alpha)
        for batch in slices(batches, most=2 << 20):
            data, off = text_bytes(batch.column("text"))
            texts = [t or "" for t in batch.column("text").to_pylist()]
            row = batch.column("doc_id").fill_null(-1).to_numpy().astype(np.int64).view(U)
            ids = own.encode(texts, mix(mix(row + U(seed)) + U(seed)))
            same = [own.decode(i) == data[a:b].tobytes() for i, a, b in zip(ids, off[:-1], off[1:], strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array(np.diff(off)), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "piece_ids", "n_bytes", "lossless"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pieces long, piece_ids array<int>, n_bytes long, lossless boolean")


def decoded(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text from doc_id and piece_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model, 1.0)
        for batch in batches:
            texts = [own.decode(np.array(x or [], np.int64)).decode("utf-8", "surrogatepass") for x in batch.column("piece_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "piece_ids").mapInArrow(run, "doc_id long, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_of(spark, sf_dir: str) -> DataFrame:
    return sampled_pieces(load(spark, sf_dir, "documents"), model_path())
