"""Token ids in wavelet-matrix files: tokenise, write succinct bit-planes, read them back.

A file holds the ids of a run of documents in ascending doc_id order: a header, one bit-plane for each bit of an id (from
the highest), rank samples every 512 bits, and the documents' ids and ends; the whole is deflated. Each level keeps, of
the ids in their order at that level, one bit, and sorts them stably by it for the next. `WaveletFile` supports access to
a position, the count of an id in a prefix (rank) and the n-th occurrence of an id (select) from the one file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import load, new_dir, running_offset, table
from tessera.llm.words import U, _power_tables, mix, slices

MAGIC, SAMPLE = b"WVM1", 512
#: Ids that close a file; a document is never split, so a very long one makes a longer file.
FILE_TOKENS = 2_000_000
#: Bytes of text that are encoded together.
TOGETHER = 1 << 20


def _narrow(bits: int) -> type:
    return np.uint16 if bits <= 16 else np.uint32


class WaveletFile:
    def __init__(self, n: int, bits: int, planes: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray):
        """planes: for each bit from the highest, n bits packed into bytes."""
        self.n, self.bits, self.planes, self.doc_ids, self.ends = n, bits, planes, doc_ids, ends
        ones = np.bitwise_count(planes).astype(np.uint32)
        pad = -ones.shape[1] % (SAMPLE // 8)
        blocks = np.pad(ones, ((0, 0), (0, pad))).reshape(bits, -1, SAMPLE // 8).sum(2)
        self.samples = np.concatenate([np.zeros((bits, 1), np.int64), np.cumsum(blocks, 1)], 1)
        self.zeros = n - self.samples[:, -1]

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray) -> WaveletFile:
        bits = max(1, int(ids.max(initial=0)).bit_length())
        planes = np.zeros((bits, -(-len(ids) // 8)), np.uint8)
        row = ids.astype(_narrow(bits))
        for level in range(bits):
            one = (row & row.dtype.type(1 << (bits - 1 - level))).astype(bool)
            planes[level] = np.packbits(one)
            row = np.concatenate([row[~one], row[one]])
        return cls(len(ids), bits, planes, doc_ids, ends)

    def to_bytes(self) -> bytes:
        body = b"".join([self.planes.tobytes(), self.samples.astype("<u8").tobytes(), self.doc_ids.astype("<i8").tobytes(), self.ends.astype("<i8").tobytes()])
        return MAGIC + struct.pack("<QIQ", self.n, self.bits, len(self.doc_ids)) + zlib.compress(body, 1)

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletFile:
        if raw[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        n, bits, docs = struct.unpack_from("<QIQ", raw, 4)
        body = zlib.decompress(raw[24:])
        width = -(-n // 8)
        planes = np.frombuffer(body, np.uint8, bits * width).reshape(bits, width)
        tail = np.frombuffer(body[len(body) - 16 * docs :], "<i8")
        return cls(n, bits, planes, tail[:docs], tail[docs:])

    def _ones(self, level: int, at: int) -> int:
        """Ones before position `at` of a plane: a rank sample and the bits since."""
        block = at // SAMPLE
        first = block * SAMPLE // 8
        count = int(self.samples[level, block]) + int(np.bitwise_count(self.planes[level, first : at // 8]).sum())
        return count + ((int(self.planes[level, at // 8]) >> (8 - at % 8)).bit_count() if at % 8 else 0)

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level, at // 8]) >> (7 - at % 8) & 1

    def access(self, at: int) -> int:
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, at), self._ones(level, at)
            value = value << 1 | bit
            at = int(self.zeros[level]) + ones if bit else at - ones
        return value

    def rank(self, value: int, at: int) -> int:
        """How often value occurs before position at."""
        low, high = 0, at
        if value >> self.bits:
            return 0
        for level in range(self.bits):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if value >> (self.bits - 1 - level) & 1 else (low - a, high - b)
        return high - low

    def select(self, value: int, k: int) -> int:
        """The position of the k-th occurrence (from 0) of value, -1 if there are fewer: a search over ranks."""
        if k >= self.rank(value, self.n):
            return -1
        low, high = 0, self.n - 1
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.rank(value, mid + 1) > k else (mid + 1, high)
        return low

    def ids(self) -> np.ndarray:
        """All ids in order: undo the stable sorts from the last level to the first."""
        row = np.zeros(self.n, _narrow(self.bits))
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n).astype(bool)
            before = np.empty_like(row)
            zeros = int(self.zeros[level])
            before[~one] = row[:zeros]
            before[one] = row[zeros:] | row.dtype.type(1 << (self.bits - 1 - level))
            row = before
        return row.astype(np.uint32)


class PieceCache:
    """Encodes whole texts with a byte-level BPE of the tokenizers library, and asks it once for each distinct piece.

    The library splits a text into pieces (a word with the space before it, a number, other signs, white space) and merges
    inside a piece only. Texts of Latin letters are split here by the same rule, over a whole batch, and each new
    distinct piece is encoded by the library; every other text goes to the library whole. A cache that is full is begun anew.
    """

    MOST = 1_000_000

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Classes of code points below 0x250: 0 other, 1 letter, 2 number, 3 white space.
        self.kind = np.array([1 if regex.match(r"\p{L}", chr(c)) else 2 if regex.match(r"\p{N}", chr(c)) else 3 if regex.match(r"\s", chr(c)) else 0 for c in range(0x250)], np.uint8)
        # The id of a line break, if this tokenizer takes it for a piece of its own before and after all kinds of others.
        probe = ["a", " b", "1", " 2", ".", " ,", "é", " ("]
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        lone = ids("\n")
        pairs = [(x, y) for x in probe for y in probe]
        self.line_break = lone[0] if len(lone) == 1 and all(ids(f"{x}\n{y}") == [*ids(x), *lone, *ids(y)] for x, y in pairs) else None
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pieces(self, pieces: list[str], white: np.ndarray) -> list[bytes]:
        """The ids of pieces, each for itself. Those that aren't white space are encoded in one text of lines: a line break is a piece
        of its own between them, and its id occurs in none of them."""
        out: list[bytes | None] = [None] * len(pieces)
        signs = np.flatnonzero(~white).tolist()
        if signs:
            ids = np.frombuffer(self.whole("\n".join([pieces[i] for i in signs])), "<u4")
            breaks = np.flatnonzero(ids == self.line_break) if self.line_break is not None else ids[:0]
            if len(breaks) == len(signs) - 1:
                raw, ends = ids.tobytes(), [*(breaks * 4).tolist(), len(ids) * 4]
                for i, a, b in zip(signs, [0, *(x + 4 for x in ends[:-1])], ends, strict=True):
                    out[i] = raw[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        fast, points = [], []
        for i, text in enumerate(texts):
            p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            # An apostrophe may begin a contraction, a piece by a rule of its own.
            if len(p) and p.max() < 0x250 and "'" not in text and not any(s in text for s in self.special):
                fast.append(i)
                points.append(p)
            else:
                out[i] = self.whole(text)
        if not fast:
            return out
        code = np.concatenate(points)
        begins = np.zeros(len(code) + 1, bool)
        begins[np.cumsum([0, *map(len, points)])] = True
        kind = self.kind[code]
        same = np.zeros(len(code), bool)
        same[1:] = (kind[1:] == kind[:-1]) & ~begins[1:-1]
        start = ~same
        # One plain space goes with the letters, numbers or signs after it; the last white space of a run stands alone before such a run.
        last_space = np.zeros(len(code), bool)
        last_space[:-1] = (kind[:-1] == 3) & (kind[1:] != 3) & ~begins[1:-1]
        start |= last_space
        joins = np.zeros(len(code), bool)
        joins[1:] = last_space[:-1] & (code[:-1] == 32)
        start &= ~joins
        at = np.flatnonzero(start)
        ends = np.append(at[1:], len(code))
        sums = np.concatenate([[U(0)], np.cumsum(mix(code.astype(U) + U(1)) * _power_tables(len(code))[0][: len(code)])])
        key = mix((sums[ends] - sums[at]) * _power_tables(len(code))[1][at] + (ends - at).astype(U))
        distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
        if len(self.known) > self.MOST:
            self.clear()
        keys = distinct.tolist()
        new = [j for j, k in enumerate(keys) if k not in self.known]
        text, where = code.tobytes().decode("utf-32-le", "surrogatepass"), first[new]
        pieces = [text[a:b] for a, b in zip(at[where].tolist(), ends[where].tolist(), strict=True)]
        white = kind[ends[where] - 1] == 3
        self.known.update(zip([keys[j] for j in new], self._pieces(pieces, white), strict=True))
        found = [self.known[k] for k in keys]
        sizes = np.array([len(x) for x in found]) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        from_ = np.cumsum(sizes) - sizes
        n = sizes[which]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(from_[which] - total[:-1], n) + np.arange(total[-1])]
        bounds = total[np.searchsorted(at, np.cumsum([0, *map(len, points)]))]
        for j, i in enumerate(fast):
            out[i] = ids[bounds[j] : bounds[j + 1]].tobytes()
        return out





_caches: dict[str, PieceCache] = {}


def encoder(path: str) -> PieceCache:
    """One cache for each worker process and tokenizer."""
    if path not in _caches:
        _caches[path] = PieceCache(path)
    return _caches[path]


def write_token_files(docs: DataFrame, tokenizer: str, root: str, end_id: int = 0, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the ids of docs (doc_id, text) into files under root and returns their manifest: part, file, docs, tokens.

    Rows are range-partitioned and sorted by doc_id (nulls first; rows that repeat an id by a hash of their text, so that one id is
    no hot task). A task rolls to a new
    file after file_tokens ids. A file is written under a temporary name and renamed to one that its place in the order
    gives, so a task that runs again replaces its own files; only what the manifest names counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        encode = encoder(tokenizer).encode
        ids, doc_ids, sizes, count, files = [], [], [], 0, []

        def roll() -> None:
            nonlocal ids, doc_ids, sizes, count
            flat = np.frombuffer(b"".join(ids), "<u4")
            w = WaveletFile.build(flat, np.array(doc_ids, np.int64), np.cumsum(np.array(sizes, np.int64)))
            name = f"{base}/part-{part:05d}-{len(files):05d}.wvm"
            with fs.open_output_stream(tmp := f"{name}.{uuid.uuid4().hex}.tmp") as f:
                f.write(w.to_bytes())
            fs.move(tmp, name)
            files.append((part, len(files), os.path.basename(name), len(doc_ids), len(flat)))
            ids, doc_ids, sizes, count = [], [], [], 0

        for batch in slices(batches, most=TOGETHER):
            known = batch.column("doc_id").is_valid().to_pylist()
            for d, ok, x in zip(batch.column("doc_id").fill_null(0).to_pylist(), known, encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                ids.append(x + struct.pack("<I", end_id))
                doc_ids.append(d if ok else -(2**63))
                sizes.append(len(x) // 4 + 1)
                count += sizes[-1]
                if count >= file_tokens:
                    roll()
        if doc_ids:
            roll()
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in files], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["part", "no", "file", "docs", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("hash", F.xxhash64("text")).repartitionByRange("doc_id", "hash")
    sorted_ = rows.sortWithinPartitions("doc_id", "hash", "text")
    return table(sorted_.mapInArrow(run, "part long, no long, file string, docs long, tokens long"), "manifest")


def read_token_files(manifest: DataFrame, root: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, and file for each document of the files."""
    blocks = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    parts = running_offset(blocks, "part", "tokens").select("part", F.col("before").alias("part_start"))
    inside = running_offset(manifest, "no", "tokens", ["part"])
    files = inside.join(parts, "part").select("file", (F.col("part_start") + F.col("before")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    w = WaveletFile.from_bytes(f.read())
                ids = w.ids().astype("<u4")
                starts = np.concatenate([[0], w.ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, w.ends, strict=True)]
                none = w.doc_ids == -(2**63)
                yield pa.RecordBatch.from_arrays([pa.array(w.doc_ids, pa.int64(), mask=none), pa.array(starts + start), pa.array(w.ends - starts), pa.array(crc, pa.int64()), pa.array([name] * len(crc))], ["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    return files.repartition(max(1, min(manifest.count(), 4096)), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def token_files(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Encodes all documents into files and reads them back. A null text has the end id alone."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    root = new_dir(spark, "tokens")
    return read_token_files(write_token_files(load(spark, sf_dir, "documents"), tokenizer, root), root)
