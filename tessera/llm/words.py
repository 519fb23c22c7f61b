"""Hashes of the words and shingles of whole Arrow batches, in numpy over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_CHUNK = 1 << 18
_powers: list[np.ndarray] = []

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators: white space alone, or every ASCII character but letters and digits.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _CHUNK + 4096)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, base, dtype=U)
            t[0] = 1
            _powers.append(np.cumprod(t))
    return _powers


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about `most` bytes of text each, so that memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts together, and where each begins (and the last ends). A null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_hashes(data: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, in order, and where each text's words begin (and the last's end).

    A word is a run of bytes that aren't separators, lower-cased (A-Z). Its hash is a polynomial in its bytes modulo
    2**64, from prefix sums, and mixed; the bytes are taken in runs that end between words.
    """
    n = len(data)
    inside = ~sep[data]
    begins = np.zeros(n + 1, dtype=bool)
    begins[off[:-1]] = True
    hashes, starts, at = [], [], 0
    while at < n:
        to = min(at + _CHUNK, n)
        while to < n and inside[to - 1] and inside[to] and not begins[to]:
            ahead = np.flatnonzero(~inside[to : to + 4096] | begins[to : to + 4096][: n - to])
            to += int(ahead[0]) if len(ahead) else min(4096, n - to)
        w, b = inside[at:to], begins[at:to]
        follows = np.zeros(to - at, dtype=bool)
        follows[1:] = w[1:] & w[:-1] & ~b[1:]
        first = np.flatnonzero(w & ~follows)
        more = np.zeros(to - at, dtype=bool)
        more[:-1] = follows[1:]
        last = np.flatnonzero(w & ~more)
        power, inverse = _power_tables(to - at)
        terms = (LOWER[data[at:to]].astype(U) + U(1)) * power[: to - at]
        sums = np.cumsum(terms)
        h = (sums[last] - sums[first] + terms[first]) * inverse[first]
        hashes.append(mix(h ^ ((last - first + 1).astype(U) * U(0xD6E8FEB86659FD93))))
        starts.append(first + at)
        at = to
    if not hashes:
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), off)


_TURN = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=U)


def shingle_hashes(words: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of k words, and where each text's begin; a text of fewer words has one, of all of them."""
    n, counts = len(words), np.diff(off)
    left = np.repeat(off[1:], counts) - np.arange(n)
    h = np.zeros(n, dtype=U)
    for j in range(k):
        h[: n - j] += words[j:] * _TURN[j]
    h = mix(h)
    whole = left >= k
    short = np.flatnonzero((counts > 0) & (counts < k))
    for d in short:
        i = off[d]
        h[i] = mix(np.array([(words[i : off[d + 1]] * _TURN[: counts[d]]).sum() + U(0x51ED27) * U(counts[d])], dtype=U))[0]
        whole[i] = True
    kept = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    return h[whole], np.concatenate([[0], np.cumsum(kept)])
