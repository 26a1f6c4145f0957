"""Words, hashes and shingles of many texts at once, with numpy inside Spark tasks.

A chunk holds some whole texts as one byte string. Words are runs of bytes that a 256-entry
table marks; every function works on the words of all texts of a chunk together.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text that a task works on at a time. Several arrays of eight bytes a word go with it, and workers keep what they once took.
CHUNK_BYTES = 1 << 20
LONG_WORD = 256

SPACES = bytes([0x20, *range(0x09, 0x0E)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def marks(separators: bytes) -> np.ndarray:
    """True for bytes that belong to a word."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


SPACED = marks(SPACES)
ALNUM = marks(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> _S)
    x = x * _B
    x ^= x >> _S
    x *= _B
    x ^= x >> _S
    return x


@dataclass
class Chunk:
    """Words of several texts: word ``i`` is ``data[start[i]:end[i]]``; text ``t`` owns words ``first[t]`` to ``first[t + 1]``."""

    data: bytes
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def words(self, text: int) -> list[bytes]:
        a, b = self.first[text], self.first[text + 1]
        return [self.data[s:e] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist())]


def cut(texts: Sequence[bytes | None], table: np.ndarray, lower: bool) -> Chunk:
    """The words of ``texts``; a null text has none."""
    sizes = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
    data = b"\n".join(t or b"" for t in texts)
    if lower:
        data = data.translate(LOWER)
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes + 1, out=bounds[1:])
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    np.take(table, np.frombuffer(data, dtype=np.uint8), out=inside[1:-1].view(bool))
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return Chunk(data, bounds, start, end, np.searchsorted(start, bounds))


def word_hashes(c: Chunk) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    n = len(c.start)
    out = np.zeros(n, dtype=np.uint64)
    if not n:
        return out
    padded = c.data + bytes(8)
    blocks = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    size = c.end - c.start
    keep = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
    out += size.astype(np.uint64) * _A
    at, left, where = c.start, size, slice(None)
    while True:
        out[where] = mix(out[where] * _A + (blocks[at] & keep[np.minimum(left, 8)]))
        more = np.flatnonzero((left > 8) & (left <= LONG_WORD) if isinstance(where, slice) else left > 8)
        if not len(more):
            break
        where = more if isinstance(where, slice) else where[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(c.data[c.start[i] : c.end[i]])
    return out


def shingle_hashes(c: Chunk, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k`` consecutive words, and the first word of each; a shingle stays inside its text."""
    n = len(words)
    if n < k:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    out = words[: n - k + 1].copy()
    for j in range(1, k):
        out = mix(out * _A + words[j : n - k + 1 + j])
    last = np.repeat(c.first[1:], c.counts)[: n - k + 1]
    at = np.flatnonzero(np.arange(k, n + 1) <= last)
    return out[at], at


def join_hashes(words: np.ndarray) -> np.ndarray:
    """The shingle hash of one whole sequence, as a one-element array."""
    out = words[:1].copy()
    for j in range(1, len(words)):
        out = mix(out * _A + words[j : j + 1])
    return out


def repeated(values: np.ndarray) -> np.ndarray:
    """True where a value stands more than once."""
    ordered = np.sort(values)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(values), dtype=bool)
    return member(values, twice)


def member(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """True where a value is in ``wanted``, sorted and without repeats; a bit table settles most of the others."""
    bits = 16
    while (1 << bits) < 16 * len(wanted) and bits < 24:
        bits += 1
    low = np.uint64((1 << bits) - 1)
    table = np.zeros(1 << bits, dtype=bool)
    table[wanted & low] = True
    maybe = np.flatnonzero(table[values & low])
    out = np.zeros(len(values), dtype=bool)
    if len(maybe) and len(wanted):
        at = np.minimum(np.searchsorted(wanted, values[maybe]), len(wanted) - 1)
        out[maybe] = wanted[at] == values[maybe]
    return out


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).to_pylist()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on for other tasks and stages, beside a JVM that has grown."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # a C library without it keeps what it has
        pass


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches whose texts have about ``limit`` bytes; one longer text stands alone."""
    for batch in batches:
        column = batch.column(text)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        at, size = 0, 0
        for i, n in enumerate(sizes):
            if i > at and size + n > limit:
                yield batch.slice(at, i - at), text_bytes(column.slice(at, i - at))
                at, size = i, 0
            size += n
        if at < len(sizes):
            yield batch.slice(at), text_bytes(column.slice(at))
        del column, batch
        give_back()


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; ``first`` as in ``Chunk``."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
