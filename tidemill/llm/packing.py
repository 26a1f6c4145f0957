"""Packing of token sequences into windows by minimum bin slack.

Documents longer than a window give full windows and a remainder. The remainders of a block are
packed window by window: the longest one opens the window, and a bitset of reachable sums over the
multiset of the remaining lengths finds the filling closest to the capacity; walking back through the
stored bitsets tells how many pieces of each length it takes. If no filling is exact, one more piece
is cut to close the gap. What is left at the end of a partition is cut at powers of two, which need no
padding. No window spans partitions, so nothing is shuffled, and a block bounds the memory.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemill.llm import words as w

BLOCK_TOKENS = 1 << 20
#: Distinct words that a Python worker remembers, before it starts anew.
CACHE_WORDS = 2_000_000
#: Text that a task packs at a time, and text that it encodes at a time.
PART_BYTES, TEXT_BYTES = 4 << 20, 1 << 20


#: How the tokenizer's own pattern cuts a lower-cased text of ASCII and Latin-1 letters; texts with other characters go to it whole.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-&(-/:-@\[-`{-~']+")
PLAIN = re.compile(r"[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
WORD_END = "</w>"


class WordTokens:
    """Ids of whole texts as little-endian 32-bit numbers, for a lower-casing tokenizer that never joins across white space.

    Each distinct word is cut into parts as the tokenizer would cut it, encoded once by the tokenizer and remembered by its hash;
    the ids of a text are gathered from those of its words. Many parts go to the tokenizer as one text; the last id of each
    part is known by its word end.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The parts are lower-cased, composed and cut already.
        self.cutter = Tokenizer(self.tokenizer.model)
        self.cutter.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        """No word is known. ``known`` holds sorted hashes, and ``start`` and ``size`` where each word's ids are in ``ids``."""
        self.known = np.zeros(0, dtype=np.uint64)
        self.start, self.size = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint32)
        self.ids = np.zeros(0, dtype="<u4")

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        """Where sorted ``hashes`` are known, -1 for unknown ones."""
        at = np.searchsorted(self.known, hashes)
        found = np.flatnonzero(at < len(self.known))
        out = np.full(len(hashes), -1, dtype=np.int64)
        found = found[self.known[at[found]] == hashes[found]]
        out[found] = at[found]
        return out

    def _remember(self, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Add sorted unknown ``hashes`` with their ids, one after the other."""
        at = np.searchsorted(self.known, hashes)
        start = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, ids])
        self.known, self.start, self.size = np.insert(self.known, at, hashes), np.insert(self.start, at, start), np.insert(self.size, at, size)

    def _learn_parts(self, parts: list[str]) -> np.ndarray:
        """The hashes of distinct parts; those not known yet go to the tokenizer."""
        c = w.cut([" ".join(parts).encode()], w.SPACED, lower=False)
        hashes = w.word_hashes(c)
        order = np.argsort(hashes)
        order = order[self._place(hashes[order]) < 0]
        found, size = [], []
        for at in range(0, len(order), 20_000):
            own = [parts[i] for i in order[at : at + 20_000].tolist()]
            ids = np.array(self.cutter.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(own):
                raise RuntimeError("the tokenizer joins or splits parts")
            found.append(ids)
            size.append(np.diff(ends, prepend=0))
        if found:
            self._remember(hashes[order], np.concatenate(found), np.concatenate(size))
        return hashes

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known words one after the other, and the end of each."""
        size = self.size[at].astype(np.int64)
        upto = np.zeros(len(at) + 1, dtype=np.int64)
        np.cumsum(size, out=upto[1:])
        return self.ids[np.repeat(self.start[at] - upto[:-1], size) + np.arange(upto[-1])], upto

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Cut sorted unknown words into parts, of which only distinct new ones are encoded."""
        cut = [PARTS.findall(x.decode().lower()) for x in words]
        numbers: dict[str, int] = {}
        flat = np.fromiter((numbers.setdefault(x, len(numbers)) for c in cut for x in c), dtype=np.int64)
        part_hashes = self._learn_parts(list(numbers))
        # A word of one part may be known by now.
        new = self._place(hashes) < 0
        per_word = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        at = np.searchsorted(self.known, part_hashes)[flat[np.repeat(new, per_word)]]
        ids, upto = self._gather(at)
        last = np.cumsum(per_word[new])
        self._remember(hashes[new], ids, upto[last] - upto[last - per_word[new]])

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        c = w.cut(texts, w.SPACED, lower=True)
        hashes, first, word = np.unique(w.word_hashes(c), return_index=True, return_inverse=True)
        if len(self.known) + len(hashes) > CACHE_WORDS:
            self.forget()
        new = np.flatnonzero(self._place(hashes) < 0)
        if len(new):
            self._learn(hashes[new], [c.data[c.start[i] : c.end[i]] for i in first[new].tolist()])
        ids, upto = self._gather(np.searchsorted(self.known, hashes)[word])
        data = ids.tobytes()
        ends = (upto[c.first] * 4).tolist()
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text; about ``TEXT_BYTES`` of them are worked on at a time."""
        out, at, size = [], 0, 0
        for i, t in enumerate(texts):
            n = len(t or b"")
            if i > at and size + n > TEXT_BYTES:
                out += self._encode(texts[at:i])
                at, size = i, 0
            size += n
        return out + self._encode(texts[at:])

    def _encode(self, texts: list[bytes | None]) -> list[bytes]:
        plain, whole = [], {}
        for i, t in enumerate(texts):
            text = t.decode() if t else ""
            if PLAIN.fullmatch(text) and "<|" not in text:
                plain.append(t or b"")
            else:
                whole[i] = text
                plain.append(b"")
        out = self._plain(plain) if plain else []
        found = self.tokenizer.encode_batch_fast(list(whole.values()), add_special_tokens=False) if whole else []
        for i, e in zip(whole, found):
            out[i] = np.array(e.ids, dtype="<u4").tobytes()
        return out


_MADE: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The encoder of this Python worker, with the words that earlier tasks have taught it."""
    if path not in _MADE:
        _MADE[path] = WordTokens(path)
    return _MADE[path]


@dataclass
class Piece:
    doc: int
    start: int
    length: int


@dataclass
class Pool:
    """Pieces by length; ``lengths`` holds the distinct ones in rising order."""

    by_length: dict[int, list[Piece]] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)
    total: int = 0

    def add(self, piece: Piece) -> None:
        if not self.by_length.get(piece.length):
            self.by_length[piece.length] = []
            insort(self.lengths, piece.length)
        self.by_length[piece.length].append(piece)
        self.total += piece.length

    def take(self, length: int) -> Piece:
        own = self.by_length[length]
        piece = own.pop()
        if not own:
            self.lengths.pop(bisect_left(self.lengths, length))
        self.total -= length
        return piece


def filling(lengths: list[int], count: dict[int, int], target: int) -> list[tuple[int, int]]:
    """(length, how many) of a multiset whose sum is the closest to ``target`` from below.

    ``lengths`` rise. Bit ``s`` of the bitset says that the sum ``s`` is reachable; multiplicities
    enter as 1, 2, 4, ... copies at once. The search ends as soon as ``target`` is reachable.
    """
    mask = (1 << (target + 1)) - 1
    reach, trail = 1, []
    for i in range(bisect_right(lengths, target) - 1, -1, -1):
        length = lengths[i]
        left, copies = min(count[length], target // length), 1
        while left:
            n = min(copies, left)
            trail.append((reach, length, n))
            reach |= (reach << (length * n)) & mask
            left -= n
            copies *= 2
            if reach >> target & 1:
                break
        if reach >> target & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for before, length, n in reversed(trail):
        if not before >> at & 1:
            at -= length * n
            taken[length] = taken.get(length, 0) + n
    return list(taken.items())


def pack_pool(pool: Pool, capacity: int, last: bool) -> list[list[Piece]]:
    """Full windows from the pool; with ``last`` also its rest, in sequences whose lengths are powers of two."""
    out = []
    while pool.total >= capacity:
        window = [pool.take(pool.lengths[-1])]
        target = capacity - window[0].length
        if target:
            counts = {x: len(pool.by_length[x]) for x in pool.lengths}
            for length, n in filling(pool.lengths, counts, target):
                window += [pool.take(length) for _ in range(n)]
        gap = capacity - sum(p.length for p in window)
        while gap:
            piece = pool.take(pool.lengths[-1])
            head = min(gap, piece.length)
            window.append(Piece(piece.doc, piece.start, head))
            if head < piece.length:
                pool.add(Piece(piece.doc, piece.start + head, piece.length - head))
            gap -= head
        out.append(window)
    if last:
        while pool.total:
            size = 1 << (pool.total.bit_length() - 1)
            window = []
            while size:
                piece = pool.take(pool.lengths[-1])
                head = min(size, piece.length)
                window.append(Piece(piece.doc, piece.start, head))
                if head < piece.length:
                    pool.add(Piece(piece.doc, piece.start + head, piece.length - head))
                size -= head
            out.append(window)
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, *, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids`` (little-endian 32-bit numbers),
    ``doc_tokens``, ``sequence_id`` and ``offset``.

    A document is the ids of its whole text and then ``end_id``, so null and empty texts have one id.
    Every id is in exactly one piece. Sequences have ``capacity`` ids, except for a few at the end of
    each partition whose lengths are powers of two. Repeated rows are packed once each.
    """
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        pool, ids, names, held = Pool(), {}, {}, 0
        schema = None

        def flush(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for window in windows:
                offset = 0
                for p in window:
                    own = ids[p.doc]
                    values = (names[p.doc], p.start, p.length, own[4 * p.start : 4 * (p.start + p.length)], len(own) // 4, sequence, offset)
                    for c, v in zip(cols, values):
                        c.append(v)
                    offset += p.length
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, schema.types)], schema=schema)

        number = 0
        for part, texts in w.chunks(batches, "text", PART_BYTES):
            if schema is None:
                long = pa.int64()
                schema = pa.schema([("doc_id", part.schema.field("doc_id").type), ("start", long), ("length", long), ("ids", pa.binary()), ("doc_tokens", long), ("sequence_id", long), ("offset", long)])
            whole = []
            for name, own in zip(part.column("doc_id").to_pylist(), tokens.encode(texts)):
                own += end
                ids[number], names[number] = own, name
                n = len(own) // 4
                full = n - n % capacity
                whole += [[Piece(number, a, capacity)] for a in range(0, full, capacity)]
                if n > full:
                    pool.add(Piece(number, full, n - full))
                held += n
                number += 1
            if whole:
                yield flush(whole)
            if held > block_tokens:
                yield flush(pack_pool(pool, capacity, False))
                left = {p.doc for own in pool.by_length.values() for p in own}
                ids, names = {d: ids[d] for d in left}, {d: names[d] for d in left}
                held = 0
        if schema is not None:
            yield flush(pack_pool(pool, capacity, True))

    return source.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
