"""Benchmark passages inside documents, by a prefix-filtered join of word windows.

Every benchmark item is cut into windows of ``window`` consecutive words (an item with fewer words
is one window). A window is the set of its word shingles with their positions, and a document
holds it only if it holds all of them: at full containment the necessary prefix of a window is one
shingle, so each window is looked up by its rarest shingle, as counted over all documents. A hit
fixes where the window would start; the position must leave the whole window inside the document
(length and positional bounds), and then its words are compared one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemill.llm import words as w
from tidemill.llm.tables import checkpointed, keep_keys, with_document

#: Bytes of item text whose windows one task holds at a time; a larger benchmark goes in blocks.
BLOCK_BYTES = 8 << 20

SPANS = "array<struct<first:bigint,last:bigint>>"


@dataclass
class Windows:
    """Windows of a block of items: ``length`` words from ``start`` in ``words``, of item ``item``."""

    words: np.ndarray
    start: np.ndarray
    length: np.ndarray
    item: np.ndarray
    ids: list


def _windows(ids: list, texts: list[bytes], window: int) -> Windows:
    c = w.cut(texts, w.ALNUM, lower=True)
    start, length, item = [], [], []
    for i, (a, b) in enumerate(zip(c.first[:-1].tolist(), c.first[1:].tolist())):
        size = min(window, b - a)
        if size:
            at = np.arange(a, b - size + 1)
            start.append(at)
            length.append(np.full(len(at), size))
            item.append(np.full(len(at), i))
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64)
    return Windows(w.word_hashes(c), join(start), join(length), join(item), ids)


def _shingles(win: Windows, shingle: int) -> dict[int, list[tuple[np.ndarray, int, np.ndarray]]]:
    """By shingle size: (window numbers, offset in the window, hash) for every shingle of every window."""
    out: dict[int, list] = {}
    for size in np.unique(win.length).tolist():
        k = min(shingle, size)
        own = np.flatnonzero(win.length == size)
        for off in range(size - k + 1):
            h = win.words[win.start[own] + off].copy()
            for j in range(1, k):
                h = w.mix(h * w._A + win.words[win.start[own] + off + j])
            out.setdefault(k, []).append((own, off, h))
    return out


def _counts(docs: DataFrame, text: str, wanted: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each wanted shingle (sorted, by size) stands in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(x), dtype=np.int64) for k, x in wanted.items()}
        for _, texts in w.chunks(batches, "text"):
            c = w.cut(texts, w.ALNUM, lower=True)
            h = w.word_hashes(c)
            for k, keys in wanted.items():
                s = w.shingle_hashes(c, h, k)[0]
                s = s[w.member(s, keys)]
                total[k] += np.bincount(np.searchsorted(keys, s), minlength=len(keys))
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(wanted[k][at].view(np.int64)), pa.array(n[at])], names=["k", "h", "n"])

    rows = docs.select(docs[text].cast("string").alias("text")).mapInArrow(run, "k bigint, h bigint, n bigint")
    found = rows.groupBy("k", "h").agg(F.sum("n").alias("n")).toArrow()
    size, h, n = (found.column(x).to_numpy() for x in ("k", "h", "n"))
    out = {k: np.zeros(len(x), dtype=np.int64) for k, x in wanted.items()}
    for k, x in wanted.items():
        out[k][np.searchsorted(x, h[size == k].view(np.uint64))] = n[size == k]
    return out


@dataclass
class Keys:
    """The prefix shingle of each window: ``hash`` sorted, the window and the shingle's offset in it."""

    hash: np.ndarray
    window: np.ndarray
    offset: np.ndarray


def _prefixes(win: Windows, parts: dict[int, list], wanted: dict[int, np.ndarray], counts: dict[int, np.ndarray]) -> dict[int, Keys]:
    """The rarest shingle of each window, ties to the smaller hash, then to the first place."""
    out = {}
    for k, shingles in parts.items():
        rarest = np.full(len(win.start), np.iinfo(np.int64).max)
        key = np.zeros(len(win.start), dtype=np.uint64)
        offset = np.zeros(len(win.start), dtype=np.int64)
        for own, off, h in shingles:
            n = counts[k][np.searchsorted(wanted[k], h)]
            less = (n < rarest[own]) | ((n == rarest[own]) & (h < key[own]))
            at = own[less]
            rarest[at], key[at], offset[at] = n[less], h[less], off
        # A window with a shingle that no document has cannot occur.
        window = np.flatnonzero((rarest > 0) & (rarest < np.iinfo(np.int64).max))
        if len(window):
            window = window[np.argsort(key[window], kind="stable")]
            out[k] = Keys(key[window], window, offset[window])
    return out


def _find(c: w.Chunk, hashes: np.ndarray, win: Windows, keys: dict[int, Keys]) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window in a chunk."""
    firsts, found = [], []
    begin, finish = np.repeat(c.first[:-1], c.counts), np.repeat(c.first[1:], c.counts)
    for k, x in keys.items():
        s, at = w.shingle_hashes(c, hashes, k)
        hit = np.flatnonzero(w.member(s, np.unique(x.hash)))
        low, high = np.searchsorted(x.hash, s[hit], "left"), np.searchsorted(x.hash, s[hit], "right")
        n = high - low
        place = np.repeat(at[hit], n)
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, dtype=np.int64)
        window, first = x.window[entry], place - x.offset[entry]
        ok = np.flatnonzero((first >= begin[place]) & (first + win.length[window] <= finish[place]))
        window, first, offset = window[ok], first[ok], 0
        while len(window) and offset < win.length[window].max():
            inside = win.length[window] > offset
            same = ~inside
            same[inside] = hashes[first[inside] + offset] == win.words[win.start[window[inside]] + offset]
            window, first, offset = window[same], first[same], offset + 1
        firsts.append(first)
        found.append(window)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    return join(firsts), join(found)


def _one_block(df: DataFrame, win: Windows, keys: dict[int, Keys]) -> DataFrame:
    """Add the hits of one block to ``spans`` and ``items`` of every row."""
    spark = df.sparkSession
    held = spark.sparkContext.broadcast((vars(win), {k: vars(x) for k, x in keys.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win, keys = Windows(**held.value[0]), {k: Keys(**x) for k, x in held.value[1].items()}
        for part, texts in w.chunks(batches, "text"):
            c = w.cut(texts, w.ALNUM, lower=True)
            first, window = _find(c, w.word_hashes(c), win, keys)
            edge = np.zeros(len(c.start) + 1, dtype=np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + win.length[window], -1)
            hit = np.cumsum(edge)[:-1] > 0
            where = np.flatnonzero(hit)
            text_of = np.searchsorted(c.first, where, "right") - 1
            new = np.ones(len(where), dtype=bool)
            new[1:] = (where[1:] != where[:-1] + 1) | (text_of[1:] != text_of[:-1])
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(where)) - 1
            spans: dict[int, list] = {}
            for a, b in zip(heads.tolist(), tails.tolist()):
                t = int(text_of[a])
                base = int(c.first[t])
                spans.setdefault(t, []).append({"first": int(where[a]) - base, "last": int(where[b]) - base + 1})
            items: dict[int, set] = {}
            owner = np.searchsorted(c.first, first, "right") - 1
            for t, i in set(zip(owner.tolist(), win.item[window].tolist())):
                items.setdefault(t, set()).add(i)
            old_spans, old_items = part.column("spans").to_pylist(), part.column("items").to_pylist()
            merged = [_union(old_spans[t], spans[t]) if t in spans else old_spans[t] for t in range(len(texts))]
            named = [old_items[t] + [win.ids[i] for i in sorted(items.get(t, ()))] for t in range(len(texts))]
            columns = {x: part.column(x) for x in part.schema.names}
            columns["n_words"] = pa.array(c.counts.astype(np.int64))
            columns["spans"] = pa.array(merged, type=part.schema.field("spans").type)
            columns["items"] = pa.array(named, type=part.schema.field("items").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return df.mapInArrow(run, df.schema)


def _union(a: list[dict], b: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted([*a, *b], key=lambda x: (x["first"], x["last"])):
        if out and s["first"] <= out[-1]["last"]:
            out[-1]["last"] = max(out[-1]["last"], s["last"])
        else:
            out.append(dict(s))
    return out


def find_passages(
    docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, *, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: its id as ``doc_id``, ``n_words``, the word ranges ``spans`` that
    some window covers (disjoint, end excluded) and the ids ``items`` of the items with such a window.

    Items without an id, text or word are left out; a repeated item reports its id once per row of
    ``items``. Null or empty documents get no words and empty lists. Items are collected in blocks of
    about ``block_bytes`` of text, so no task or driver holds more of them, however many there are.
    """
    if window < 1 or shingle < 1:
        raise ValueError("window and shingle must be positive")
    items = items.select(items[item_id].alias("i"), items[item_text].cast("string").alias("x")).where("i is not null and x is not null").distinct()
    size = items.agg(F.sum(F.octet_length("x")).alias("n")).first().n or 0
    blocks = max(1, math.ceil(size / block_bytes))
    kind = items.schema["i"].dataType.simpleString()
    out = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"), F.lit(0).cast("bigint").alias("n_words"),
                      F.array().cast(SPANS).alias("spans"), F.array().cast(f"array<{kind}>").alias("items"))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "x"), F.lit(blocks)) == b).orderBy("i", "x").collect()
        win = _windows([r.i for r in rows], [r.x.encode() for r in rows], window)
        parts = _shingles(win, shingle)
        wanted = {k: np.unique(np.concatenate([h for _, _, h in x])) for k, x in parts.items()}
        keys = _prefixes(win, parts, wanted, _counts(docs, text, wanted) if wanted else {})
        out = _one_block(out, win, keys)
        if b + 1 < blocks:
            out = checkpointed(out)
    return out.drop("text")


def n_hit(spans: Column) -> Column:
    """Words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold a window of an item. Rows with one id go together; a row without an id goes by its text."""
    known = with_document(docs, options.pop("doc_id", "doc_id"), options.get("text", "text"))
    found = find_passages(known, items, doc_id="__document", **options).where(F.size("spans") > 0)
    found = checkpointed(found.select(F.col("doc_id").alias("__document")).distinct())
    return keep_keys(known, found, "__document", anti=True).select(*docs.columns)
