"""Periodic runs in texts, from a Re-Pair grammar of the word ids.

A run is a stretch of words with smallest period ``q`` that no neighbour extends, of at least ``max(least, times * q)``
words. Re-Pair replaces the most frequent pair of symbols by a new nonterminal until no pair stands twice; the sequence
that is left becomes a balanced tree. Every run crosses the boundary of the lowest node that contains it. So each
nonterminal is looked at once, where it first stands: periods come from the word pairs beside its boundary, and the run
grows to both sides as far as words agree. Its runs then hold at all places of its derivation; those of one period
that overlap by a period are merged into the maximal one.

Only stretches that can hold a run reach the grammar: with ``times`` of 4, each three words of a run stand there three
times or more, and at most a quarter of the stretch apart. Texts are worked on whole, one at a time, inside their Spark task.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm import words as w

#: Least words of a run, and least multiple of its period.
LEAST, TIMES = 6, 4
#: Words that stand together wherever a run has them, and how often.
GRAM, AGAIN = 3, 3
#: Longest grams that tell periods apart before words are compared.
LONGEST_GRAM = 64


def re_pair(ids: list[int]) -> tuple[list[tuple[int, int, list[int]]], list[tuple[int, int]]]:
    """The grammar of a sequence: (length of the left side, length, starts of all occurrences) of each nonterminal,
    and (start, length) of each symbol in the sequence that is left."""
    n = len(ids)
    symbol, size = list(ids), [1] * n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i in range(n - 1):
        places[symbol[i], symbol[i + 1]].append(i)
    heap = [(-len(at), pair) for pair, at in places.items() if len(at) > 1]
    heapq.heapify(heap)
    fresh, rules = max(ids, default=0) + 1, []
    while heap:
        count, pair = heapq.heappop(heap)
        at = places.get(pair)
        if at is None:
            continue
        a, b = pair
        valid, past = [], -1
        for i in sorted(set(at)):
            if i >= past and symbol[i] == a and (j := after[i]) < n and symbol[j] == b:
                valid.append(i)
                past = j + 1
        if len(valid) < -count:
            # Neighbours were replaced since: it takes its turn later, or never.
            if len(valid) > 1:
                places[pair] = valid
                heapq.heappush(heap, (-len(valid), pair))
            else:
                del places[pair]
            continue
        del places[pair]
        made: set[tuple[int, int]] = set()
        left = size[valid[0]]
        for i in valid:
            j = after[i]
            k = after[j]
            symbol[i], symbol[j], after[i] = fresh, -1, k
            size[i] += size[j]
            if k < n:
                before[k] = i
                new = (fresh, symbol[k])
                places[new].append(i)
                made.add(new)
            h = before[i]
            if h >= 0:
                new = (symbol[h], fresh)
                places[new].append(h)
                made.add(new)
        for new in made:
            if len(places[new]) > 1:
                heapq.heappush(heap, (-len(places[new]), new))
        rules.append((left, size[valid[0]], valid))
        fresh += 1
    rest, i = [], 0
    while i < n:
        rest.append((i, size[i]))
        i = after[i]
    return rules, rest


def tree(rest: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """The inner nodes of a balanced tree over the symbols that are left, in the form of ``re_pair``'s rules."""
    starts = [s for s, _ in rest] + [sum(rest[-1])] if rest else []
    stack = [(0, len(rest))] if len(rest) > 1 else []
    while stack:
        a, b = stack.pop()
        m = (a + b) // 2
        yield starts[m] - starts[a], starts[b] - starts[a], [starts[a]]
        stack += [(x, y) for x, y in ((a, m), (m, b)) if y - x > 1]


def _agree(ids: np.ndarray, i: int, j: int, most: int, step: int) -> int:
    """How many words from ``i`` and ``j`` on (backwards for ``step`` -1) are equal, ``most`` at most."""
    done, width = 0, 32
    while done < most:
        k = min(width, most - done)
        if step > 0:
            off = ids[i + done : i + done + k] != ids[j + done : j + done + k]
        else:
            off = (ids[i - done - k + 1 : i - done + 1] != ids[j - done - k + 1 : j - done + 1])[::-1]
        at = int(off.argmax())
        if off[at]:
            return done + at
        done, width = done + k, width * 4
    return most


def gram_ids(dense: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(length, ids) of the grams of 2, 4, 8, ... words from each position on; those beyond the end are unlike all others."""
    n, length, ids, out = len(dense), 1, dense.astype(np.int64), []
    while length < LONGEST_GRAM and (not out or 4 * length <= n):
        both = np.arange(-n, 0, dtype=np.int64)
        both[: n - length] = ids[: n - length] * (n + 1) + ids[length:] if length < n else 0
        ids = np.where(both < 0, both, np.unique(both, return_inverse=True)[1]) if n else both
        length *= 2
        out.append((length, ids))
    return out


def _periods(grams: list[tuple[int, np.ndarray]], at: int, step: int, reach: int) -> list[int]:
    """Periods up to ``reach`` for which the words from ``at`` on (backwards: up to it) recur, as far as the grams tell.

    With two periods on that side the first ``q`` words recur, so any gram of up to ``q`` words does (for ``q`` of 1: of 2).
    """
    out: list[int] = []
    for i, (length, ids) in enumerate(grams):
        low = length if i else 1
        high = min(reach, 2 * length - 1) if i + 1 < len(grams) else reach
        if low > high:
            break
        if step > 0:
            own = ids[at + low : at + high + 1]
            first = ids[at]
        else:
            at_gram = at - length + 1
            if at_gram < 0:
                break
            own = ids[max(at_gram - high, 0) : max(at_gram - low + 1, 0)][::-1]
            first = ids[at_gram]
        out += (np.flatnonzero(own == first) + low).tolist()
    return out


def crossing(ids: np.ndarray, grams: list[tuple[int, np.ndarray]], start: int, middle: int, end: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs of ``ids[start:end]`` that have words on both sides of ``middle``.

    A run long enough has two periods, and ``least / 2`` words, on one side.
    """
    found: dict[tuple[int, int], int] = {}
    for side in (1, -1):
        reach = (end - middle if side > 0 else middle - start) // (times // 2)
        known: list[tuple[int, int]] = []
        for q in _periods(grams, middle if side > 0 else middle - 1, side, reach):
            # A multiple of a period that holds for so far gives the same run, or none.
            if any(q % p == 0 and q <= far for p, far in known):
                continue
            low, high = (middle, middle + q) if side > 0 else (middle - q, middle)
            s = low - _agree(ids, low - 1, high - 1, low - start, -1)
            e = high + _agree(ids, low, high, end - high, 1)
            if s < middle < e and e - s >= q:
                known.append((q, e - middle if side > 0 else middle - s))
                if e - s >= max(least, times * q):
                    found[s, e] = min(q, found.get((s, e), q))
    return [(s, e, q) for (s, e), q in found.items()]


def maximal(pieces: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the intervals of each period after merging those that overlap by it, in order."""
    runs: dict[tuple[int, int], int] = {}
    for q in sorted(pieces):
        last = None
        for s, e in sorted(set(pieces[q])):
            if last and last[1] - s >= q:
                last = (last[0], max(last[1], e))
                continue
            if last:
                runs.setdefault(last, q)
            last = (s, e)
        if last:
            runs.setdefault(last, q)
    return sorted((s, e - s, q) for (s, e), q in runs.items())


def stretch_runs(ids: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one sequence of ids, by its grammar."""
    _, dense = np.unique(ids, return_inverse=True)
    n = len(dense)
    grams = gram_ids(dense)
    pairs = grams[0][1]
    # Where the pair at a position stands next, and where it stood before.
    order = np.argsort(pairs, kind="stable")
    same = pairs[order[1:]] == pairs[order[:-1]]
    following, previous = np.full(n, 2 * n), np.full(n, -n)
    following[order[:-1][same]], previous[order[1:][same]] = order[1:][same], order[:-1][same]
    following, previous = following.tolist(), previous.tolist()
    rules, rest = re_pair(dense.tolist())
    pieces: dict[int, list[tuple[int, int]]] = defaultdict(list)
    half = times // 2
    for left, size, places in (*rules, *tree(rest)):
        if size < least:
            continue
        start = places[0]
        middle, end = start + left, start + size
        ahead = following[middle] - middle <= (size - left) // half if middle < n - 1 else False
        back = left > 1 and middle - 2 - previous[middle - 2] <= left // half
        if ahead or back:
            for s, e, q in crossing(dense, grams, start, middle, end, least, times):
                pieces[q] += [(s - start + at, e - start + at) for at in places]
    return maximal(pieces)


def _stretches(c: w.Chunk, hashes: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int]]:
    """(first, past the last) word of the stretches that can hold runs."""
    grams, at = w.shingle_hashes(c, hashes, GRAM)
    if not len(at):
        return
    own = w.mix(grams + c.owner[at].astype(np.uint64) * w._B)
    keep = np.arange(len(at))
    for _ in range(3):
        order = np.argsort(own[keep], kind="stable")
        ranked, place = own[keep][order], at[keep][order]
        edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]]))
        many = np.repeat(np.diff(edge) >= AGAIN, np.diff(edge))
        gap = np.full(len(place) + 1, np.iinfo(np.int64).max)
        gap[1:-1] = np.where(ranked[1:] == ranked[:-1], place[1:] - place[:-1], gap[1:-1])
        near = np.empty(len(place), dtype=np.int64)
        near[order] = np.where(many, np.minimum(gap[1:], gap[:-1]), np.iinfo(np.int64).max)
        place = at[keep]
        # Neighbouring grams form a stretch inside one text; a gram must recur within its part of the stretch.
        new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (c.owner[place[1:]] != c.owner[place[:-1]])]))
        length = np.diff(np.append(new, len(place))) + GRAM - 1
        wide = np.repeat(length, length - GRAM + 1)
        stay = (near <= wide // times) & (wide >= least)
        if stay.all():
            break
        keep = keep[stay]
        if not len(keep):
            return
    place = at[keep]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (c.owner[place[1:]] != c.owner[place[:-1]])]))
    for a, b in zip(place[new].tolist(), place[np.append(new[1:], len(place)) - 1].tolist()):
        if b + GRAM - a >= least:
            yield a, b + GRAM


def text_runs(c: w.Chunk, least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start and then period."""
    hashes = w.word_hashes(c)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(c.first) - 1)]
    for a, b in _stretches(c, hashes, least, times):
        text = int(np.searchsorted(c.first, a, side="right")) - 1
        out[text] += [(a - int(c.first[text]) + s, n, q) for s, n, q in stretch_runs(hashes[a:b], least, times)]
    return [sorted(own, key=lambda r: (r[0], r[2])) for own in out]


def find_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``runs`` (start word, length and period, by start and then
    period) and ``collapsed``: the words that no run repeats, joined by one space.

    Words are what stands between blanks, compared byte for byte. A null text has no words, as an empty one. A word of a
    run after its first period is left out of ``collapsed``. Runs have at least ``least`` (6 or more) words and four
    periods. Repeated rows give repeated results; a very long text is worked on alone. Other columns are not read.
    """
    if least < LEAST:
        raise ValueError(f"runs need {LEAST} words or more")
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in w.chunks(batches, "text"):
            c = w.cut(texts, w.SPACED, lower=False)
            found, collapsed = text_runs(c, least), []
            for i, own in enumerate(found):
                kept = c.words(i)
                if own:
                    drop = np.zeros(len(kept) + 1, dtype=np.int64)
                    for s, n, q in own:
                        drop[s + q] += 1
                        drop[s + n] -= 1
                    kept = [x for x, d in zip(kept, np.cumsum(drop).tolist()) if not d]
                collapsed.append(b" ".join(kept))
            listed = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in found]
            arrays = [part.column("doc_id"), pa.array(c.counts.astype(np.int64)), pa.array(listed, type=pa.list_(item)), pa.array(collapsed, type=pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "runs", "collapsed"])

    return source.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
