"""Hard negatives of anchors: rows of other labels whose score is high, but below that of a positive.

Vectors are divided into segments, and the mean and deviation of each are stored beside them, for 1, 4 and 16 segments. For two
vectors, a segment of ``n`` components adds ``n * (mean * mean)`` to the inner product, give or take
``n * deviation * deviation``. Level by level these bounds remove the pairs that cannot reach what is asked for; those
left are scored exactly. A task keeps the best rows found so far, so its threshold rises as it reads.

Anchors come in blocks of bounded size, which go to all tasks; all rows are read once for the positives and
once for the negatives of a block. Each task returns at most the asked number of rows for each anchor (and positive), and a
limited window merges them. Rows are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemill.llm.tables import checkpointed
from tidemill.session import scratch_path

#: Segments at each level, anchors of a block, and rows and anchors that a task compares at once.
LEVELS = (1, 4, 16)
BLOCK_ANCHORS = 4096
ROWS_AT_ONCE, ANCHORS_AT_ONCE = 2048, 512
POSITIVES, NEGATIVES = 5, 10
#: Scores below this are exact in double precision; bounds of any score.
EXACT = 2.0**52
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def segments(size: int, count: int) -> list[tuple[int, int]]:
    """(start, end) of at most ``count`` segments of nearly equal length."""
    edges = np.unique(np.linspace(0, size, min(count, max(1, size)) + 1).astype(int)).tolist()
    return list(zip(edges[:-1], edges[1:]))


def summaries(x: np.ndarray) -> np.ndarray:
    """For each row and level: the means of the segments and then their deviations, both times the root of the length,
    so that bounds are plain inner products."""
    out = []
    for count in LEVELS:
        parts = segments(x.shape[1], count)
        roots = [np.sqrt(b - a) for a, b in parts]
        out += [x[:, a:b].mean(axis=1) * r for (a, b), r in zip(parts, roots)] + [x[:, a:b].std(axis=1) * r for (a, b), r in zip(parts, roots)]
    return np.stack(out, axis=1) if out else np.zeros((len(x), 0))


def _places(size: int) -> list[tuple[slice, slice]]:
    """Where ``summaries`` has the means and the deviations of each level."""
    out, at = [], 0
    for count in LEVELS:
        n = len(segments(size, count))
        out.append((slice(at, at + n), slice(at + n, at + 2 * n)))
        at += 2 * n
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``, by doubles where these are exact."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


class Best:
    """The first ``k`` rows for each of ``n`` slots, by falling score and then rising id (no id: last)."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.slot, self.score, self.id, self.known = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        self.least = np.full(n, LEAST)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        slot, score = np.concatenate([self.slot, slot]), np.concatenate([self.score, score])
        ids, known = np.concatenate([self.id, ids]), np.concatenate([self.known, known])
        order = np.lexsort((ids, ~known, -score, slot))
        slot = slot[order]
        first = np.searchsorted(slot, np.arange(self.n))
        keep = np.arange(len(slot)) - first[slot] < self.k
        order, slot = order[keep], slot[keep]
        self.slot, self.score, self.id, self.known = slot, score[order], ids[order], known[order]
        full = np.flatnonzero(np.bincount(slot, minlength=self.n) == self.k)
        last = np.searchsorted(slot, full, side="right") - 1
        self.least[full] = self.score[last]


class Filter:
    """Pairs of rows and anchors whose score may lie within bounds for each anchor."""

    def __init__(self, anchors: np.ndarray, summary: np.ndarray):
        self.anchors, self.summary, self.places = anchors, summary, _places(anchors.shape[1])
        self.scored = 0

    def pairs(self, rows: np.ndarray, summary: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, score) of the ``wanted`` pairs with ``low <= score <= high`` of the anchor."""
        for means, deviations in self.places:
            across, along = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
            if not len(across):
                break
            own, other = summary[across], self.summary[along]
            middle, spread = own[:, means] @ other[:, means].T, own[:, deviations] @ other[:, deviations].T
            # Rounding of the stored numbers must not decide.
            spread += 1e-9 * (np.abs(own[:, means]) @ np.abs(other[:, means]).T + spread) + 1e-6
            wanted[np.ix_(across, along)] &= (middle + spread >= low[along]) & (middle - spread <= high[along])
        across, along = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
        scores = products(rows[across], self.anchors[along])
        self.scored += int(wanted.sum())
        i, j = np.nonzero(wanted[np.ix_(across, along)] & (scores >= low[along]) & (scores <= high[along]))
        return across[i], along[j], scores[i, j]


def prepared(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: float) -> DataFrame:
    """``id``, ``label``, ``q`` (whole numbers, as doubles) and ``summary`` of the rows that take part, stored."""
    own = vectors.select(vectors[vec_id].alias("id"), vectors[label].cast("long").alias("label"), vectors[vector].cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    own = own.where(F.col("label").isNotNull() & F.col("v").isNotNull()).where(~bad)
    size = own.agg(F.max(F.size("v"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.floor(scale * padded(batch.column("v"), size))
            s = summaries(q)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel())) for m in (q, s)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *lists], names=["id", "label", "q", "summary"])

    return checkpointed(own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, label bigint, q array<double>, summary array<double>"))


def padded(lists: pa.ListArray, size: int) -> np.ndarray:
    """The lists as rows of a matrix; short ones end in zeros."""
    values, lengths = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    if len(lengths) and (lengths == size).all():
        return values.reshape(len(lengths), size)
    out = np.zeros((len(lengths), size))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _matrix(lists: pa.ListArray) -> np.ndarray:
    n = len(lists)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(n, len(values) // n) if n else np.zeros((0, 0))


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and whether there is one."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), known


def mine(
    vectors: DataFrame, anchors: Column, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES,
    negatives: int = NEGATIVES, low: int = 30, high: int = 90, scale: float = 256.0, block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """One row for each anchor, positive and negative: ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``,
    ``positive_score`` and ``negative_score``.

    A score is the inner product of ``floor(scale * x)``. ``anchors`` is a condition on ``id``. Positives are the anchor's first
    ``positives`` rows of its label, without rows of its id; negatives of each the first ``negatives`` rows of
    other labels with ``low * positive_score <= 100 * negative_score <= high * positive_score``. First means the highest score, then
    the smallest id, no id last. Rows with a null label or vector, or a component that is null or not finite, take no part; an empty
    vector scores 0, and shorter vectors end in zeros. Equal anchors count once, other repeated rows each have a place of their
    own. An anchor without positives has no rows. Scores must fit in a long. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = prepared(vectors, vec_id, vector, label, scale)
    chosen = checkpointed(rows.where(anchors).select("id", "label", "q", "summary").distinct())
    blocks = -(-chosen.count() // block_anchors)
    path = scratch_path(spark, f"negatives-{uuid.uuid4().hex}")
    for block in range(blocks):
        mine_of = chosen.where(F.pmod(F.xxhash64("id", "label", "q"), F.lit(blocks)) == block).toArrow().combine_chunks()
        for at in range(0, mine_of.num_rows, block_anchors):
            own = _block(spark, rows, mine_of.slice(at, block_anchors).combine_chunks(), positives, negatives, low, high)
            if mine_of.num_rows <= block_anchors and blocks == 1:
                return own
            own.write.mode("append").parquet(path)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score bigint, negative_score bigint"
    return spark.read.schema(schema).parquet(path) if blocks else spark.createDataFrame([], schema)


def _block(spark, rows: DataFrame, anchors: pa.Table, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result for one block of anchors."""
    ids, _ = _numbers(anchors.column("id").combine_chunks() if anchors.num_rows else pa.array([], type=pa.int64()))
    own = {
        "id": ids, "label": anchors.column("label").to_numpy(), "q": _matrix(anchors.column("q").combine_chunks()), "summary": _matrix(anchors.column("summary").combine_chunks()),
    }
    sent = spark.sparkContext.broadcast(own)
    kind = rows.schema["id"].dataType.simpleString()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        n = len(a["id"])
        best = Best(n, positives)
        for other, at, filtered in _tiles(batches, a):
            lab, oid, known = other["label"], other["id"], other["known"]
            wanted = (lab[:, None] == a["label"][at]) & ((oid[:, None] != a["id"][at]) | ~known[:, None])
            i, j, s = filtered.pairs(other["q"], other["summary"], wanted, best.least[at], np.full(wanted.shape[1], MOST))
            best.add(at.start + j, s, oid[i], known[i])
        yield _found(best, ["anchor", "id", "score"], rows_kind(kind))

    top = rows.mapInArrow(near, f"anchor bigint, id {kind}, score bigint")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    top = checkpointed(top.withColumn("place", place).where(F.col("place") <= positives))
    # At most ``positives`` rows for each anchor of the block.
    got = top.orderBy("anchor", "place").toArrow().combine_chunks()
    slot, score = got.column("anchor").to_numpy(), got.column("score").to_numpy()
    known = spark.sparkContext.broadcast((slot, score))

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        slot, score = known.value
        best = Best(len(slot), negatives)
        # Whole scores between the bounds.
        floor, ceiling = -(-low * score // 100), high * score // 100
        for other, at, filtered in _tiles(batches, a):
            mine_of = np.flatnonzero((slot >= at.start) & (slot < at.stop))
            if not len(mine_of):
                continue
            n = at.stop - at.start
            local = slot[mine_of] - at.start
            least, most = np.full(n, MOST), np.full(n, LEAST)
            bound = np.maximum(floor[mine_of], best.least[mine_of])
            open_ = bound <= ceiling[mine_of]
            np.minimum.at(least, local[open_], bound[open_])
            np.maximum.at(most, local[open_], ceiling[mine_of][open_])
            wanted = (other["label"][:, None] != a["label"][at]) & (least <= most)
            i, j, s = filtered.pairs(other["q"], other["summary"], wanted, least, most)
            if not len(i):
                continue
            # Each pair goes to all positives of its anchor whose bounds hold it.
            first, last = np.searchsorted(local, j), np.searchsorted(local, j, side="right")
            count = last - first
            pair = np.repeat(np.arange(len(i)), count)
            to = mine_of[np.repeat(first, count) + np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)]
            ok = (s[pair] >= np.maximum(floor[to], best.least[to])) & (s[pair] <= ceiling[to])
            pair, to = pair[ok], to[ok]
            best.add(to, s[pair], other["id"][i[pair]], other["known"][i[pair]])
        yield _found(best, ["slot", "id", "score"], rows_kind(kind))

    under = rows.mapInArrow(hard, f"slot bigint, id {kind}, score bigint").withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id")))
    under = under.withColumn("rank", rank).where(F.col("rank") <= negatives)
    names = pa.table({"slot": pa.array(np.arange(len(slot), dtype=np.int64)), "anchor_id": pa.array(ids[slot]).cast(got.schema.field("id").type), "positive_id": got.column("id"), "positive_score": got.column("score")})
    # One row for each anchor and positive of the block.
    return under.join(F.broadcast(spark.createDataFrame(names)), "slot").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def rows_kind(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.int64())


def _tiles(batches: Iterator[pa.RecordBatch], a: dict) -> Iterator[tuple[dict, slice, Filter]]:
    """Some rows beside some anchors; few rows at first, so that thresholds rise early."""
    parts = [slice(x, min(x + ANCHORS_AT_ONCE, len(a["id"]))) for x in range(0, len(a["id"]), ANCHORS_AT_ONCE)]
    filters = [Filter(a["q"][p], a["summary"][p]) for p in parts]
    size = 128
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            piece = batch.slice(at, size)
            at += size
            size = min(2 * size, ROWS_AT_ONCE)
            ids, known = _numbers(piece.column("id"))
            other = {"id": ids, "known": known, "label": piece.column("label").to_numpy(), "q": _matrix(piece.column("q")), "summary": _matrix(piece.column("summary"))}
            for part, filtered in zip(parts, filters):
                yield other, part, filtered


def _found(best: Best, names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.id, mask=~best.known).cast(kind), pa.array(best.score)], names=names)
