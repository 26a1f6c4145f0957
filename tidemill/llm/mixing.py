"""Mixing of sources to target weights, in words.

Documents get hash-random keys and are range-sorted within their source. Word counts are summed along that order: inside
a range by a window, between ranges by one total for each range and source. A source's budget is cut where its prefix sum
reaches it, so the last document gives a part of its words; a budget above the source's size takes all of it once or more
and cuts in the last epoch. A range holds a bounded share of the rows, whatever share a source has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemill.functions.order import global_index
from tidemill.llm import words as w
from tidemill.llm.tables import FEW_KEYS, checkpointed
from tidemill.session import shuffle_width

#: Weights of the sources in code point order, from the start again after the last.
WEIGHTS = (5, 2, 1)
#: Most words that a source gives, as a multiple of its own.
MOST_EPOCHS = 3
#: A table of sources is sent to every task up to this many bytes of names and numbers.
SMALL_BYTES = 8 << 20


def sized(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """``doc_id``, ``source`` and ``size`` (words of the whole text) of every row."""
    own = docs.select(docs[doc_id].alias("doc_id"), docs[source].cast("string").alias("source"), docs[text].cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in w.chunks(batches, "text"):
            counts = w.cut(texts, w.SPACED, lower=False).counts
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(counts, type=pa.int64())], names=["doc_id", "source", "size"])

    return own.mapInArrow(run, f"doc_id {kind}, source string, size bigint")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``sources`` (``source``, ``source_size``) with ``number`` (its place), ``weight`` and ``target``.

    The whole size is shared by weight; a target stops at ``most_epochs`` times its source, and what it leaves is shared
    again among the others until none is above. Each round is one aggregate, of which three numbers come back.
    """
    sources = sources.withColumn("__last", F.col("source").isNull())
    numbered = global_index(sources, ["__last", "source"], "number").drop("__last")
    weight = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    numbered = checkpointed(numbered.withColumn("weight", weight.cast("bigint")))
    whole = numbered.agg(F.sum("source_size").alias("r"), F.sum("weight").alias("w")).first()
    words, share = whole.r or 0, whole.w or 0
    while True:
        # most_epochs * size / weight below words / share, in whole numbers.
        above = F.col("source_size").cast("decimal(38,0)") * most_epochs * F.lit(share) < F.col("weight").cast("decimal(38,0)") * F.lit(words)
        full = numbered.where(above).agg(F.sum("source_size").alias("r"), F.sum("weight").alias("w")).first()
        left = (whole.r or 0) - most_epochs * (full.r or 0), (whole.w or 0) - (full.w or 0)
        if left == (words, share):
            break
        words, share = left
    even = (F.col("weight") * F.lit(words)).cast("double") / F.lit(float(max(1, share)))
    target = F.when(above, (F.col("source_size") * most_epochs).cast("double")).otherwise(even)
    return numbered.withColumn("target", target)


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS, seed: int = 1,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``epochs`` (times that the
    whole document is taken) and ``taken`` (words taken, those of a last part included).

    Null texts have no words. Rows without a source are one source, the last. The order inside a source is that of a hash
    of ``seed`` and ``doc_id``, then of id and size, so reruns agree and equal rows are interchangeable: of several with
    one id and size, any may be the one that is cut. A source without words has the target 0. The words taken of
    a source are its target, rounded. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = checkpointed(sized(docs, doc_id, source, text))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = checkpointed(targets(checkpointed(totals), weights, most_epochs))
    size = plan.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()
    small = size[0] <= FEW_KEYS and (size[1] or 0) <= SMALL_BYTES

    # ``spread`` divides equal rows between ranges too.
    order = ["slot", "key", "doc_id", "size", "spread"]
    slot = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    key = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, 16)
    ranged = rows.select("doc_id", "source", "size", slot.alias("slot"), key.alias("key"), F.monotonically_increasing_id().alias("spread"))
    ranged = checkpointed(ranged.repartitionByRange(shuffle_width(spark), *order).withColumn("range", F.spark_partition_id()))
    # One row for each range and source: a source has more than one only where it fills ranges.
    parts = ranged.groupBy("slot", "range").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("slot").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("slot", "range", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("offset"))
    plan = plan.select(slot.alias("slot"), "source_size", "target")
    parts = checkpointed(parts.join(F.broadcast(plan) if small else plan, "slot"))

    inside = Window.partitionBy("slot", "range").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, ["slot", "range"])
    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    found = found.withColumn("budget", budget).withColumn("full", whole)
    last = F.col("budget") - F.col("full") * F.col("source_size") - F.col("offset") - F.col("before")
    part = F.greatest(F.lit(0), F.least(F.col("size"), last)).cast("bigint")
    return found.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("full") + ((part == F.col("size")) & (part > 0)).cast("bigint")).alias("epochs"),
        (F.col("full") * F.col("size") + part).alias("taken"),
    )
