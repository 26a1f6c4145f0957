"""Order-dependent helpers that never bring a whole table, value or key into one task.

* ``global_index``: row numbers in a total order,
* ``value_ranks``: average ranks of the distinct values of a numeric column,
* ``lookup_by_value``: join a per-value table back to rows although some values are very frequent,
* ``forward_carry``: last non-null value before each row, across partition borders.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemill.functions.columns import name, present, require
from tidemill.functions.quantiles import split_points
from tidemill.session import checkpointed, shuffle_width

# A value that holds more than this share of the rows is looked up by broadcast. At most
# HOT_PARTS values can, so the broadcast side is bounded whatever the data.
HOT_PARTS = 1000
# A per-value table counted below this many values is ranked in one task and joined by broadcast.
SMALL_TABLE = 50_000


def with_bucket(df: DataFrame, value: Column, cuts: Sequence[float], out: str) -> DataFrame:
    """Add the index of the half-open interval between ``cuts`` that holds ``value``."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    source = out + "__x"
    splitter = Bucketizer(
        splits=[-math.inf, *cuts, math.inf], inputCol=source, outputCol=out, handleInvalid="keep"
    )
    return (
        splitter.transform(df.withColumn(source, value.cast("double")))
        .withColumn(out, F.col(out).cast("int"))
        .drop(source)
    )


def isolating_cuts(df: DataFrame, value: Column, buckets: int, by: str | None = None) -> list[float]:
    """Cut values where each value frequent enough to fill a bucket gets one to itself.

    ``by`` names a column of coarser ranges, each of which is then cut into ``buckets``.
    """
    if buckets < 2:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    sketch = F.percentile_approx(value.cast("double"), probs, max(1000, 10 * buckets)).alias("q")
    grouped = df.groupBy(by) if by else df.groupBy()
    cuts: set[float] = set()
    for row in grouped.agg(sketch).collect():
        found = row["q"] or []
        for i, cut in enumerate(found):
            cuts.add(cut)
            if i and found[i - 1] == cut:
                cuts.add(math.nextafter(cut, math.inf))
    return sorted(cuts)


def global_index(df: DataFrame, order_by: Sequence[str], out: str = "row_index") -> DataFrame:
    """Zero-based position of every row in the order of ``order_by``.

    The sorted rows are written with their partition and position, so both uses below see
    the same partitions even after an executor is lost.
    """
    require(df, order_by)
    keys = [name(c) for c in order_by]
    parts = shuffle_width(df.sparkSession)
    rows = checkpointed(
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("__mid", F.monotonically_increasing_id())
    )
    rows = rows.withColumn("__pid", F.shiftright("__mid", 33)).withColumn(
        "__pos", F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    )
    # One row per partition, so this window stays small.
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__pid").agg(F.count("*").alias("__n"))
    offsets = offsets.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (
        rows.join(F.broadcast(offsets), "__pid")
        .withColumn(out, F.col("__off") + F.col("__pos"))
        .drop("__pid", "__mid", "__pos", "__off")
    )


def running_before(counts: DataFrame, value: str, cuts: Sequence[float], sums: Sequence[str]) -> DataFrame:
    """For a table with one row per distinct value: the sum of each column over smaller values.

    Values are split into ranges; only one row per range is summed globally, and the window
    inside a range sees that range alone. Results are named ``<column>_before``. No ``cuts`` means
    that the values are few enough for one task.
    """
    if not cuts:
        ahead = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select("*", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in sums])
    # Written once: the range totals and the windows below both read it.
    counts = checkpointed(counts)
    ranged = with_bucket(counts, F.col(value), cuts, "__b")
    totals = ranged.groupBy("__b").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__b", *[F.coalesce(F.sum(f"__t_{c}").over(earlier), F.lit(0)).alias(f"__o_{c}") for c in sums]
    )
    inside = Window.partitionBy("__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select(
        "*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__l_{c}") for c in sums]
    )
    joined = local.join(F.broadcast(offsets), "__b", "left")
    return joined.select(
        *counts.columns,
        *[(F.col(f"__o_{c}") + F.col(f"__l_{c}")).alias(f"{c}_before") for c in sums],
    )


def range_count(spark, rows: int) -> int:
    """How many value ranges to use: about a million rows each, at least one per shuffle task."""
    return max(shuffle_width(spark), min(5000, math.ceil(rows / 1_000_000)))


def value_ranks(df: DataFrame, column: str, rows: int) -> DataFrame:
    """(value, n, rank): the average rank of each distinct non-null value.

    ``rows`` sizes the value ranges; 0 says that the values are few and need no ranges.
    """
    base = df.select(present(column, df.schema[column].dataType).cast("double").alias("value"))
    base = base.filter("value IS NOT NULL")
    cuts = split_points(base, F.col("value"), range_count(df.sparkSession, rows)) if rows else []
    counts = base.groupBy("value").agg(F.count("*").alias("n"))
    ranked = running_before(counts, "value", cuts, ["n"])
    ranked = ranked.select("value", "n", (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("rank"))
    return checkpointed(ranked) if rows else ranked


def lookup_by_value(
    df: DataFrame, key: Column, table: DataFrame, table_key: str, count: str, rows: int,
    fields: dict[str, str], small: bool = False,
) -> DataFrame:
    """Left-join ``fields`` of a per-value ``table`` to ``df`` without skew.

    Values that hold more than 1/1000 of the rows (so fewer than a thousand of them) are joined by
    broadcast. Their rows, and rows with no key, carry a random salt into the shuffle join that
    serves all other values, so they spread over its tasks instead of meeting in one. A table
    that the caller has counted as ``small`` is broadcast as a whole.
    """
    if small:
        every = table.select(F.col(table_key).alias("__hk"), *[F.col(f).alias(f"__h_{f}") for f in fields])
        out = df.join(F.broadcast(every), key == F.col("__hk"), "left")
        return out.select(*[name(c) for c in df.columns], *[F.col(f"__h_{f}").alias(new) for f, new in fields.items()])
    bound = max(1.0, rows / HOT_PARTS)
    hot = table.filter(F.col(count) > bound).select(
        F.col(table_key).alias("__hk"), *[F.col(f).alias(f"__h_{f}") for f in fields]
    )
    cold = table.filter(F.col(count) <= bound).select(
        F.col(table_key).alias("__ck"), F.lit(0).alias("__cs"), *[F.col(f).alias(f"__c_{f}") for f in fields]
    )
    out = df.withColumn("__k", key).join(F.broadcast(hot), F.col("__k") == F.col("__hk"), "left")
    settled = F.col("__hk").isNotNull() | F.col("__k").isNull()
    salt = F.when(settled, F.pmod(F.monotonically_increasing_id(), F.lit(4096)) + 1).otherwise(0)
    out = out.withColumn("__s", salt.cast("int"))
    out = out.join(cold, (F.col("__k") == F.col("__ck")) & (F.col("__s") == F.col("__cs")), "left")
    return out.select(
        *[name(c) for c in df.columns],
        *[F.coalesce(F.col(f"__h_{f}"), F.col(f"__c_{f}")).alias(new) for f, new in fields.items()],
    )


def forward_carry(
    df: DataFrame, cols: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()
) -> DataFrame:
    """Fill NULLs in ``cols`` with the last earlier non-null value; leading NULLs stay.

    Rows are range partitioned by the whole ordering, so a key with very many rows is cut into
    several partitions. Each partition reports one summary row; from these the value that enters
    each partition is worked out and joined back by partition number.
    """
    require(df, [*cols, *order_by, *partition_by])
    spark = df.sparkSession
    keys = [name(c) for c in partition_by]
    order = [name(c) for c in order_by]
    rows = checkpointed(
        df.repartitionByRange(shuffle_width(spark), *keys, *order).withColumn("__pid", F.spark_partition_id())
    )
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    place = F.struct(*keys, *order)
    summary = rows.groupBy("__pid").agg(
        F.min(key).alias("first_key"),
        F.max(key).alias("last_key"),
        *[
            F.max_by(F.struct(key.alias("k"), name(c).alias("v")), F.when(name(c).isNotNull(), place)).alias(f"v{i}")
            for i, c in enumerate(cols)
        ],
    )
    entering = _entering_values(summary.orderBy("__pid").collect(), len(cols))
    fields = [T.StructField("__pid", T.IntegerType())]
    fields += [T.StructField(f"__k{i}", df.schema[c].dataType) for i, c in enumerate(partition_by)]
    fields += [T.StructField(f"__v{i}", df.schema[c].dataType) for i, c in enumerate(cols)]
    flat = [(pid, *(k if keys else ()), *values) for pid, k, values in entering]
    carried = spark.createDataFrame(flat, T.StructType(fields))
    so_far = Window.partitionBy("__pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select(
        "*", *[F.last(name(c), ignorenulls=True).over(so_far).alias(f"__f{i}") for i, c in enumerate(cols)]
    ).join(F.broadcast(carried), "__pid", "left")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & k.eqNullSafe(F.col(f"__k{i}"))
    filled = {c: F.coalesce(F.col(f"__f{i}"), F.when(same, F.col(f"__v{i}"))) for i, c in enumerate(cols)}
    return out.select(*[filled[c].alias(c) if c in filled else name(c) for c in df.columns])


def _entering_values(summary: list, width: int) -> list[tuple]:
    """(partition, its first key, value entering it per column), from one summary row each."""
    entering = []
    key, values = None, [None] * width
    for row in summary:
        pid, first, last = row["__pid"], tuple(row["first_key"]), tuple(row["last_key"])
        entering.append((pid, first, list(values) if key == first else [None] * width))
        kept = key == last and first == last
        for i in range(width):
            latest = row[f"v{i}"]
            if latest is not None and tuple(latest["k"]) == last:
                values[i] = latest["v"]
            elif not kept:
                values[i] = None
        key = last
    return entering
