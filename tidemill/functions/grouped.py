"""Exact quantiles of every group of a table, for any number of groups of any size.

Groups of few rows are sorted one by one. For each of the others a table keyed by group holds brackets around
the wanted order statistics: sketches give the first ones, then rounds of one scan joined with that table count what
lies below and inside, and open, narrow or settle each bracket. Brackets end as few distinct values, which alone are
ranked. The table joins by broadcast while it is counted small, else with the rows of very large groups spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemill.functions.order import lookup_by_value
from tidemill.functions.quantiles import ACCURACY, FINEST, partition_group, sketch_size
from tidemill.session import checkpointed

#: A group up to this size is sorted in one row, and a bracket with fewer values is ranked.
SMALL_GROUP = 5_000
#: Groups and bytes of group names up to which a table of groups is sent to every task.
FEW_GROUPS, FEW_BYTES = 100_000, 8 << 20
#: Ranks at which a sketch is read, so a round narrows a bracket to a few parts in so many.
GRID = 1000


@dataclass
class Groups:
    """A table with one row per group (``g``, ``n`` and more), and how to join it to rows."""

    table: DataFrame
    rows: int
    few: bool

    @classmethod
    def counted(cls, table: DataFrame) -> Groups:
        count, size, rows = table.agg(F.count("*"), F.sum(F.octet_length(F.col("g").cast("string"))), F.sum("n")).first()
        return cls(table, rows or 0, count <= FEW_GROUPS and (size or 0) <= FEW_BYTES)

    def join(self, df: DataFrame, key: Column, fields: Sequence[str], prefix: str = "") -> DataFrame:
        """``df`` with ``fields`` of its group, null where it has none; the rows of one group may be in many tasks."""
        return lookup_by_value(df, key, self.table, "g", "n", self.rows, {f: prefix + f for f in fields}, self.few)


def _ranks(n: Column, probs: Sequence[float]) -> list[tuple[Column, Column, Column]]:
    """(rank of the lower order statistic, rank of the upper one, share of the upper one) of each quantile of ``n`` rows."""
    out = []
    for p in probs:
        at = (n - 1).cast("double") * F.lit(float(p))
        first = F.floor(at)
        share = at - first
        out.append((first, first + (share > 0).cast("int"), share))
    return out


def grouped_quantiles(df: DataFrame, group: Column, value: Column, probs: Sequence[float], uniform: bool = False) -> DataFrame:
    """``g``, ``n`` (values) and ``q`` (linearly interpolated quantiles) of every group with a value.

    Missing values and rows without a group are skipped. ``uniform`` says that values are spread evenly over [0, 1), as
    hashes are, so that first brackets follow from the counts; the result is exact either way.
    """
    x = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    rows = df.select(group.alias("g"), x.alias("x")).where("g is not null and x is not null")
    sizes = checkpointed(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")))
    large = sizes.where(F.col("n") > SMALL_GROUP)
    probs = list(probs)
    if not large.limit(1).count():
        return _sorted_groups(rows, probs)
    large = checkpointed(large)
    groups = Groups.counted(large)
    marked = groups.join(rows, F.col("g"), ["n"], "__")
    small = _sorted_groups(marked.where("__n is null").select("g", "x"), probs)
    return small.unionByName(_narrowed(marked.where("__n is not null").select("g", "x"), large, probs, uniform))


def _sorted_groups(rows: DataFrame, probs: list[float]) -> DataFrame:
    held = rows.groupBy("g").agg(F.array_sort(F.collect_list("x")).alias("xs")).withColumn("n", F.size("xs").cast("bigint"))
    q = []
    for first, last, share in _ranks(F.col("n"), probs):
        lower, upper = F.get("xs", first.cast("int")), F.get("xs", last.cast("int"))
        q.append(lower * (1 - share) + upper * share)
    return held.select("g", "n", F.array(*q).alias("q"))


def _sketch_brackets(rows: DataFrame, values: list[Column], accuracy: int) -> DataFrame:
    """``g`` and one merged sketch ``s{j}`` of each of the ``values``, merged in two levels."""
    size = sketch_size(accuracy)
    first = rows.withColumn("__part", partition_group()).groupBy("g", "__part").agg(*[F.kll_sketch_agg_double(v, size).alias(f"s{j}") for j, v in enumerate(values)])
    return first.groupBy("g").agg(*[F.kll_merge_agg_double(f"s{j}", size).alias(f"s{j}") for j in range(len(values))])


def _cut(sketch: str, low: Column, high: Column) -> list[Column]:
    """Sketched values not above and not below two ranks, from an even grid; null for a sketch without values."""
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    found = F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, grid))
    at = [F.floor(low * GRID), F.ceil(high * GRID)]
    return [F.get(found, F.greatest(F.lit(0), F.least(F.lit(GRID), i)).cast("int")) for i in at]


def _any(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def _narrowed(rows: DataFrame, large: DataFrame, probs: list[float], uniform: bool) -> DataFrame:
    index, accuracy, x = range(len(probs)), ACCURACY, F.col("x")
    ranks = _ranks(F.col("n"), probs)
    low, high = [F.col(f"lo{j}") for j in index], [F.col(f"hi{j}") for j in index]
    if uniform:
        ends = {}
        for j, p in enumerate(probs):
            reach = 5 * F.sqrt(F.lit(p * (1 - p)) / F.col("n")) + 2 / F.col("n")
            ends |= {f"lo{j}": F.greatest("low", F.lit(p) - reach), f"hi{j}": F.least("high", F.lit(p) + reach)}
        state = large.withColumns(ends)
    else:
        ends, margin = {}, 3.0 / accuracy
        for j, p in enumerate(probs):
            ends[f"lo{j}"], ends[f"hi{j}"] = _cut("s0", F.lit(p - margin), F.lit(p + margin))
        state = large.join(_sketch_brackets(rows, [x], accuracy), "g").withColumns(ends).drop("s0")
    state = checkpointed(state)
    while True:
        joined = Groups.counted(state).join(rows, F.col("g"), [f"{e}{j}" for j in index for e in ("lo", "hi")])
        inside = [(x >= low[j]) & (x <= high[j]) for j in index]
        counts = joined.groupBy("g").agg(
            *[F.count_if(x < low[j]).alias(f"below{j}") for j in index], *[F.count_if(inside[j]).alias(f"in{j}") for j in index],
            *[F.approx_count_distinct(F.when(inside[j], x)).alias(f"d{j}") for j in index],
        )
        below, within = [F.col(f"below{j}") for j in index], [F.col(f"in{j}") for j in index]
        flags = {f"under{j}": below[j] > ranks[j][0] for j in index} | {f"over{j}": below[j] + within[j] <= ranks[j][1] for j in index}
        flags |= {f"many{j}": (below[j] <= ranks[j][0]) & (below[j] + within[j] > ranks[j][1]) & (low[j] < high[j]) & (F.col(f"d{j}") > SMALL_GROUP) for j in index}
        state = checkpointed(state.join(counts, "g").withColumns(flags))
        missed = state.agg(F.count_if(_any([F.col(f"{f}{j}") for f in ("under", "over") for j in index])), F.count_if(_any([F.col(f"many{j}") for j in index]))).first()
        if missed == (0, 0):
            return _picked(joined, state, probs)
        if missed[1]:
            # A finer sketch of what is left, so that a bracket always shrinks.
            accuracy = min(10 * accuracy, FINEST)
            margin = 3.0 / accuracy
            state = state.join(_sketch_brackets(joined, [F.when(inside[j], x) for j in index], accuracy), "g")
            ends = {}
            for j in index:
                cut = _cut(f"s{j}", (ranks[j][0] - below[j]) / within[j] - margin, (ranks[j][1] - below[j] + 1) / within[j] + margin)
                ends |= {f"lo{j}": F.when(F.col(f"many{j}"), cut[0]).otherwise(low[j]), f"hi{j}": F.when(F.col(f"many{j}"), cut[1]).otherwise(high[j])}
            state = state.withColumns(ends)
        # A sketch that was off: open the failing side fully and count again.
        opened = {f"lo{j}": F.when(F.col(f"under{j}"), F.col("low")).otherwise(low[j]) for j in index}
        opened |= {f"hi{j}": F.when(F.col(f"over{j}"), F.col("high")).otherwise(high[j]) for j in index}
        state = checkpointed(state.withColumns(opened).select("g", "n", "low", "high", *opened))


def _picked(joined: DataFrame, state: DataFrame, probs: list[float]) -> DataFrame:
    """The quantiles from brackets that are settled or hold few distinct values."""
    index = range(len(probs))
    x = F.col("x")
    hits = F.array_compact(F.array(*[F.when((x >= F.col(f"lo{j}")) & (x <= F.col(f"hi{j}")) & (F.col(f"lo{j}") < F.col(f"hi{j}")), F.lit(j)) for j in index]))
    counted = joined.select("g", "x", F.explode(hits).alias("j")).groupBy("g", "j", "x").agg(F.count("*").alias("c"))
    before = Window.partitionBy("g", "j").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("upto", F.sum("c").over(before))
    ranked = state.select("g", F.posexplode(F.array(*[F.struct((a - F.col(f"below{j}")).alias("a"), (b - F.col(f"below{j}")).alias("b")) for j, (a, b, _) in enumerate(_ranks(F.col("n"), probs))])).alias("j", "r"))
    found = counted.join(ranked, ["g", "j"]).groupBy("g").agg(
        *[F.min(F.when((F.col("j") == j) & (F.col("upto") > F.col("r.a")), x)).alias(f"a{j}") for j in index],
        *[F.min(F.when((F.col("j") == j) & (F.col("upto") > F.col("r.b")), x)).alias(f"b{j}") for j in index],
    )
    q = []
    for j, (_, _, share) in enumerate(_ranks(F.col("n"), probs)):
        settled = F.col(f"lo{j}") == F.col(f"hi{j}")
        lower = F.when(settled, F.col(f"lo{j}")).otherwise(F.col(f"a{j}"))
        upper = F.when(settled, F.col(f"lo{j}")).otherwise(F.col(f"b{j}"))
        q.append(lower * (1 - share) + upper * share)
    return state.join(found, "g", "left").select("g", "n", F.array(*q).alias("q"))
