"""Exact quantiles of any number of columns without sorting or collecting them.

Spark's ``percentile`` keeps every distinct value of a column in one task. Here bounded sketches
bracket the wanted order statistics, one scan counts what lies below and inside each bracket,
and the bracket is narrowed until the few distinct values left in it are safe to bring together.
Each round is a scan with map-side aggregation only; nothing is shuffled by value until the end.

Sketches are merged in two levels, first those of about sqrt(n) input partitions, then the sqrt(n)
results, so no task reads a sketch of every partition.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.jobs import together

ACCURACY, FINEST = 1000, 10_000
FETCH_LIMIT = 200_000
CHUNK = 12  # aggregates per job; larger ones outgrow what the JVM compiles


@dataclass
class _Bracket:
    name: str
    first: int      # zero-based rank of the lower order statistic
    last: int       # rank of the upper one
    fraction: float
    low: float
    high: float
    below: int = 0
    inside: int = 0

    @property
    def settled(self) -> bool:
        return self.low == self.high

    def member(self, x: Column) -> Column:
        return (x >= F.lit(self.low)) & (x <= F.lit(self.high))


def run_aggregates(df: DataFrame, wanted: list[Column], chunk: int = CHUNK) -> list:
    """Evaluate many aggregates, a bounded number per job so that generated code stays small."""

    def job(part: list[Column]):
        return lambda: list(df.agg(*[c.alias(f"a{i}") for i, c in enumerate(part)]).first())

    return [v for row in together([job(wanted[i : i + chunk]) for i in range(0, len(wanted), chunk)]) for v in row]


def sketch_size(accuracy: int) -> int:
    """The KLL parameter whose rank error is about ``1 / accuracy``, as far as sketches may grow."""
    return max(64, min(65_535, int(2.5 * accuracy**1.1)))


def partition_group() -> Column:
    """A number for each input partition that about sqrt(n) neighbours share; there are about sqrt(n) numbers."""
    return F.floor(F.sqrt(F.spark_partition_id().cast("double"))).cast("int")


def sketched(df: DataFrame, values: list[Column], ranks: list[list[float]], accuracy: int, chunk: int = 4) -> list:
    """Count, least value, largest value and approximate quantiles at ``ranks`` of each column, in one flat list."""
    size = sketch_size(accuracy)

    def job(at: int):
        part = values[at : at + chunk]
        rows = df.select(*[c.alias(f"v{i}") for i, c in enumerate(part)]).withColumn("__part", partition_group())
        first, second, out = [], [], []
        for i in range(len(part)):
            v = F.col(f"v{i}")
            first += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"), F.kll_sketch_agg_double(v, size).alias(f"s{i}")]
            second += [F.sum(f"n{i}").alias(f"n{i}"), F.min(f"a{i}").alias(f"a{i}"), F.max(f"b{i}").alias(f"b{i}"), F.kll_merge_agg_double(f"s{i}", size).alias(f"s{i}")]
            wanted = F.array(*[F.lit(float(r)) for r in ranks[at + i]])
            out += [F.coalesce(f"n{i}", F.lit(0)), F.col(f"a{i}"), F.col(f"b{i}"), F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(F.col(f"s{i}"), wanted))]
        merged = rows.groupBy("__part").agg(*first).agg(*second)
        return lambda: list(merged.select(*[c.alias(f"o{i}") for i, c in enumerate(out)]).first())

    return [v for row in together([job(at) for at in range(0, len(values), chunk)]) for v in row]


def exact_quantiles(
    df: DataFrame,
    targets: Mapping[str, Column],
    probs: Sequence[float],
    accuracy: int = ACCURACY,
    fetch_limit: int = FETCH_LIMIT,
    uniform: bool = False,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each named numeric expression; NULLs are skipped.

    ``uniform`` says that values are spread evenly over [0, 1), as hashes are: then the brackets
    follow from the count and need no sketch. The result is exact either way.
    """
    probs = list(probs)
    if not targets or not probs:
        return {t: [] for t in targets}
    # One plain column per target first, so that each expression is computed once per row and scan.
    df = df.select(*[F.nanvl(c.cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(targets.values())])
    numbers = {t: F.col(f"x{i}") for i, t in enumerate(targets)}
    margin = 3.0 / accuracy
    edges = sorted({min(1.0, max(0.0, p + side)) for p in probs for side in (-margin, margin)})
    names = list(numbers)
    if uniform:
        found = run_aggregates(df, [c for t in names for x in [numbers[t]] for c in (F.count(x), F.min(x), F.max(x), F.lit(None))], 8)
    else:
        found = sketched(df, [numbers[t] for t in names], [edges] * len(names), accuracy)
    brackets: dict[tuple[str, float], _Bracket] = {}
    answers: dict[str, list[float | None]] = {t: [None] * len(probs) for t in names}
    span: dict[str, tuple[float, float]] = {}
    for i, t in enumerate(names):
        n, low, high, sketch = found[4 * i : 4 * i + 4]
        if not n:
            continue
        span[t] = (low, high)
        at = dict(zip(edges, sketch or edges))
        for p in probs:
            position = (n - 1) * p
            first = math.floor(position)
            fraction = position - first
            last = first + (1 if fraction > 0 else 0)
            lo_edge, hi_edge = max(0.0, p - margin), min(1.0, p + margin)
            if uniform:
                reach = 5 * math.sqrt(p * (1 - p) / n) + 2 / n
                brackets[t, p] = _Bracket(t, first, last, fraction, max(low, p - reach), min(high, p + reach))
                continue
            brackets[t, p] = _Bracket(
                t, first, last, fraction,
                low if lo_edge == 0.0 else at[lo_edge],
                high if hi_edge == 1.0 else at[hi_edge],
            )
    _narrow(df, numbers, brackets, span, accuracy, fetch_limit)
    values = _fetch(df, numbers, {k: b for k, b in brackets.items() if not b.settled})
    for (t, p), b in brackets.items():
        if b.settled:
            answer = b.low
        else:
            lower = _order_statistic(values[t, p], b.first - b.below)
            upper = _order_statistic(values[t, p], b.last - b.below)
            answer = lower + (upper - lower) * b.fraction
        for i, q in enumerate(probs):
            if q == p:
                answers[t][i] = float(answer)
    return answers


def _narrow(df, numbers, brackets, span, accuracy, fetch_limit) -> None:
    pending = dict(brackets)
    per_bracket = max(1, fetch_limit // max(1, len(brackets)))
    while pending:
        wanted: list[Column] = []
        for b in pending.values():
            x = numbers[b.name]
            wanted += [F.count_if(x < F.lit(b.low)), F.count_if(b.member(x))]
        found = run_aggregates(df, wanted)
        wide, large = {}, {}
        for i, (key, b) in enumerate(pending.items()):
            b.below, b.inside = found[2 * i : 2 * i + 2]
            misses_low = b.below > b.first
            misses_high = b.below + b.inside <= b.last
            if misses_low or misses_high:
                # The sketch was off: open the failing side fully and count again.
                b.low = span[b.name][0] if misses_low else b.low
                b.high = span[b.name][1] if misses_high else b.high
                wide[key] = b
            elif not b.settled and b.inside > per_bracket:
                large[key] = b
        if large:
            # Many rows may still be few values; only many values need another round.
            distinct = [F.approx_count_distinct(F.when(b.member(numbers[b.name]), numbers[b.name])) for b in large.values()]
            large = {k: b for (k, b), d in zip(large.items(), run_aggregates(df, distinct, 8)) if d > per_bracket}
        if large:
            # A finer sketch of what is left, up to the finest there is, so that a bracket always shrinks.
            accuracy = min(10 * accuracy, FINEST)
            _resketch(df, numbers, large, accuracy)
        pending = {**wide, **large}


def _resketch(df, numbers, brackets, accuracy) -> None:
    margin = 3.0 / accuracy
    values, ranks = [], []
    for b in brackets.values():
        x = numbers[b.name]
        values.append(F.when(b.member(x), x))
        ranks.append([max(0.0, (b.first - b.below) / b.inside - margin), min(1.0, (b.last - b.below + 1) / b.inside + margin)])
    found = sketched(df, values, ranks, accuracy)
    for i, b in enumerate(brackets.values()):
        b.low, b.high = found[4 * i + 3]


def _fetch(df, numbers, brackets) -> dict[tuple[str, float], list[tuple[float, int]]]:
    """The distinct values inside each bracket with their counts, a checked small number."""
    if not brackets:
        return {}
    keys = list(brackets)
    by_name: dict[str, list[int]] = {}
    for i, key in enumerate(keys):
        by_name.setdefault(key[0], []).append(i)

    def job(name: str, slots: list[int]):
        # The brackets of one column; a value may lie in several of them.
        x = numbers[name]
        within = [F.when(brackets[keys[i]].member(x), F.lit(i)) for i in slots]
        hit = F.coalesce(*within).isNotNull()
        marked = df.filter(hit).select(x.alias("v"), F.explode(F.array_compact(F.array(*within))).alias("k"))
        return lambda: marked.groupBy("k", "v").count().collect()

    out: dict = {key: [] for key in keys}
    for rows in together([job(n, slots) for n, slots in by_name.items()]):
        for k, v, n in rows:
            out[keys[k]].append((v, n))
    return {key: sorted(v) for key, v in out.items()}


def _order_statistic(counted: list[tuple[float, int]], rank: int) -> float:
    seen = 0
    for value, n in counted:
        seen += n
        if rank < seen:
            return value
    raise RuntimeError("order statistic lies outside its bracket")


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    from tidemill.functions.columns import present

    targets = {c: present(c, df.schema[c].dataType) for c in cols}
    return {c: v[0] for c, v in exact_quantiles(df, targets, [0.5]).items()}


def split_points(df: DataFrame, value: Column, buckets: int) -> list[float]:
    """At most ``buckets - 1`` increasing cut values that divide the rows about evenly."""
    if buckets < 2:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    accuracy = max(ACCURACY, 10 * buckets)
    return sorted(set(sketched(df, [value.cast("double")], [probs], accuracy)[3] or []))
