"""Quality rules: plain limits first, then multivariate outliers by a robust estimate per language and source.

The statistic vector of a document is transformed so that its spread hardly depends on length, and
distances of short documents count less, as their shares vary by chance. For each group the minimum covariance determinant is approached by C-steps: from three robust starts,
take the share ``h`` of the documents with the smallest distances, estimate centre and covariance
from them, and repeat; the start with the smallest determinant wins. One reweighting step follows,
and documents whose squared Mahalanobis distance exceeds a chi-square bound are rejected.

Every step is an aggregate over the whole table by (group, start), so a group may hold any share of
the rows: only sums, products and quantile summaries are shuffled. Only d x d systems are solved in
Python, one small row per group and start.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemill.llm.stats import COUNTS, text_stats
from tidemill.llm.tables import checkpointed, keep_keys, with_document

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of a group that the estimate rests on, rows a group needs for an estimate of its own, C-steps.
SHARE, MIN_GROUP, STEPS = 0.75, 60, 3
#: A vector is rejected beyond this many times the 0.999 quantile of the chi-square distribution. Shares
#: in texts have much heavier tails than normal vectors, so a factor of 1 would reject ordinary texts.
TAIL_FACTOR = 6.0
#: Least spread of each transformed statistic: in a group that hardly varies, a difference below it is none.
FEATURES: dict[str, float] = {"word_length": 0.06, "symbols": 0.03, "repeats": 0.15, "dup_lines": 0.30, "capitals": 0.04, "punctuation": 0.04}
#: Words at which a document's own statistics weigh as much as chance: its squared distance counts n / (n + NOISE_WORDS).
NOISE_WORDS = 150
GROUP_ROWS, GROUPS_OF_A_TASK = 100_000, 20


def _arc(part: Column, whole: Column) -> Column:
    return F.asin(F.sqrt(F.least(F.lit(1.0), part / F.greatest(whole, F.lit(1)))))


def vector(df: DataFrame) -> dict[str, Column]:
    """The transformed statistics: log of the mean word length, arcsine roots of the shares."""
    c = F.col
    return {
        "word_length": F.log(c("word_chars") / F.greatest(c("n_words"), F.lit(1)) + 0.1),
        "symbols": _arc(c("n_symbols"), c("word_chars")),
        "repeats": _arc(c("n_repeat_words"), c("n_words")),
        "dup_lines": _arc(c("n_dup_lines"), c("n_lines")),
        "capitals": _arc(c("n_upper"), c("word_chars")),
        "punctuation": _arc(c("n_punct"), c("word_chars")),
    }


def chi_square(p: float, d: int) -> float:
    """Quantile of the chi-square distribution by the cube-root approximation of Wilson and Hilferty."""
    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * (2 / (9 * d)) ** 0.5) ** 3


def _few(small: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(small) if few else small


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"__{k}"]) for k in keys])


def _attach(df: DataFrame, small: DataFrame, keys: Sequence[str], few: bool) -> DataFrame:
    """``df`` with the columns of ``small``, one or a few rows for each key; null keys match."""
    right = _few(small.withColumnsRenamed({k: f"__{k}" for k in keys}), few)
    return df.join(right, _same(df, right, keys)).drop(*[f"__{k}" for k in keys])


def _distance(names: Sequence[str]) -> Column:
    d = len(names)
    x = [F.col(n) - F.col("mu")[i] for i, n in enumerate(names)]
    return F.col("weight") * reduce(lambda a, b: a + b, [F.col("precision")[i * d + j] * x[i] * x[j] * (1.0 if i == j else 2.0) for i in range(d) for j in range(i, d)])


def _moments(values: Sequence[Column]) -> list[Column]:
    d = len(values)
    return [F.count("*").alias("n")] + [F.sum(v).alias(f"s{i}") for i, v in enumerate(values)] + [
        F.sum(values[i] * values[j]).alias(f"s{i}_{j}") for i in range(d) for j in range(i, d)]


def _solved(moments: DataFrame, keys: list[str], floors: list[float], scales: bool, tasks: int) -> DataFrame:
    """Centre, inverse covariance and log determinant for each row of sums, in ``tasks`` tasks.

    With ``scales`` the sums are of bounded scores, of which only the correlations are used, and
    ``mid`` and ``scale`` of the row give centre and spread.
    """
    d, floor = len(floors), np.array(floors) ** 2
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moments.select(*keys).schema.fields)
    lists = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(float)
            n = np.maximum(1.0, column("n"))
            means = np.stack([column(f"s{i}") / n for i in range(d)], axis=1)
            products = {(i, j): column(f"s{i}_{j}") / n for i in range(d) for j in range(i, d)}
            mus, precisions, dets = [], [], []
            for r in range(batch.num_rows):
                mean, cov = means[r], np.zeros((d, d))
                for (i, j), v in products.items():
                    cov[i, j] = cov[j, i] = v[r] - mean[i] * mean[j]
                if scales:
                    spread = np.array(batch.column("scale")[r].as_py())
                    own = np.sqrt(np.maximum(np.diag(cov), 1e-12))
                    shape = np.clip(cov / np.outer(own, own), -0.95, 0.95)
                    np.fill_diagonal(shape, 1.0)
                    low, axes = np.linalg.eigh(shape)
                    shape = axes @ np.diag(np.maximum(low, 0.05)) @ axes.T
                    mean, cov = np.array(batch.column("mid")[r].as_py()), shape * np.outer(spread, spread)
                cov = cov + np.diag(floor)
                mus.append(mean.tolist())
                precisions.append(np.linalg.inv(cov).ravel().tolist())
                dets.append(float(np.linalg.slogdet(cov)[1]))
            found = [pa.array(mus, type=lists), pa.array(precisions, type=lists), pa.array(dets, type=pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + found, names=[*keys, "mu", "precision", "det"])

    # Shuffled by group before; these are few rows in many partitions.
    return moments.coalesce(tasks).mapInArrow(run, f"{kinds}, mu array<double>, precision array<double>, det double")


def estimate(rows: DataFrame, keys: list[str], names: list[str], floors: list[float], few: bool, tasks: int = 1, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Robust centre ``mu``, inverse covariance ``precision`` and distance scale ``scale`` of each group.

    ``rows`` is read once for each step, so it should be a stored table. ``few`` says that the groups
    were counted and may be sent to every task; their tables are written by ``tasks`` tasks.
    """
    d = len(names)
    stored = lambda table: checkpointed(table.coalesce(tasks))
    mid = rows.groupBy(*keys).agg(*[F.percentile_approx(n, 0.5, 1000).alias(f"m{i}") for i, n in enumerate(names)])
    mid = stored(mid.select(*keys, F.array(*[f"m{i}" for i in range(d)]).alias("mid")))
    off = _attach(rows, mid, keys, few).groupBy(*keys, "mid").agg(*[F.percentile_approx(F.abs(F.col(n) - F.col("mid")[i]), 0.5, 1000).alias(f"m{i}") for i, n in enumerate(names)])
    scale = stored(off.select(*keys, "mid", F.array(*[F.greatest(F.col(f"m{i}") * 1.4826, F.lit(floors[i])) for i in range(d)]).alias("scale")))
    at = _attach(rows, scale, keys, few)
    z = [(F.col(n) - F.col("mid")[i]) / F.col("scale")[i] for i, n in enumerate(names)]
    length = F.sqrt(reduce(lambda a, b: a + b, [v * v for v in z])) + 1e-9
    starts = F.array(*[F.struct(F.lit(k).alias("start"), *[v.alias(f"z{i}") for i, v in enumerate(vs)]) for k, vs in
                       enumerate([[F.tanh(v) for v in z], [v / length for v in z], [F.lit(0.0) for _ in z]])])
    scored = at.select(*keys, "mid", "scale", F.inline(starts))
    state = stored(_solved(scored.groupBy(*keys, "start", "mid", "scale").agg(*_moments([F.col(f"z{i}") for i in range(d)])), [*keys, "start"], floors, True, tasks))
    values, both = [F.col(n) for n in names], [*keys, "start"]
    for _ in range(steps):
        near = _attach(rows, state, keys, few).select(*both, *names, _distance(names).alias("d2"))
        bound = near.groupBy(*both).agg(F.percentile_approx("d2", share, 1000).alias("bound"))
        inner = _attach(near, bound, both, few).where("d2 <= bound")
        state = stored(_solved(inner.groupBy(*both).agg(*_moments(values)), both, floors, False, tasks))
    best = state.groupBy(*keys).agg(F.min(F.struct("det", "start", "mu", "precision")).alias("b")).select(*keys, "b.mu", "b.precision")

    def scaled(model: DataFrame) -> DataFrame:
        d2 = _attach(rows, model, keys, few).select(*keys, _distance(names).alias("d2"))
        middle = d2.groupBy(*keys).agg((F.percentile_approx("d2", 0.5, 1000) / chi_square(0.5, d)).alias("scale"))
        return stored(_attach(model, middle.withColumn("scale", F.greatest("scale", F.lit(1e-6))), keys, few))

    raw = scaled(stored(best))
    inner = _attach(rows, raw, keys, few).where(_distance(names) <= F.col("scale") * chi_square(0.975, d))
    return scaled(stored(_solved(inner.groupBy(*keys).agg(*_moments(values)), keys, floors, False, tasks)))


def assess(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", groups: Sequence[str] = ("lang", "source"), min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT, share: float = SHARE, min_group: int = MIN_GROUP, tail_factor: float = TAIL_FACTOR,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the counts, ``base_failed``, ``distance`` and ``kept``.

    Null and empty texts have no words and fail the base rules. A group with fewer than ``min_group``
    passing rows is estimated together with the other small groups that share its first group column,
    and those with too few again together with all such; if even they are too few, the base rules
    decide and ``distance`` is null. Null group values form groups of their own.
    """
    g = [f"g{i}" for i in range(len(groups))]
    table = text_stats(docs, [doc_id, *groups], text, extra=True).withColumnsRenamed({"k0": "doc_id"} | {f"k{i + 1}": x for i, x in enumerate(g)})
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    names, floors = list(FEATURES), list(FEATURES.values())
    values = vector(table)
    table = checkpointed(table.select("doc_id", *g, *COUNTS, failed.alias("base_failed"), (F.col("n_words") / (F.col("n_words") + F.lit(NOISE_WORDS))).alias("weight"), *[values[n].alias(n) for n in names]))
    passed = table.where(~F.col("base_failed"))

    sizes = passed.groupBy(*g).agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < min_group)
    pools = small.groupBy(g[0]).agg(F.sum("n").alias("pool")).withColumnRenamed(g[0], "__p")
    sizes = sizes.join(pools, F.col(g[0]).eqNullSafe(F.col("__p")), "left")
    level = F.when(F.col("n") >= min_group, 2).when(F.col("pool") >= min_group, 1).otherwise(0)
    assign = checkpointed(sizes.select(*g, level.alias("level")).select(
        *g, "level", *[F.when(F.col("level") >= (1 if i == 0 else 2), F.col(x)).alias(f"m_{x}") for i, x in enumerate(g)]))
    groups = assign.count()
    few, tasks = groups <= GROUP_ROWS, 1 + groups // GROUPS_OF_A_TASK
    keys = ["level", *[f"m_{x}" for x in g]]
    rows = _attach(passed, assign, g, few).select(*keys, "weight", *names)
    counted = rows.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") >= min_group).drop("rows")
    rows = checkpointed(_attach(rows, checkpointed(counted.coalesce(tasks)), keys, few))
    model = estimate(rows, keys, names, floors, few, tasks, share)

    known = assign.withColumnsRenamed({k: f"__{k}" for k in keys})
    model = model.select(*keys, "mu", "precision", "scale")
    found = known.join(model, reduce(lambda a, b: a & b, [known[f"__{k}"].eqNullSafe(model[k]) for k in keys]), "left").select(*[known[x].alias(f"__{x}") for x in g], "mu", "precision", "scale")
    right = _few(checkpointed(found.coalesce(tasks)), few)
    out = table.join(right, reduce(lambda a, b: a & b, [table[x].eqNullSafe(right[f"__{x}"]) for x in g]), "left")
    distance = F.when(~F.col("base_failed"), _distance(names) / F.col("scale"))
    limit = tail_factor * chi_square(0.999, len(names))
    return out.select("doc_id", *COUNTS, "base_failed", distance.alias("distance")).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without rejected documents. Rows that share an id stay if one of them is kept; a row without an id goes by its text."""
    known = with_document(docs, options.pop("doc_id", "doc_id"), options.get("text", "text"))
    kept = assess(known, doc_id="__document", **options).where("kept").select(F.col("doc_id").alias("__document")).distinct()
    return keep_keys(known, checkpointed(kept), "__document").select(*docs.columns)
