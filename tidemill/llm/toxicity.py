"""Toxicity scores from a factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), with x_i = 1 if some word of the
text has hash bucket i. The pairwise part weighs terms that are harmless alone, such as a mention of
a group beside a term that is only rude towards people.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemill.llm import words as w
from tidemill.llm.quality_model import fold
from tidemill.llm.tables import checkpointed, first_by_hash

#: Hash buckets of terms, buckets that the machine keeps as they differ between the classes by themselves, length of the
#: interaction vectors, most labelled rows it is fitted on, and passes over them.
BUCKETS, KEPT, RANK, FIT_ROWS, PASSES = 1 << 20, 2048, 4, 20_000, 40
#: Buckets whose pairs are tested, the most evenly spread ones; least texts of each of a pair's four cases; and the
#: standard errors by which a pair must differ from the sum of its terms for both to be kept as well.
PAIRED, LEAST_CASE, PAIR_ERRORS = 2048, 8, 6.0
MIN_TEXTS = 4
PREFIXES = (5, 6, 7)


@dataclass
class Machine:
    """``bucket`` sorted; ``weight`` and ``vector`` of each kept bucket."""

    bias: float
    bucket: np.ndarray
    weight: np.ndarray
    vector: np.ndarray

    def score(self, owner: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Probabilities for ``n`` texts; ``term`` is a kept bucket's place, once in each ``owner``."""
        linear = np.bincount(owner, self.weight[term], n) if len(owner) else np.zeros(n)
        pair = np.zeros(n)
        for f in range(self.vector.shape[1]):
            v = self.vector[term, f]
            s, q = np.bincount(owner, v, n), np.bincount(owner, v * v, n)
            pair += 0.5 * (s * s - q)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pair, -40, 40)))


def occurrences(texts: list[bytes | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every term: lower-cased runs of letters, digits and non-ASCII bytes, and
    their first 5, 6 and 7 bytes where they are longer, so that inflected forms share a term."""
    c = w.cut(texts, w.ALNUM, lower=True)
    mask = np.uint64(buckets - 1)
    owner, hashes = [c.owner], [w.word_hashes(c) & mask]
    for size in PREFIXES:
        longer = np.flatnonzero(c.end - c.start > size)
        stem = w.Chunk(c.data, c.bounds, c.start[longer], c.start[longer] + size, c.first)
        owner.append(owner[0][longer])
        hashes.append(w.mix(w.word_hashes(stem)) & mask)
    return np.concatenate(owner), np.concatenate(hashes).astype(np.int64)


def terms(texts: list[bytes | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, bucket) pairs, in order."""
    owner, bucket = occurrences(texts, buckets)
    both = np.unique(owner * buckets + bucket)
    return both // buckets, both % buckets


def informative(counts: DataFrame, texts: int, ones: int, kept: int = KEPT, least_difference: float = 2.0) -> list[int]:
    """The buckets of (bucket, n, ones) whose share differs most between the classes, in units of its
    standard error, beyond ``least_difference`` of them; in rising order."""
    n, k = F.col("n"), F.col("ones")
    pooled = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), n / texts))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / (ones + 1) + 1 / (texts - ones + 1)))
    z = F.abs((k + 0.5) / (ones + 1) - (n - k + 0.5) / (texts - ones + 1)) / spread
    found = counts.where(n >= MIN_TEXTS).withColumn("z", z).where(F.col("z") > least_difference)
    return sorted(r.bucket for r in found.orderBy(F.desc("z"), "bucket").limit(kept).collect())


def even(counts: DataFrame, texts: int, most: int = PAIRED) -> list[int]:
    """The buckets that are closest to standing in half of the texts, in rising order."""
    n = F.col("n")
    found = counts.where(n >= MIN_TEXTS).withColumn("v", n * (F.lit(texts) - n)).where(F.col("v") > 0)
    return sorted(r.bucket for r in found.orderBy(F.desc("v"), "bucket").limit(most).collect())


def interacting(owner: np.ndarray, bucket: np.ndarray, y: np.ndarray, names: np.ndarray, errors: float = PAIR_ERRORS) -> np.ndarray:
    """Those of the sorted buckets ``names`` that matter in a pair: the share of ones in texts with both terms, with one and
    with none does not add up, by more than ``errors`` standard errors."""
    n, m = len(y), len(names)
    if not n or not m:
        return names[:0]
    at = np.minimum(np.searchsorted(names, bucket), m - 1)
    ok = names[at] == bucket
    owner, at = owner[ok], at[ok]
    # Counts below 2 ** 24 are exact in 32 bits.
    both, ones = np.zeros((m, m), dtype=np.float32), np.zeros((m, m), dtype=np.float32)
    for a in range(0, n, 2000):
        x = np.zeros((min(2000, n - a), m), dtype=np.float32)
        here = (owner >= a) & (owner < a + 2000)
        x[owner[here] - a, at[here]] = 1
        both += x.T @ x
        ones += (x * y[a : a + 2000, None].astype(np.float32)).T @ x
    k, s = np.diag(both).astype(float), np.diag(ones).astype(float)
    share = (y.sum() + 0.5) / (n + 1)
    far = np.zeros(m, dtype=bool)
    for a in range(0, m, 128):  # a few terms against all others, so that the driver holds little more than the counts
        b, o, ka, sa = both[a : a + 128].astype(float), ones[a : a + 128].astype(float), k[a : a + 128, None], s[a : a + 128, None]
        cases = [(b, o), (ka - b, sa - o), (k[None] - b, s[None] - o), (n - ka - k[None] + b, y.sum() - sa - s[None] + o)]
        enough = np.min([c for c, _ in cases], axis=0) >= LEAST_CASE
        effect, inverse = np.zeros(b.shape), np.zeros(b.shape)
        for (c, o), sign in zip(cases, (1, -1, -1, 1)):
            c = np.maximum(c, 1)
            effect += sign * o / c
            inverse += 1 / c
        far[a : a + 128] = (enough & (np.abs(effect) > errors * np.sqrt(share * (1 - share) * inverse))).any(axis=1)
    return names[far]


def fit(owner: np.ndarray, bucket: np.ndarray, y: np.ndarray, names: np.ndarray, rank: int = RANK, passes: int = PASSES, rate: float = 0.05, ridge: float = 0.02, seed: int = 7) -> Machine:
    """Fit on texts ``0 .. len(y) - 1`` by Adam on the mean logistic loss, with the sorted buckets ``names``.

    With one class only, or no text, the score is constant.
    """
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1.0)
    bias = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Machine(bias, np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, rank)))
    own, term, top = owner, np.searchsorted(names, bucket), names
    rng = np.random.default_rng(seed)
    params = [np.array([bias]), np.zeros(len(top)), rng.normal(0, 0.05, (len(top), rank))]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    order = np.argsort(own, kind="stable")
    own, term = own[order], term[order]
    start = np.searchsorted(own, np.arange(n + 1))
    balance = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    step, size = 0, 256
    for _ in range(passes):
        mixed = rng.permutation(n)
        for lo in range(0, n, size):
            rows = mixed[lo : lo + size]
            count = start[rows + 1] - start[rows]
            local = np.repeat(np.arange(len(rows)), count)
            t = term[np.repeat(start[rows] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
            v = params[2][t]
            s = np.stack([np.bincount(local, v[:, f], len(rows)) for f in range(rank)], axis=1)
            q = np.stack([np.bincount(local, v[:, f] ** 2, len(rows)) for f in range(rank)], axis=1)
            raw = params[0][0] + np.bincount(local, params[1][t], len(rows)) + 0.5 * (s * s - q).sum(1)
            g = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[rows]) * balance[rows] / len(rows)
            gw = np.bincount(t, g[local], len(top)) + ridge * params[1] / n
            gv = np.stack([np.bincount(t, g[local] * (s[local, f] - v[:, f]), len(top)) for f in range(rank)], axis=1) + ridge * params[2] / n * 10
            step += 1
            for k, grad in enumerate((np.array([g.sum()]), gw, gv)):
                first[k] += 0.1 * (grad - first[k])
                second[k] += 0.001 * (grad * grad - second[k])
                params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(params[0][0]), names, params[1], params[2])


def score(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", parts: int = 5, held: int = 0, fit_rows: int = FIT_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``score`` and ``predicted``.

    Labels are read only of ids outside the held-out part; a null label is none, and an id labelled
    twice takes its larger label. Null and empty texts have no terms and get the score of the bias;
    without labels every score is one half. Repeated rows get equal scores; of rows that share an id one text
    is learned from. Whole texts are read, however long. The machine
    knows the ``KEPT`` terms that differ most between the classes and those of the ``PAIRED`` most even ones that matter in pairs.
    """
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    known = labels.select(labels[doc_id].alias("doc_id"), labels[label].cast("int").alias("label")).where("label is not null and doc_id is not null")
    known = known.where(fold(F.col("doc_id"), parts) != held).groupBy("doc_id").agg((F.max("label") > 0).cast("int").alias("label"))
    known = checkpointed(first_by_hash(known, "doc_id", fit_rows))

    # At most ``fit_rows`` labels, so the texts stay where they are; then one text an id, and only those are read again.
    sample = source.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = checkpointed(sample.select(F.xxhash64("doc_id").alias("lot"), "label", "text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ones = np.zeros(buckets + 1, dtype=np.int64), np.zeros(buckets + 1, dtype=np.int64)
        for part, texts in w.chunks(batches, "text"):
            y = part.column("label").to_numpy()
            owner, bucket = terms(texts, buckets)
            np.add.at(n, bucket, 1)
            np.add.at(ones, bucket[y[owner] > 0], 1)
            n[buckets] += len(y)
            ones[buckets] += int(y.sum())
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(ones[at])], names=["bucket", "n", "ones"])

    counts = checkpointed(sample.mapInArrow(tally, "bucket bigint, n bigint, ones bigint").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")))
    total = counts.where(F.col("bucket") == buckets).first()
    terms_of = counts.where(F.col("bucket") < buckets)
    alone = np.array(informative(terms_of, total.n, total.ones) if total else [], dtype=np.int64)
    tested = np.array(even(terms_of, total.n) if total else [], dtype=np.int64)
    names = np.union1d(alone, tested)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(buckets, dtype=bool)
        known[names] = True
        for part, texts in w.chunks(batches, "text"):
            owner, bucket = terms(texts, buckets)
            owner, bucket = owner[known[bucket]], bucket[known[bucket]]
            first = np.searchsorted(owner, np.arange(len(texts) + 1))
            own = pa.ListArray.from_arrays(pa.array(first, type=pa.int32()), pa.array(bucket, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("lot"), part.column("label"), own], names=["lot", "label", "terms"])

    rows = sample.mapInArrow(gather, "lot bigint, label int, terms array<int>").toArrow().sort_by("lot")
    lists = rows.column("terms").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) if len(rows) else np.zeros(0, dtype=np.int64)
    flat = lists.flatten().to_numpy() if len(rows) else np.zeros(0, dtype=np.int64)
    owner, flat, y = np.repeat(np.arange(len(rows)), sizes), flat.astype(np.int64), rows.column("label").to_numpy().astype(float)
    names = np.union1d(alone, interacting(owner, flat, y, tested))
    wanted = np.isin(flat, names)
    machine = fit(owner[wanted], flat[wanted], y, names)
    held_model = docs.sparkSession.sparkContext.broadcast(vars(machine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(**held_model.value)
        place = np.full(buckets, -1, dtype=np.int32)
        place[m.bucket] = np.arange(len(m.bucket))
        for part, texts in w.chunks(batches, "text"):
            owner, bucket = occurrences(texts, buckets)
            term = place[bucket]
            known = np.flatnonzero(term >= 0)
            width = max(1, len(m.bucket))
            both = np.unique(owner[known] * width + term[known])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(m.score(both // width, both % width, len(texts)))], names=["doc_id", "score"])

    kind = source.schema["doc_id"].dataType.simpleString()
    out = source.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
