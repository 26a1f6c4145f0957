"""Periodic runs, mixing and hard negatives against plain versions, with nulls, ties, repeats, empty tables and clashing names."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemill.llm import hard_negatives, mixing, runs, words as w


def plain_runs(words, least=6):
    """Period by period: stretches in which words ``q`` apart are identical; the smallest period of each stays."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def runs_of(*texts):
    return runs.text_runs(w.cut([t if t is None else t.encode() for t in texts], w.SPACED, False))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(0, 59), st.integers(1, 12))
def test_runs_equal_plain_ones(numbers, start, period):
    tail = [numbers[start + (i - start) % period] if start < i and start + period <= len(numbers) else x for i, x in enumerate(numbers)]
    for own in (numbers, tail):
        words = [str(x) for x in own]
        assert runs_of(" ".join(words))[0] == plain_runs(words)


def test_runs_of_long_periods_nested_runs_and_neighbouring_texts():
    rng = random.Random(3)
    base = [str(rng.randrange(50)) for _ in range(300)]
    unit = ["a", "b"] * 5 + ["c"]
    texts = [base * 4, base * 3, unit * 6, ["x"] * 1000, ["x"] * 5, base[:20] * 4 + base[:19]]
    assert runs_of(*[" ".join(t) for t in texts]) == [plain_runs(t) for t in texts]
    assert runs_of("x x x", "x x x") == [[], []]


def test_grammar_derives_the_sequence():
    rng = random.Random(5)
    for _ in range(50):
        ids = [rng.randrange(3) for _ in range(rng.randint(0, 200))]
        rules, rest = runs.re_pair(ids)
        assert [s for s, _ in rest] == np.concatenate([[0], np.cumsum([n for _, n in rest])])[: len(rest)].astype(int).tolist()
        assert sum(n for _, n in rest) == len(ids)
        for left, size, places in rules:
            assert len(places) > 1 and 0 < left < size
            assert len({tuple(ids[a : a + size]) for a in places}) == 1


def test_find_runs_over_a_table(spark):
    rows = [(1, "Say it say it " + "go on " * 4 + "now", 1), (2, None, 1), (3, "", 1), (None, "a a a a a a", 1), (4, "x y " * 20_000, 1), (1, "Say it say it " + "go on " * 4 + "now", 1), (5, "\n".join(["ho ho"] * 3), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long")
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find_runs(docs).collect())
    once = (1, 13, [(4, 8, 2)], "Say it say it go on now")
    assert got == sorted([once, once, (2, 0, [], ""), (3, 0, [], ""), (0, 6, [(0, 6, 1)], "a"), (4, 40_000, [(0, 40_000, 2)], "x y"), (5, 6, [(0, 6, 1)], "ho")])
    assert runs.find_runs(docs.where("doc_id = 77")).collect() == []


def plain_targets(sizes, weights=(5, 2, 1)):
    """{source: target}; sources in code point order, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        words, share = total - 3 * sum(sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and 3 * sizes[s] * share < words * weight[s]}
        if not more:
            return {s: float(3 * sizes[s]) if s in full else words * weight[s] / max(1, share) for s in order}
        full |= more


def check_mix(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, target double, number long")
    got = mixing.mix(docs).collect()
    size = lambda t: len(t.split()) if t else 0
    assert sorted((str(r.doc_id), str(r.source), r["size"]) for r in got) == sorted((str(r[0]), str(r[2]), size(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += size(r[1])
    wanted = plain_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == wanted[r.source]
        assert r.taken in range(3 * r["size"] + 1)
        # All documents are taken as often as whole epochs fit; a source has one part, besides whole documents.
        assert r["size"] == 0 or r.taken // r["size"] - int(wanted[r.source] + 0.5) // r.source_size in (0, 1)
    assert taken == {s: int(t + 0.5) for s, t in wanted.items()} or not rows
    parts = [r.source for r in got if r["size"] and r.taken % r["size"]]
    assert len(parts) == len(set(parts))
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    return got


def test_mix_against_plain_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "B", "é", "src10", "src2", ""]), None, None, 1) for i in range(300)]
    rows += [(1000 + i, "x y z", None, None, None, 1) for i in range(7)] + [(None, "no id", "a", 1, 1.0, 1)] * 3 + [(5, None, "none", 1, 1.0, 1), (5, "", "none", 1, 1.0, 1), rows[0]]
    rows += [(2000, "long " * 50_000, "z", 1, 1.0, 1)]
    check_mix(spark, rows)


@pytest.mark.parametrize("rows", [[], [(1, None, "a", 1, 1.0, 1), (2, "", None, 1, 1.0, 1)], [(1, "a b c", None, 1, 1.0, 1)], [(7, "one two", "s", 1, 1.0, 1)] * 40])
def test_mix_of_few_rows(spark, rows):
    check_mix(spark, rows)


def test_mix_shares_again_after_each_stop(spark):
    sizes = {"a": 1, "b": 2, "c": 40, "d": 3, "e": 300, "f": 1000}
    check_mix(spark, [(i, "w " * n, s, 1, 1.0, 1) for i, (s, n) in enumerate(sizes.items())])


def plain_negatives(rows, anchor, positives=5, negatives=10):
    part = []
    for vec_id, vector, label in rows:
        if label is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector):
            part.append((vec_id, [int(np.floor(256 * float(x))) for x in vector], label))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out, seen = [], set()
    for a, va, la in part:
        if a is None or not anchor(a) or (a, tuple(va), la) in seen:
            continue
        seen.add((a, tuple(va), la))
        scored = [(sum(x * y for x, y in zip(va, v)), i, k) for i, v, k in part]
        for p in sorted([s for s in scored if s[2] == la and s[1] != a], key=order)[:positives]:
            fit = [s for s in scored if s[2] != la and 30 * p[0] <= 100 * s[0] <= 90 * p[0]]
            out += [(a, p[1], r, s[1], p[0], s[0]) for r, s in enumerate(sorted(fit, key=order)[:negatives], 1)]
    return sorted(out, key=str)


def mined(frame, every=10, **options):
    return sorted([tuple(r) for r in hard_negatives.mine(frame, F.col("id") % every == 0, **options).collect()], key=str)


VECTORS = "vec_id long, embedding array<float>, label int, id string, score long"


def vector_rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 0.1, (5, 20))
    rows = []
    for i in range(700):
        label = int(rng.integers(5))
        rows.append((i, np.float32(centres[(label + i % 2) % 5] + rng.normal(0, 0.05, 20)).tolist(), label))
    rows += [(700 + i, rows[3][1], 1 + i % 2) for i in range(60)] + [rows[10]] * 2 + [rows[21]] * 12
    rows += [(None, rows[5][1], 2), (None, rows[6][1], 3), (900, None, 1), (910, rows[1][1], None), (920, [None] + rows[1][1][1:], 1), (930, [float("nan")] * 20, 1), (940, [float("inf")] * 20, 1), (950, [], 1), (960, rows[2][1][:7], 1), (970, [0.0] * 20, 0)]
    return rows


def test_hard_negatives_equal_plain_ones(spark):
    rows = vector_rows()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    wanted = plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(wanted) > 1000
    assert mined(frame) == wanted
    # Several blocks and other partitions change nothing.
    assert mined(frame.repartition(7), block_anchors=20) == wanted


def test_hard_negatives_of_few_or_large_rows(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert mined(empty) == []
    assert mined(spark.createDataFrame([(10, [0.5], 1, "x", 1), (11, None, 1, "x", 1)], VECTORS)) == []
    rows = [(i, [float(5_000_000 + 3 * i), float(i)], i % 3) for i in range(40)]
    assert mined(spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_segment_bounds_hold_and_filter():
    rng = np.random.default_rng(9)
    a, b = np.floor(256 * (rng.normal(0.3, 0.05, (30, 50)) + rng.normal(0, 0.5, (30, 1)))), np.floor(256 * rng.normal(0.3, 0.05, (200, 50)))
    filtered = hard_negatives.Filter(a, hard_negatives.summaries(a))
    exact = b @ a.T
    low, high = np.quantile(exact, 0.9, axis=0).astype(int), np.quantile(exact, 0.95, axis=0).astype(int)
    i, j, s = filtered.pairs(b, hard_negatives.summaries(b), np.ones(exact.shape, dtype=bool), low, high)
    assert sorted(zip(i, j, s)) == sorted((x, y, exact[x, y]) for x, y in zip(*np.nonzero((exact >= low) & (exact <= high))))
    assert filtered.scored < exact.size / 2


def test_rows_without_an_id_go_by_their_texts(spark):
    from tidemill.llm import decontaminate, quality_rules

    item = "what is the capital of the great river country in the north today"
    clean, dirty = "nothing of the kind stands in this text at all my friend", f"well {item} he asked"
    docs = spark.createDataFrame([(None, clean), (None, dirty), (1, clean), (2, dirty), (2, clean)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, items)
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(None, clean), (1, clean)], key=str) and left.columns == docs.columns
    good = " ".join(f"word{i} and{i}" for i in range(60))
    docs = spark.createDataFrame([(None, good), (None, "too short"), (3, good)], "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source")
    assert sorted((r.doc_id is None, r.text) for r in quality_rules.keep_good(docs).collect()) == [(False, good), (True, good)]


def test_every_stage_takes_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_moments_give_the_plain_determinant_estimate(spark):
    """One group against C-steps in numpy, with exact quantiles in place of sketches (equal up to their error)."""
    from tidemill.llm import quality_rules as q

    rng = np.random.default_rng(6)
    x = np.vstack([rng.multivariate_normal([1, 2], [[1, 0.6], [0.6, 1]], 900), rng.normal(9, 0.2, (100, 2))])
    floors = [0.01, 0.01]
    rows = spark.createDataFrame([(1, 1.0, float(a), float(b)) for a, b in x], "g long, weight double, a double, b double")
    model = q.estimate(rows, ["g"], ["a", "b"], floors, True).first()
    mid = np.median(x, axis=0)
    scale = np.maximum(np.median(np.abs(x - mid), axis=0) * 1.4826, floors)
    z = (x - mid) / scale
    best = None
    for start in (np.tanh(z), z / (np.linalg.norm(z, axis=1)[:, None] + 1e-9), np.zeros_like(z)):
        spread = start.var(axis=0)
        shape = np.clip(np.cov(start.T, bias=True) / np.outer(np.sqrt(np.maximum(spread, 1e-12)), np.sqrt(np.maximum(spread, 1e-12))), -0.95, 0.95)
        np.fill_diagonal(shape, 1)
        mean, cov = mid, shape * np.outer(scale, scale) + np.diag(np.array(floors) ** 2)
        for _ in range(q.STEPS):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            inner = x[d <= np.quantile(d, q.SHARE, method="inverted_cdf")]
            mean, cov = inner.mean(axis=0), np.cov(inner.T, bias=True) + np.diag(np.array(floors) ** 2)
        if best is None or np.linalg.slogdet(cov)[1] < best[0]:
            best = (np.linalg.slogdet(cov)[1], mean, cov)
    scale_of = lambda mean, cov: np.median(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)) / q.chi_square(0.5, 2)
    d = np.einsum("ij,jk,ik->i", x - best[1], np.linalg.inv(best[2]), x - best[1])
    inner = x[d <= scale_of(*best[1:]) * q.chi_square(0.975, 2)]
    mean, cov = inner.mean(axis=0), np.cov(inner.T, bias=True) + np.diag(np.array(floors) ** 2)
    assert model.mu == pytest.approx(mean, abs=0.02)
    assert np.reshape(model.precision, (2, 2)) == pytest.approx(np.linalg.inv(cov), rel=0.05, abs=0.02)
    # The planted tenth is far outside, the others are not.
    far = np.einsum("ij,jk,ik->i", x - model.mu, np.reshape(model.precision, (2, 2)), x - model.mu) / model.scale
    assert far[900:].min() > 3 * q.chi_square(0.999, 2) and np.mean(far[:900] < q.chi_square(0.999, 2)) > 0.98


def pair_texts(n, seed):
    """Label 1: both words or neither. Neither word says anything alone."""
    rng = random.Random(seed)
    filler = [f"filler{i}" for i in range(200)]
    rows = []
    for i in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.sample(filler, 10) + ["insult"] * a + ["group"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a == b)))
    return rows


def test_toxicity_learns_a_pair_from_texts(spark):
    from tidemill.llm import toxicity

    rows = pair_texts(2000, 3)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score(docs, known).collect()}
    held = [(found[i].predicted, label) for i, _, label in rows if found[i].held_out]
    assert len(held) > 300 and np.mean([p == label for p, label in held]) > 0.9


def test_machine_scores_equal_the_plain_sum_over_pairs():
    from tidemill.llm import toxicity

    rng = np.random.default_rng(3)
    m = toxicity.Machine(0.3, np.arange(9), rng.normal(size=9), rng.normal(size=(9, 4)))
    texts = [sorted(rng.choice(9, k, replace=False).tolist()) for k in (0, 1, 2, 5, 9)]
    got = m.score(np.repeat(np.arange(5), [len(t) for t in texts]), np.array(sum(texts, []), dtype=int), 5)
    for t, p in zip(texts, got):
        raw = 0.3 + sum(m.weight[i] for i in t) + sum(m.vector[i] @ m.vector[j] for i in t for j in t if i < j)
        assert p == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-12)


def test_interacting_terms_are_those_of_plain_contingency_tables():
    from tidemill.llm import toxicity

    rng = np.random.default_rng(8)
    x = rng.random((600, 12)) < 0.4
    y = ((x[:, 2] ^ x[:, 5]) & (rng.random(600) < 0.9)).astype(float)
    owner, bucket = np.nonzero(x)
    got = set(toxicity.interacting(owner, bucket, y, np.arange(12)).tolist())
    want, share = set(), (y.sum() + 0.5) / 601
    for i in range(12):
        for j in range(12):
            cells = [y[(x[:, i] == a) & (x[:, j] == b)] for a in (True, False) for b in (True, False)]
            if i != j and min(map(len, cells)) >= toxicity.LEAST_CASE:
                effect = cells[0].mean() - cells[1].mean() - cells[2].mean() + cells[3].mean()
                if abs(effect) > toxicity.PAIR_ERRORS * np.sqrt(share * (1 - share) * sum(1 / len(c) for c in cells)):
                    want |= {i, j}
    assert got == want >= {2, 5}
