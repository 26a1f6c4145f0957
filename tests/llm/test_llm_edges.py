"""Null columns, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import boosting, chat, decontaminate, jaccard, licenses, line_templates, packing, quality_model, quality_rules, stats, toxicity, url_filter
from tidemill.llm.components import components
from tidemill.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, node string, spans string"
WORDS = "the of and to in stone river cloud seven apple green table under walk quickly märchen été niño über".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", "", ","])) for _ in range(n))


def documents():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        text = "\n".join(prose(100 * i + j, rng.randint(8, 40)) for j in range(3))
        rows.append((i, text, "en" if i % 3 else None, f"s{i % 2}", len(text), 1, 0.5, "x", "y"))
    base = prose(7, 200)
    rows += [(100 + i, base, "en", "s0", 1, None, None, None, None) for i in range(4)]
    rows += [(110 + i, base.replace("stone", f"stone{i}", 1), "en", "s0", 1, None, None, None, None) for i in range(4)]
    rows += [(200, None, None, None, None, None, None, None, None), (201, "", "en", "s0", 0, 0, 0.0, "", ""), (202, " \n\t ", "en", "s0", 4, 0, 0.0, "", "")]
    rows += [(203, prose(9, 30_000), "en", "s1", 1, 1, 1.0, "", ""), (204, "x" * 5000, "en", "s1", 5000, 1, 1.0, "", ""), (205, "one two", "en", "s1", 7, 2, 1.0, "", "")]
    rows += [rows[0], (None, "no id here at all", "en", "s0", 5, 1, 1.0, "", ""), (206, "#### || $$$ %%% " * 40, "en", "s0", 5, 1, 1.0, "", "")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


ITEMS = "item_id long, text string"


def test_statistics_equal_plain_python():
    alphabet = "ab cdé\n\t#*|ABéß日 1 2.,!\x0b\x1c"
    rng = random.Random(1)
    texts = [None, "", *["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 50, 400]))) for _ in range(120)], "x" * 5000 + " y" * 3]
    found = stats.measure([t if t is None else t.encode() for t in texts], True)
    for i, t in enumerate(t or "" for t in texts):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(ws[j : j + 3]) for j in range(len(ws) - 2)]
        seen = Counter(grams)
        covered = {j + o for j, g in enumerate(grams) if seen[g] > 1 for o in range(3)}
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(set(ws)), len(t))
        assert want == tuple(int(found[n][i]) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_chars"))


def test_every_operator_takes_empty_tables(spark, empty):
    none = labels(spark, [])
    items = spark.createDataFrame([], ITEMS)
    for out in (licenses.scan(empty), jaccard.classes(empty), quality_rules.assess(empty), quality_model.score(empty, none), packing.pack(empty, tokenizer()), toxicity.score(empty, none),
                decontaminate.find_passages(empty, items), line_templates.drop_recurring(empty), url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string"), [])):
        assert out.count() == 0
    chains = chat.chains(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), "conv_id", "turn", "role", "text")
    assert chat.read_back(chat.format_paths(chat.best_paths(chains))).count() == 0


def test_every_operator_returns_a_row_per_document(spark, docs):
    n = docs.count()
    known = labels(spark, [(i, i % 2, (i // 2) % 2) for i in range(60)] + [(None, 1, 1), (3, None, None)])
    for out in (licenses.scan(docs), jaccard.classes(docs), quality_rules.assess(docs), quality_model.score(docs, known), toxicity.score(docs, known), line_templates.drop_recurring(docs),
                decontaminate.find_passages(docs, spark.createDataFrame([(1, "stone river")], ITEMS))):
        assert out.count() == n


def test_near_duplicates_equal_brute_force(spark, docs):
    def shingles(t, k):
        ws = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())

    rng = random.Random(11)
    rows, base = [], [rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(120)]
    for i in range(150):  # a drifting family of copies, beyond what one bucket works off pair by pair
        base = list(base)
        for _ in range(rng.randint(0, 2)):
            base[rng.randrange(len(base))] = f"w{rng.randint(0, 999)}"
        rows.append((1000 + i, " ".join(base)))
    rows += [(r[0], r[1]) for r in documents() if r[0] is not None]
    for k, num in ((4, 85), (5, 80)):
        sets = [(d, shingles(t, k)) for d, t in rows]
        parent = {d: d for d, _ in rows}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, (d, s) in enumerate(sets):
            for e, t in sets[:i]:
                if s and t and 100 * len(s & t) >= num * len(s | t):
                    a, b = sorted((find(d), find(e)))
                    parent[b] = a
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), k, num, 100).collect()}
        assert got == {(d, len(s), find(d)) for d, s in sets}


def test_components_of_chain_star_and_loop(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 5), (300, 299), (300, 299)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {200: 200, 299: 299, 300: 299}
    assert found == want


def test_quality_rules_reject_a_planted_outlier(spark):
    rng = random.Random(3)
    rows = [(i, ". ".join(prose(1000 * i + j, 20) for j in range(rng.randint(4, 9))), "en", "a") for i in range(150)]
    rows += [(900, " ".join(f"{w}$$$" for w in prose(1, 100).split()), "en", "a"), (901, prose(2, 100).upper().replace(" ", "!! "), "en", "tiny")]
    out = {r.doc_id: r for r in quality_rules.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not out[900].kept and not out[900].base_failed
    assert sum(out[i].kept for i in range(150)) >= 148
    kept = quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert kept.columns == ["doc_id", "text", "lang", "source"] and kept.where("doc_id = 900").count() == 0


def test_boosting_learns_an_interaction_and_walks_like_plain_trees():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = boosting.grow(x[:2000], y[:2000])
    assert np.mean((trees.score(x[2000:]) >= 0.5) == y[2000:]) > 0.95

    def walk(row):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], trees.score(x[:50]))
    assert np.allclose(boosting.grow(x[:0], y[:0]).score(x[:3]), 0.5)


def test_factorization_machine_learns_a_pair_that_no_weight_explains():
    rng = np.random.default_rng(1)
    rows = rng.random((3000, 12)) < 0.5
    y = (rows[:, 0] == rows[:, 1]).astype(float)
    rows = np.concatenate([rows, rng.random((3000, 3)) < 0.3, (y > 0)[:, None] & (rng.random((3000, 1)) < 0.05)], axis=1)
    owner, bucket = np.nonzero(rows)
    # All buckets are offered: the pair is in no single one.
    import tidemill.llm.toxicity as t

    machine = t.fit(owner, bucket, y, np.unique(bucket), passes=60)
    p = machine.score(owner, np.searchsorted(machine.bucket, bucket), len(y))
    assert np.mean((p >= 0.5) == y) > 0.9
    pairs = 0.5 * (sum(machine.vector[:2]) ** 2 - sum(machine.vector[:2] ** 2)).sum()
    assert abs(pairs) > 0.5


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, known = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    for out, label, least in ((quality_model.score(docs, known), "quality", 0.95), (toxicity.score(docs, known), "toxic", 0.9)):
        rows = out.where("held_out").join(known, "doc_id").select("predicted", label).collect()
        assert sum(r[0] == r[1] for r in rows) >= least * len(rows)
        assert out.where("score < 0 or score > 1 or score is null").count() == 0


def test_packing_is_an_exact_partition_of_the_ids(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer())
    pieces = packing.pack(docs, tokenizer(), capacity=256, block_tokens=3000).collect()
    want = Counter()
    for r in documents():
        want[(r[0], np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes())] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for (d, ids), n in want.items():
        total = b"".join(p.ids for p in sorted(by_doc[d], key=lambda p: (p.start, p.sequence_id))) if n == 1 and sum(k[0] == d for k in want) == 1 else None
        assert total is None or total == ids
        assert sum(p.length for p in by_doc[d]) == sum(len(i) // 4 * m for (e, i), m in want.items() if e == d)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
        size = sum(p.length for p in own)
        assert size == 256 or size & (size - 1) == 0


def test_fillings_are_the_closest_and_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    rng = random.Random(3)
    for _ in range(200):
        count = {rng.randint(1, 60): rng.randint(1, 3) for _ in range(rng.randint(1, 8))}
        target = rng.randint(1, 120)
        taken = packing.filling(sorted(count), count, target)
        reach = {0}
        for length, c in count.items():
            for _ in range(c):
                reach |= {x + length for x in reach}
        assert sum(a * b for a, b in taken) == max(x for x in reach if x <= target)
        assert all(b <= count[a] for a, b in taken)
    texts = ["a <|endoftext|> b<|endoftext|>c Σ ΑΣ", "e\u0301x \u0301y z\x1cq \x85 \u2003x\x00", " 's don't I'll ''s a'\"'sx 'SAMPLE É're ÀB3c4 ''\"'''t ~!@# ___ a_b ª º", ""]
    tok = Tokenizer.from_file(tokenizer())
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.WordTokens(tokenizer()).encode([t.encode() for t in texts])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_passages_in_blocks_equal_one_block(spark, docs):
    texts = [r[1] for r in documents()[:8]]
    items = spark.createDataFrame([(i, " ".join(t.split()[5 + i : 25 + i])) for i, t in enumerate(texts)] + [(50, "apple"), (51, None), (52, ""), (None, "stone"), (0, " ".join(texts[0].split()[5:25]))], ITEMS)
    one = {(r.doc_id, r.n_words, str(r.spans), tuple(sorted(r["items"]))) for r in decontaminate.find_passages(docs, items).collect()}
    many = {(r.doc_id, r.n_words, str(r.spans), tuple(sorted(r["items"]))) for r in decontaminate.find_passages(docs, items, block_bytes=200).collect()}
    assert one == many and any(len(x[3]) > 1 for x in one)
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and left.where("doc_id = 1").count() == 0 and left.where("doc_id is null").count() == 1


def test_reply_trees_choose_the_best_branch(spark):
    rows = [("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "thanks", 0.8), ("t", 5, 2, "user", "hm", 0.0),
            ("u", 1, 99, "user", "orphan", None), ("u", 1, 99, "user", "orphan", None), ("c", 1, 2, "user", "cycle", 1.0), ("c", 2, 1, "user", "cycle", 1.0), (None, 7, None, None, None, 1.0)]
    rows += [("long", i, i - 1 if i else None, "assistant" if i % 2 else "user", f"m{i}", 1.0) for i in range(70)]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    paths = defaultdict(list)
    for r in chat.best_paths(messages).orderBy("depth").collect():
        paths[r.tree].append(r.node)
    assert paths == {"t": [1, 3, 4], "u": [1], None: [7], "long": list(range(70))}
    both = chat.best_paths(messages.where("tree = 't'"), keep=2)
    assert both.count() == 6
    back = {r.tree: r for r in chat.read_back(chat.format_paths(chat.best_paths(messages))).collect()}
    assert back["t"].turns == "user\nq\nassistant\ngood\nuser\nthanks\n" and back["t"].masked == "good" and back["long"].n_turns == 70


@pytest.mark.parametrize("text", ["", "\\", "</s>[INST] ok [/INST]", "<|te<|text|>xt|>", "\\<|end|>\\\\", "<", "a<|turn|>b<|end|>", "<|end|"])
def test_template_reads_back(text):
    turns = [(text, text), ("assistant", text), ("user", "x")]
    made = chat.format_turns(turns)
    assert chat.read_turns(made.text) == turns
    assert "".join(chat.unescape(made.text[a:b]) for a, b in made.spans) == text * (1 + (text == "assistant"))


def test_url_blocks_reach_aliases_but_not_allowed_pages(spark):
    link = '<html><head><link rel="canonical" href="{}"></head>'
    rows = [(1, "http://bad.net/x", ""), (2, "http://a.org/1", link.format("http://bad.net/x#top")), (3, "https://ok.org/2/", link.format("//A.org/1")), (4, "http://b.org/9", '<meta http-equiv="refresh" content="0; url=/8">'),
            (5, "http://b.org/8?q=1&w", None), (6, None, None), (7, "nothing", "<b>"), (8, "HTTP://A.ORG/1/", ""), (9, "x://e.com", link.format(""))]
    rules = [("block", "bad.net", "/"), ("allow", "ok.org", "/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "allow"}
    assert got[8][:3] == ("a.org", "/1/", None) and got[6][:2] == ("", "") and got[1][2] == "bad.net/"


def test_relative_links_are_resolved(spark):
    refresh, base = '<meta http-equiv="refresh" content="0; url={}">', '<base href="/bad/">'
    links = {1: ("http://a.org/bad/x/p?q=1", "index.html"), 2: ("http://a.org/ok/x/p", "../../bad/y"), 3: ("http://a.org/bad?p=1", "?p=2"), 4: ("http://a.org/bad/q/", "./x"), 5: ("http://a.org/ok/p", "../../../bad/../bad/z"),
             6: ("http://a.org", "bad/k"), 7: ("http://a.org/ok/b", "mailto:x@a.org"), 8: ("http://a.org/ok/c", "#top"), 9: ("nothing", "?u=http://a.org/bad/n"), 10: ("http://a.org/ok/d", "e?u=http://a.org/bad/m"),
             11: ("http://a.org/ok/f", "/ok/../bad/w"), 13: ("http://a.org/ok/h/", "..bad")}
    rows = [(i, url, refresh.format(link)) for i, (url, link) in links.items()] + [(12, "http://a.org/ok/g", base + refresh.format("v"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    targets = {r.a: r.b for r in url_filter.page_links(pages).collect()}
    assert targets == {"a.org/bad/x/p?q=1": "a.org/bad/x/index.html", "a.org/ok/x/p": "a.org/bad/y", "a.org/bad?p=1": "a.org/bad?p=2", "a.org/bad/q": "a.org/bad/q/x", "a.org/ok/p": "a.org/bad/z", "a.org": "a.org/bad/k",
                       "a.org/ok/d": "a.org/ok/e?u=http://a.org/bad/m", "a.org/ok/f": "a.org/bad/w", "a.org/ok/g": "a.org/bad/v", "a.org/ok/h": "a.org/ok/h/..bad"}
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, [("block", "a.org", "/bad/")]).collect()}
    assert {i for i, v in got.items() if v == "block"} == {1, 2, 4, 5, 6, 11, 12}


def test_line_templates_generalise_variable_fields(spark):
    logs = [(i, f"Posted on page {i} by {name} in the main section\nown line number {i} with words {prose(i, 6)}") for i, name in enumerate(["ann", "bob", "cid", "dan", "eve"])]
    rows = [*logs, (9, "short one"), (10, None), (11, "")]
    out = {r.doc_id: r for r in line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"), min_constant=0.6).collect()}
    assert all(out[i].n_dropped == 1 and out[i].text.startswith("own line") for i in range(5))
    assert out[9].text == "short one" and out[10].text is None and (out[10].n_lines, out[11].n_lines) == (0, 1)
    first = line_templates.clean_documents(spark.createDataFrame(rows, "doc_id long, text string"), min_constant=0.6).where("text like 'Posted%'").collect()
    assert [r.doc_id for r in first] == [0]


def test_long_lines_recur_from_two_documents_on(spark):
    short, long, wide = prose(1, 12), prose(2, 60), prose(3, 40)
    rows = [(1, f"{short}\n{long}\n{prose(11, 9)}"), (2, f"{prose(12, 9)}\n{long}"), (3, f"{short}\n{prose(13, 30)}")]
    # Three documents share a template of which two share a word more: all three stay one template.
    rows += [(10 + i, f"{wide} by {name}\n{prose(20 + i, 9)}") for i, name in enumerate(["ann", "bob", "bob"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_templates.drop_recurring(docs).collect()} == {1: 1, 2: 1, 3: 0, 10: 1, 11: 1, 12: 1}
    kept = {r.doc_id: r.text for r in line_templates.clean_documents(docs).collect()}
    assert long in kept[1] and long not in kept[2] and short in kept[1] and short in kept[3]
    assert wide in kept[10] and wide not in kept[11] and wide not in kept[12]


def test_short_and_numeric_lines_recur(spark):
    phone, notice = "555 010 2030 4050 60", "All rights reserved."
    rows = [(i, f"{notice}\n\n{phone}\n{i}1 {i}2 {i}3 {i}4 {i}5\nLes.\n{prose(i, 9)}") for i in (1, 2, 3)] + [(4, f"{phone} 7\nonly here\n\n{prose(4, 9)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: (r.n_dropped, r.text) for r in line_templates.drop_recurring(docs).collect()}
    # Other numbers in the same places are another line, and lines without words stay.
    assert out == {i: (3, f"\n{i}1 {i}2 {i}3 {i}4 {i}5\n{prose(i, 9)}") for i in (1, 2, 3)} | {4: (0, rows[3][1])}
    kept = {r.doc_id: r.text for r in line_templates.clean_documents(docs).collect()}
    assert kept[1] == rows[0][1] and kept[2] == out[2][1]


def plain_dropped(rows):
    """{document: dropped line numbers} by the words of the docstring, document sets compared directly."""
    lines = [(i, p, line.split()) for i, text in rows for p, line in enumerate((text or "").split("\n")) if line.split()]
    general = lambda ws: [("<*>" if re.search("[0-9]", w) else w) for w in ws]
    leaves = defaultdict(list)
    for i, p, ws in lines:
        leaves[len(ws), tuple(general(ws)[:3])].append((i, p, ws))
    documents_of = defaultdict(set)
    shapes = []
    for (n, _), own in leaves.items():
        for i, p, ws in own:
            here = [sum(1 for d in {d for d, _, other in own if general(other)[at] == w}) for at, w in enumerate(general(ws))]
            need = 2 if n >= 20 else 3
            keys = [("exact", need, tuple(ws))] if re.search("[0-9]", " ".join(ws)) else []
            for least in sorted({3, need}):
                shape = tuple(w if w != "<*>" and c >= least else "<*>" for w, c in zip(general(ws), here))
                if (n - shape.count("<*>")) / n >= 0.7:
                    keys.append(("shape", least, shape))
            shapes.append((i, p, keys))
            for key in keys:
                documents_of[key].add(i)
    want = defaultdict(list)
    for i, p, keys in shapes:
        if any(len(documents_of[key]) >= key[1] for key in keys):
            want[i].append(p)
    return dict(want)


def test_line_templates_equal_plain_python(spark):
    rng = random.Random(9)
    pool = ["Les.", "12 34", "page 1 of 9", "see also the notes", *[prose(70 + i, rng.choice([2, 4, 6, 22, 30])) for i in range(12)]]
    def changed(line):  # noqa: E306
        words = line.split(" ")
        words[rng.randrange(len(words))] = rng.choice(["ann", "bob", "7"])
        return " ".join(words)
    rows = [(i, "\n".join([changed(x) if rng.random() < 0.4 else x for x in rng.sample(pool, 4)] + ["", prose(200 + i, 8)])) for i in range(14)]
    # One document with many variants of the same lines, and blanks of all kinds.
    rows.append((50, "\n".join(changed(x) for x in pool * 4)))
    rows.append((51, "\n".join(f" {x.replace(' ', chr(9) + ' ')} " for x in pool)))
    got = {}
    for r in line_templates.recurring_lines(with_keys(spark, rows)).collect():
        got[r.d] = r["drop"]
    keys = {r.doc_id: r.k for r in with_keys(spark, rows).collect()}
    want = plain_dropped(rows)
    assert got == {keys[i]: sorted(p) for i, p in want.items()} and sum(map(len, want.values())) > 20


def with_keys(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.withColumn("k", line_templates.document(F.col("doc_id"), F.col("text")))


def test_more_lines_of_one_document_save_no_line(spark):
    line = lambda who, what: f"Order placed by customer {who} for the {what} item today now"
    rows = [(1, line("ann", "red")), (2, line("bob", "red")), (3, line("cid", "red"))]
    more = [(1, "\n".join(line("ann", what) for what in ("red", "blue", "green")))] + rows[1:]
    for own in (rows, more):
        out = {r.doc_id: r.n_dropped for r in line_templates.drop_recurring(spark.createDataFrame(own, "doc_id long, text string")).collect()}
        assert [out[2], out[3]] == [1, 1] and out[1] >= 1


def test_licenses_are_aligned(spark):
    body = dict((n, t) for n, t in reversed(licenses.TEMPLATES))["MIT"]
    edited = body.split()
    edited[10], edited[40] = "altered", "changed again"
    rows = [(1, "x y " + body + " and more " + body), (2, prose(4, 500) + " " + " ".join(edited) + " " + prose(5, 500)), (3, prose(6, 300)), (4, "Released under the MIT License. Released under the MIT License."), (5, None)]
    got = {r.doc_id: [(m.license, m.matched) for m in r.matches] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    total = len(re.findall(r"[a-z0-9]+", body.lower()))
    assert got == {1: [("MIT", total)] * 2, 2: [("MIT", total - 2)], 3: [], 4: [("MIT", 5)] * 2, 5: []}
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.randint(0, 12) for _ in range(rng.randint(0, 20))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_pipeline_stages_take_effect(spark, docs, tmp_path):
    items = spark.createDataFrame([(1, " ".join(documents()[5][1].split()[:20]))], ITEMS)
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        path = str(tmp_path / f"s{len(seen)}")
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == docs.columns
        seen.append({r.doc_id for r in kept.select("doc_id").collect()})
    # 203 is long but made of few words, so most of it repeats.
    assert not {200, 201, 202, 203, 206} & seen[0]
    assert len({100, 101, 102, 103} & seen[2]) <= 1 and 5 in seen[2] and 5 not in seen[3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == seen[3]
    assert corpus_pipeline.ORACLE_SQL is None
