"""Queries over the operators of this subpackage, with the SQL they must equal where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.llm import chat, decontaminate, hard_negatives, jaccard, licenses, line_templates, mixing, packing, quality_model, quality_rules, runs, toxicity, url_filter

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


PASSAGES_SQL = r"""
with w as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
iw as materialized (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
win as materialized (
  select distinct item_id, least(10, len(ws)) as k, array_to_string(ws[p : p + least(10, len(ws)) - 1], ' ') as g
  from (select item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as p from iw where len(ws) > 0)),
pos as materialized (
  select doc_id, p, k, array_to_string(ws[p : p + k - 1], ' ') as g
  from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as p from w, (select distinct k from win) where len(ws) >= k)),
occ as materialized (select distinct pos.doc_id, pos.p, pos.k, win.item_id from pos join win on pos.g = win.g and pos.k = win.k),
hit as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + k)) as q from occ) group by 1),
its as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as s
  from (select distinct doc_id, item_id::varchar as i from occ) group by 1)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join hit using (doc_id) left join its using (doc_id)"""


@query("op7_decontaminate", PASSAGES_SQL)
def _(spark, folder):
    found = decontaminate.find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10)
    ids = F.array_sort(F.array_distinct(F.transform("items", lambda x: x.cast("string"))))
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit(F.col("spans")).alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


@query("op4_quality_rules")
def _(spark, folder):
    return quality_rules.assess(table(spark, folder, "documents"))


@query("op5_quality_classifier")
def _(spark, folder):
    return quality_model.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_toxicity")
def _(spark, folder):
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op6_packing")
def _(spark, folder):
    pieces = packing.pack(table(spark, folder, "documents"), tokenizer(), capacity=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


CHAT_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as p,
  regexp_replace(role, '\\|<\|turn\|>|<\|text\|>|<\|end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>', '\\\0', 'g') as er,
  regexp_replace(text, '\\|<\|turn\|>|<\|text\|>|<\|end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>', '\\\0', 'g') as et from c)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by p)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by p) filter (role = 'assistant'), '')) as loss_sha256,
  sum(8 + length(er) + 8 + length(et) + 7)::bigint as formatted_chars
from e group by conv_id"""


@query("op3_chat_formatting", CHAT_SQL)
def _(spark, folder):
    stored = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    messages = chat.chains(stored.unionByName(added), "conv_id", "turn", "role", "text")
    back = chat.read_back(chat.format_paths(chat.best_paths(messages)))
    return back.select(
        F.col("tree").alias("conv_id"), "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("masked").cast("bigint").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars",
    )


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

# The pages hold no redirect or canonical link, so without a rule each is allowed.
URL_SQL = r"""
with p as (select page_id,
  translate(case when contains(url, '://') then regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) else '' end, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  case when contains(url, '://') then regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) else '' end as path from pages),
r as (select * from (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(action, h, s)),
f as (select page_id, host, path, max_by(h || s, length(h || s)) as rule, max_by(action, length(h || s)) as action
  from p left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, s) group by all)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule, coalesce(action, 'allow') as verdict from f"""


@query("op9_url_filters", URL_SQL)
def _(spark, folder):
    return url_filter.judge(table(spark, folder, "pages"), URL_RULES).drop("component")


JACCARD_SQL = r"""
with recursive w as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as materialized (
  select distinct doc_id, hash(array_to_string(ws[p : p + least(4, len(ws)) - 1], ' ')) as g
  from (select doc_id, ws, unnest(range(1, len(ws) - least(4, len(ws)) + 2)) as p from w where len(ws) > 0)),
n as materialized (select doc_id, count(*) as n from s group by 1),
l as materialized (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as i from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all)
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 85 * (na.n + nb.n - i)),
e as materialized (select a, b from l union all select b, a from l),
r as (select distinct a as doc_id, a as c from e union select r.doc_id, e.b from r join e on r.c = e.a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce((select min(c) from r where r.doc_id = w.doc_id), w.doc_id)) as component_id
from w left join n using (doc_id)"""


@query("op2_jaccard_join", JACCARD_SQL)
def _(spark, folder):
    return jaccard.classes(table(spark, folder, "documents"), k=4, num=85, den=100)


TEMPLATES_SQL = r"""
with l as materialized (select doc_id, pos - 1 as pos, line from (select doc_id, unnest(string_split(text, chr(10))) as line,
    generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)),
k as materialized (select *, len(t) as n, array_to_string(t, ' ') as v, array_to_string(t[1:3], ' ') as lead from (
  select doc_id, pos, case when regexp_matches(line, '[0-9]') then array_to_string(w, ' ') end as exact, list_transform(w, lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) as t
  from (select *, list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from l)) where len(t) >= 1),
leaf as (select n, lead from k group by all having count(distinct doc_id) >= 2),
s as materialized (select k.* from k join leaf using (n, lead)),
var as materialized (select n, lead, v, any_value(t) as t from s group by n, lead, v),
tok as materialized (select n, lead, v, unnest(t) as token, generate_subscripts(t, 1) as p from var),
c as materialized (select n, lead, p, token, count(distinct doc_id) as c from tok join (select distinct n, lead, v, doc_id from s) using (n, lead, v) where token <> '<*>' group by all),
tem as materialized (select n, lead, v, need, string_agg(case when c.c >= need then tok.token else '<*>' end, ' ' order by p) as tpl
  from tok left join c using (n, lead, p, token), (select unnest([2, 3]) as need) where need = 3 or n >= 20
  group by n, lead, v, need having avg(case when c.c >= need then 1.0 else 0.0 end) >= 0.7),
held as materialized (select s.doc_id, s.pos, tpl, need from s join tem using (n, lead, v)
  union all select doc_id, pos, 'exact ' || exact, case when n >= 20 then 2 else 3 end from s where exact is not null),
many as (select tpl, need from held group by tpl, need having count(distinct doc_id) >= need),
dropped as materialized (select distinct doc_id, pos from held join many using (tpl, need)),
txt as (select l.doc_id, string_agg(line, chr(10) order by pos) filter (dropped.pos is null) as text, count(*) as n_lines, count(dropped.pos) as n_dropped
  from l left join dropped using (doc_id, pos) group by 1)
select d.doc_id, case when d.text is null then null else coalesce(txt.text, '') end as text, coalesce(n_lines, 0)::bigint as n_lines,
  coalesce(n_dropped, 0)::bigint as n_dropped from documents d left join txt using (doc_id)"""


@query("op10_line_templates", TEMPLATES_SQL)
def _(spark, folder):
    return line_templates.drop_recurring(table(spark, folder, "documents").select("doc_id", "text"))


@query("op1_license_scan")
def _(spark, folder):
    found = licenses.scan(table(spark, folder, "documents"))
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select(
        "doc_id", "n_words", F.size("matches").cast("bigint").alias("n_matches"), F.array_join(ids, ",").alias("licenses"),
        F.aggregate("matches", F.lit(0).cast("bigint"), lambda n, m: n + m["matched"]).alias("matched_words"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("best_coverage"),
    )


RUNS_SQL = r"""
with t as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws, 
    xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda c, x:
      list_reduce(list_transform(range(8), lambda i: i::bigint), lambda k, i: xor(k >> 1, 3988292384 * (k & 1)), xor(c, x)), 4294967295::bigint), 4294967295::bigint) as crc from documents),
o as materialized (select doc_id, ws, len(ws) as n, crc // 10 as g, case when crc % 10 = 0 and len(ws) > 0 then (crc // 10) % len(ws) end as a from t),
w as materialized (select doc_id, n, case when a is null then ws
  else list_transform(range(0, n), lambda i: case when i >= a then ws[1 + a + (i - a) % (1 + (n - a) // (3 + g % 8))] else ws[1 + i] end) end as ws from o),
x as (select doc_id, n, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as i from w),
y as materialized (select doc_id, n, i, hash(word, lead(word) over f, lead(word, 2) over f) as h from x window f as (partition by doc_id order by i) qualify lead(word, 2) over f is not null),
m as (select a.doc_id, b.i - a.i as q, a.i from y a join y b on a.doc_id = b.doc_id and a.h = b.h and b.i > a.i and 4 * (b.i - a.i) <= a.n),
k as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from m),
c as (select doc_id, min(i) as s, count(*) + 2 + q as l, q from k group by doc_id, q, island having count(*) + 2 + q >= greatest(6, 4 * q)),
r as materialized (select doc_id, s, l, min(q) as q from c group by doc_id, s, l),
b as (select doc_id, count(*) as n_runs, min_by(struct_pack(s := s, l := l, q := q), (-l, s, q)) as best, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as listed from r group by 1),
d as (select distinct doc_id, unnest(range(s + q, s + l)) as i from r),
z as (select doc_id, string_agg(word, ' ' order by i) as text from x anti join d using (doc_id, i) group by 1)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.s::bigint as start, best.l::bigint as length, best.q::bigint as period,
  (1000 * best.l // best.q)::bigint as exponent_milli, sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(z.text, '')) as collapsed_sha256
from w left join b using (doc_id) left join z using (doc_id)"""


@query("op11_periodic_runs", RUNS_SQL)
def _(spark, folder):
    found = runs.find_runs(with_periodic_tails(table(spark, folder, "documents")))
    ordered = F.transform("runs", lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = found.withColumn("best", F.array_min(ordered))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; every tenth text, by crc32 of its id, repeats some of its words to its end."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    n, g = F.size("ws"), F.floor(F.col("crc") / 10)
    a = F.col("a")
    p = F.lit(1) + F.floor((n - a) / (3 + g % 8)).cast("int")
    tail = lambda ws: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ws, F.when(i >= a, a + (i - a) % F.col("p")).otherwise(i)))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), crc.alias("crc"))
    rows = rows.withColumn("ws", F.when(F.col("crc") % 10 == 0, words))
    rows = rows.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn("p", p)
    made = F.array_join(F.transform(F.array("ws"), tail)[0], " ")
    return rows.select("doc_id", F.when(n > 0, made).otherwise(F.col("text")).alias("text"))


MIX_SQL = r"""
with d as materialized (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as materialized (select source, sum(size)::bigint as source_size, row_number() over (order by source is null, encode(source)) as number from d group by source),
v as materialized (select *, case (number - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from s),
c as materialized (select *, sum(source_size) over ()::bigint as total, sum(weight) over ()::bigint as weights,
  coalesce(sum(3 * source_size) over f, 0)::bigint as given, coalesce(sum(weight) over f, 0)::bigint as gone from v
  window f as (order by source_size / weight, number rows between unbounded preceding and 1 preceding)),
k as (select total - given as words, weights - gone as share from c where not 3 * source_size::hugeint * (weights - gone) < weight::hugeint * (total - given)
  order by source_size / weight, number limit 1),
t as materialized (select source, source_size, case when 3 * source_size::hugeint * share < weight::hugeint * words then (3 * source_size)::double
  else (weight * words)::double / greatest(share, 1) end as target from v, k),
p as (select d.*, source_size, target, floor(target + 0.5)::bigint as budget,
  coalesce(sum(size) over (partition by d.source order by substr(md5(concat_ws('|', '1', doc_id::varchar)), 1, 16), doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from d join t on d.source is not distinct from t.source),
e as (select *, case when source_size > 0 then budget // source_size else 0 end as full_epochs from p),
r as (select *, greatest(0, least(size, budget - full_epochs * source_size - before)) as part from e)
select doc_id, source, size, source_size, target, (full_epochs + case when part = size and part > 0 then 1 else 0 end)::bigint as epochs,
  (full_epochs * size + part)::bigint as taken from r"""


@query("op12_source_mixing", MIX_SQL)
def _(spark, folder):
    return mixing.mix(table(spark, folder, "documents"))


NEGATIVES_SQL = r"""
with r as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.vec_id as anchor_id, a.label as anchor_label, r.vec_id, r.label, list_inner_product(a.q, r.q)::bigint as score
  from r a, r where a.vec_id % 100 = 0),
p as materialized (select anchor_id, anchor_label, vec_id as positive_id, score as positive_score from s where label = anchor_label and vec_id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s on p.anchor_id = s.anchor_id and s.label <> s.anchor_label and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) <= 10"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def _(spark, folder):
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("id") % 100 == 0)
