"""Lines that recur across documents, by a log-template tree of fixed depth. DataFrame functions only.

A line goes to a leaf of the tree by its number of tokens and its leading tokens, with tokens that hold a digit
generalised. Inside a leaf, a token that stands at its position in fewer than ``min_docs`` documents is a variable field and
becomes a wildcard; the line's template is what remains. A template with enough constant tokens that stands in ``min_docs``
documents goes from all of them. A long line has a second template, with the tokens and in the count of
``LONG_DOCS`` documents, and goes if either recurs. A line with digits also goes if it recurs word for word in as many
documents, however few of its tokens are constant.

Documents are counted, never lines, so several lines of one document weigh as one. The first pass keeps only the leaves and one
range of documents for each; the second keeps the lines of leaves with several documents. A generalised line (variant) that
recurs itself is its own template, and where all variants of a leaf do, no token is looked at. In the other leaves a token
at its position is one number (slot), and the slots of enough documents make the template. A line that half
of the documents share is one row after map-side aggregation, and gives its tokens once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.llm.tables import checkpointed, keep_keys

#: Leading tokens that lead to a leaf, least tokens of a line, least documents of a template, and least
#: share of constant tokens in it.
DEPTH, MIN_TOKENS, MIN_DOCS, MIN_CONSTANT = 3, 1, 3, 0.7
#: Tokens from which a line is long, and least documents of its template.
LONG_TOKENS, LONG_DOCS = 20, 2
WILD = "<*>"
SPACE = r"[ \t\n\x0B\f\r]+"
#: Leaves, and documents with dropped lines, that are sent to every task: 500,000 are 16 MB with short lists.
FEW = 500_000


def document(doc_id: Column, text: Column) -> Column:
    """The key of a document: rows with one id and different texts are different documents, and so are rows without an id."""
    return F.xxhash64(doc_id, text)


def lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``d`` (key of the document), ``pos`` and ``line``."""
    own = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text")).where("text is not null")
    return own.select("doc_id", document(F.col("doc_id"), F.col("text")).alias("d"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def spaced(line: Column) -> Column:
    """The tokens of a line, joined by one blank."""
    odd = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for blank in "\t\r\x0b\f":
        odd = odd | F.contains(line, F.lit(blank))
    return F.when(odd, F.trim(F.regexp_replace(line, SPACE, " "))).otherwise(line)


def generalised(line: Column) -> Column:
    """A spaced line whose tokens with a digit are wildcards."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", WILD)).otherwise(line)


def _once(rows: DataFrame, **new: Column) -> DataFrame:
    """``rows`` with columns that later filters and projections do not compute again."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in new.items()]))))


def _keyed(rows: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """Lines with ``min_tokens`` tokens or more: ``spaced``, ``general``, ``n`` (tokens) and ``leaf``."""
    rows = _once(rows.where(F.col("line").rlike(r"[^ \t\x0B\f\r]")), spaced=spaced(F.col("line"))).drop("line")
    rows = _once(rows, general=generalised(F.col("spaced")))
    rows = _once(rows, n=F.octet_length("general") - F.octet_length(F.replace("general", F.lit(" "))) + 1)
    rows = rows.where(F.col("n") >= min_tokens) if min_tokens > 1 else rows
    return rows.withColumn("leaf", F.xxhash64("n", F.substring_index("general", " ", depth)))


def _few(df: DataFrame) -> DataFrame:
    """A stored table, for broadcast if it is counted small."""
    return F.broadcast(df) if df.count() <= FEW else df


def recurring_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT, keep_first: bool = False) -> DataFrame:
    """(``d``, ``drop``: sorted line numbers) of the documents that hold recurring lines.

    With ``keep_first`` the document with the smallest id (of several: the smallest key) keeps its lines of a template.
    """
    long_docs = min(min_docs, LONG_DOCS)
    need = F.when(F.col("n") >= LONG_TOKENS, long_docs).otherwise(min_docs)
    of_leaf = _keyed(lines(docs, doc_id, text), depth, min_tokens).groupBy("leaf").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    leaves = checkpointed(of_leaf.where("a != b" if long_docs > 1 else "true").select("leaf"))
    shared = keep_keys(_keyed(lines(docs, doc_id, text), depth, min_tokens), leaves, "leaf", few=FEW)
    wild = F.when(F.contains("general", F.lit(WILD)), F.regexp_count("general", F.lit(r"(?<![^ ])<\*>(?![^ ])"))).otherwise(0)
    exact = F.when(F.col("spaced").rlike("[0-9]"), F.xxhash64("spaced", F.lit("exact")))
    shared = checkpointed(shared.select("doc_id", "d", "pos", "leaf", "n", need.alias("need"), wild.alias("wild"), F.xxhash64("general").alias("variant"), "general", exact.alias("exact")))

    # The documents of each variant. A leaf is open while one of its variants does not recur itself.
    held_by = shared.select("leaf", "variant", "n", "need", "wild", "d").distinct()
    variants = checkpointed(held_by.groupBy("leaf", "variant", "n", "need", "wild").agg(F.count("*").alias("c"), F.min("d").alias("one")))
    open_leaves = checkpointed(variants.where("c < need").select("leaf").distinct())
    opened = checkpointed(variants.join(_few(open_leaves), "leaf", "left_semi").select("leaf", "variant", "n", "need", "c", "one"))
    settled = keep_keys(variants, open_leaves, "leaf", anti=True, few=FEW)
    whole = settled.where((F.col("n") - F.col("wild")) / F.col("n") >= min_constant).select("variant", F.xxhash64("variant", F.lit("whole")).alias("template"), "need")

    # Slots of rare variants with each of their documents, and of the others once.
    chosen = shared.select("variant", "d", "general").join(_few(opened.select("variant", "c", "one")), "variant").where((F.col("c") < min_docs) | (F.col("d") == F.col("one")))
    chosen = checkpointed(chosen.select("variant", "d", "general", (F.col("c") >= min_docs).alias("fixed")))
    words = chosen.select("variant", "d", "fixed", F.posexplode(F.split("general", " ")).alias("p", "token")).where(F.col("token") != WILD)
    leaf_of = opened.select("variant", "leaf")
    slots = words.join(_few(leaf_of), "variant").select("variant", "d", "fixed", F.xxhash64("leaf", "p", "token").alias("slot"))
    counts = slots.where("not fixed").select("slot", "d").distinct().groupBy("slot").agg(F.count("*").alias("c")).where(F.col("c") >= long_docs)
    constant = counts.unionByName(slots.where("fixed").select("slot", F.lit(min_docs).cast("bigint").alias("c"))).groupBy("slot").agg(F.least(F.max("c"), F.lit(min_docs)).alias("c"))
    hit = slots.select("variant", "slot").distinct().join(constant, "slot")
    levels = sorted({min_docs, long_docs})
    shaped = hit.groupBy("variant").agg(*[F.array_sort(F.collect_list(F.when(F.col("c") >= x, F.col("slot")))).alias(f"slots{x}") for x in levels])
    shaped = shaped.join(opened.select("variant", "leaf", "n", "need"), "variant")

    def template(least: int) -> Column:
        """(``template``, ``need``) of the slots of ``least`` documents; null if they are too few of the line."""
        fixed = F.col(f"slots{least}")
        enough = (F.size(fixed) / F.col("n") >= min_constant) & (F.col("need") <= least)
        return F.when(enough, F.struct(F.xxhash64("leaf", fixed, F.lit(least)).alias("template"), F.lit(least).alias("need")))

    templates = checkpointed(whole.unionByName(shaped.select("variant", F.inline(F.array_compact(F.array(*[template(x) for x in levels]))))))
    shapes = shared.select("doc_id", "d", "pos", "variant").join(_few(templates), "variant").select("template", "need", "doc_id", "d", "pos")
    held = checkpointed(shapes.union(shared.where("exact is not null").select("exact", "need", "doc_id", "d", "pos")))
    per_doc = held.select("template", "need", "doc_id", "d").distinct().groupBy("template", "need").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "d")).alias("first")).where("c >= need")
    hit = held.join(_few(checkpointed(per_doc.drop("c"))), ["template", "need"])
    if keep_first:
        hit = hit.where(F.col("d") != F.col("first.d"))
    return hit.groupBy("d").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def drop_recurring(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``, and the columns ``n_lines`` and ``n_dropped``
    (existing ones of these names are replaced).

    Lines are divided by ``\\n``; the others keep their order and bytes. Null texts stay null, with 0
    lines, and an empty text is one line. Lines with fewer than ``min_tokens`` tokens, and lines without
    any, always stay. Rows with equal id and text are one document, so copies of a row make no line recur; with equal texts
    and different ids they do. A very long text is divided into its lines like any other.
    """
    dropped = checkpointed(recurring_lines(docs, doc_id=doc_id, text=text, **options)).toDF("__d", "__drop")
    dropped = F.broadcast(dropped) if dropped.count() <= FEW else dropped
    whole = F.col(text).cast("string")
    out = docs.join(dropped, document(docs[doc_id], docs[text].cast("string")) == dropped["__d"], "left")
    parts = F.split(whole, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__drop"))
    # The parts are bound to a name first, so that the text is not divided again for each line.
    joined = F.transform(F.array(F.struct(parts.alias("ps"), stay.alias("at"))), lambda x: F.array_join(F.transform(x["at"], lambda i: F.get(x["ps"], i)), "\n"))[0]
    kept = F.when(F.col("__drop").isNull(), whole).otherwise(joined)
    counts = {"n_lines": F.when(whole.isNull(), 0).otherwise(F.size(parts)).cast("bigint"), "n_dropped": F.coalesce(F.size("__drop"), F.lit(0)).cast("bigint")}
    return out.withColumns({"__text": kept} | {f"__{k}": v for k, v in counts.items()}).select(
        *[F.col("__text").alias(text) if c == text else docs[c] for c in docs.columns if c not in counts], *[F.col(f"__{k}").alias(k) for k in counts])


def clean_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with its columns, without recurring lines and without documents that consisted of them.

    The first document of a template keeps it, so that what copies share is not lost. ``n_chars``, if
    there is such a column, follows the text.
    """
    out = drop_recurring(docs, doc_id=doc_id, text=text, **({"keep_first": True} | options))
    out = out.where((F.col("n_dropped") == 0) | F.col(text).rlike(r"[^ \t\n\x0B\f\r]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
