"""Near-duplicate classes: an exact Jaccard join of word-shingle sets by token-combination prefixes.

1. Documents with equal sets become one representative.
2. A cheap necessary condition removes most others. In hash order, the first share of a set must
   have enough tokens in common with the same share of some other set, so a document with too few
   repeated tokens there has no partner. What remains is counted again over whole sets: a document
   needs a partner for the threshold's share of its tokens.
3. Tokens are ordered from rare to frequent, by their counts over the remaining documents. Rare tokens
   are indexed one by one; frequent ones only as pairs, so a frequent token alone brings no candidates
   together. A pair loses one token of its cell (tokens are dealt to cells by hash), and the prefix is
   extended by as many: as a partner may lack ``n - ceil(t n)`` tokens, the prefix goes on until one
   more than that many tokens count. Cells are as wide as the size band of the documents asks; a
   document near the lower end of its band is indexed for the band below as well.
4. Candidates are verified on whole sets. Only classes matter, so buckets are worked off in rounds:
   small buckets pair by pair, larger ones by chance neighbours, and then the documents that are still
   in different classes, block against block. No link between different sets is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemill.llm import words as w
from tidemill.functions.order import lookup_by_value
from tidemill.llm.components import components
from tidemill.llm.tables import checkpointed, keep_keys

#: Share of a set beyond the prefix of the threshold that the first condition looks at, in percent.
LOOK_PERCENT = 7
#: Most documents of a rare token, tokens of a prefix that share a cell, least set size with pairs,
#: and documents of a bucket that is worked off pair by pair.
RARE, CELL, PAIRED, SMALL = 8, 5, 16, 6
#: Turns in which documents of large buckets meet a neighbour, and documents that meet at one table.
TURNS, TABLE = 1, 64
#: Signatures whose values go to every task as a whole.
FEW_SIGNATURES = 500_000
#: Tokens and documents of a block of the last step.
BLOCK_TOKENS, BLOCK_DOCS = 1 << 19, 512


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than ``k`` words are one shingle."""
    c = w.cut(texts, w.SPACED, lower=True)
    h = w.word_hashes(c)
    s, at = w.shingle_hashes(c, h, k)
    cuts = np.searchsorted(at, c.first)
    out = []
    for i, n in enumerate(c.counts.tolist()):
        if n >= k or n == 0:
            out.append(np.unique(s[cuts[i] : cuts[i + 1]]))
        else:
            out.append(w.join_hashes(h[c.first[i] : c.first[i + 1]]))
    return out


def most_missing(n: int, num: int, den: int) -> int:
    """Tokens of a set of ``n`` that a partner may lack, at a similarity of ``num / den``."""
    return n - -(-num * n // den)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    sizes = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=sizes[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat.astype(np.uint64).view(np.int64)))


def profiles(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``doc_id``, set size ``n``, set fingerprint ``f`` and the first hashes ``head`` of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in w.chunks(batches, "text"):
            sets = shingle_sets(texts, k)
            n = [len(s) for s in sets]
            heads = [s[: -(-((den - num) * 100 + LOOK_PERCENT * den) * len(s) // (100 * den))] if _may_differ(len(s), num, den) else s[:0] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, type=pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], type=pa.binary()), _lists(heads)], names=["doc_id", "n", "f", "head"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, f binary, head array<bigint>")


def _may_differ(n: int, num: int, den: int) -> bool:
    """Whether a set of ``n`` can reach the threshold with a different set: one token more, or one exchanged."""
    return n > 0 and (den * n >= num * (n + 1) or den * (n - 1) >= num * n or den * (n - 1) >= num * (n + 1))


def whole_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in w.chunks(batches, "text"):
            sets = shingle_sets(texts, k)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], type=pa.int64()), _lists(sets)], names=["doc_id", "n", "tokens"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, tokens array<bigint>")


def signatures(n: int, counts: np.ndarray, tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signature hashes of one document, from its repeated tokens and their counts; its other tokens have no partner."""
    order = np.lexsort((tokens, counts))
    tokens, rare = tokens[order], counts[order] <= RARE
    band = n.bit_length() - 1
    out = []
    for b in [band] + ([band - 1] if num * n < den << band else []):
        missing = most_missing(n, num, den) + 1 - (n - len(tokens))
        single = rare if 1 << b >= PAIRED else np.ones(len(tokens), dtype=bool)
        cells = max(1, ((1 << b) * (den - num)) // (den * CELL))
        cell = np.where(single, -1, (w.mix(tokens) % np.uint64(cells)).astype(np.int64))
        # A frequent token counts if its cell has an earlier one.
        first = np.zeros(len(tokens), dtype=bool)
        first[np.unique(cell, return_index=True)[1]] = True
        total = np.cumsum(single | ~first)
        end = int(np.searchsorted(total, missing)) + 1
        out.append(w.mix(tokens[:end][single[:end]]))
        own, of = tokens[:end][~single[:end]], cell[:end][~single[:end]]
        by = np.argsort(of, kind="stable")
        own, of = own[by], of[by]
        edge = np.flatnonzero(np.diff(of)) + 1
        for group in np.split(own, edge):
            if len(group) > 1:
                i, j = np.triu_indices(len(group), 1)
                low, high = np.minimum(group[i], group[j]), np.maximum(group[i], group[j])
                out.append(w.mix(w.mix(low * w._A + high) + np.uint64(b + 1)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint64)


def indexed(known: DataFrame, num: int, den: int) -> DataFrame:
    """(sig, doc_id, n) of rows (doc_id, n, counts, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for n, counts, tokens in zip(b.column("n").to_pylist(), b.column("counts"), b.column("tokens")):
                found.append(signatures(n, counts.values.to_numpy(), tokens.values.to_numpy().view(np.uint64), num, den))
            at = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in found]))
            sig = np.concatenate(found).view(np.int64) if found else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sig), b.column("doc_id").take(at), b.column("n").take(at)], names=["sig", "doc_id", "n"])

    return known.mapInArrow(run, f"sig bigint, doc_id {known.schema['doc_id'].dataType.simpleString()}, n bigint")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("__s"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("__t"))
    both = F.size(F.array_intersect("__s", "__t")).cast("bigint")
    out = pairs.join(left, "a").join(right, "b")
    return out.where(both * den >= num * (F.size("__s") + F.size("__t") - both)).select("a", "b")


def _near(n: Column, m: Column, num: int, den: int) -> Column:
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & F.lit(True)


def by_signature(rows: DataFrame, table: DataFrame, total: int, fields: dict[str, str]) -> DataFrame:
    """``rows`` with ``fields`` of a written ``table`` that has one row per ``sig`` and its number ``m`` of ``total`` rows.

    Few signatures go to every task, and the rows stay where they are. Of more, those with more than a
    thousandth of the rows do, so that no task gets all rows of one.
    """
    return lookup_by_value(rows, F.col("sig"), table, "sig", "m", total, fields, small=table.count() <= FEW_SIGNATURES)


def links(sets: DataFrame, index: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component) over links between the documents of ``index``, enough of them to connect every class."""
    total = index.count()
    sizes = checkpointed(index.groupBy("sig").agg(F.count("*").alias("m")).where("m > 1"))
    index = checkpointed(by_signature(index, sizes, total, {"m": "m"}).where("m is not null"))
    small = index.where(F.col("m") <= SMALL)
    other = small.select("sig", F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    pairs = small.join(other, "sig").where((F.col("doc_id") < F.col("b")) & _near(F.col("n"), F.col("nb"), num, den)).select(F.col("doc_id").alias("a"), "b").distinct()
    edges = [checkpointed(verified(pairs, sets, num, den))]

    def classed(large: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Components so far, and the rows of large buckets that still hold several of them; a bucket with one never has more."""
        found = edges[0]
        for e in edges[1:]:
            found = found.union(e)
        known = components(found)
        rows = large.join(known.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("sig", "doc_id", "n", "m", F.coalesce("component", "doc_id").alias("component"))
        rows = checkpointed(rows)
        mixed = rows.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("m").alias("m")).where("x <> y").withColumn("mixed", F.lit(True))
        rows = by_signature(rows, checkpointed(mixed), total, {"mixed": "mixed"})
        return known, checkpointed(rows.where("mixed").drop("mixed"))

    known, rows = classed(index.where(F.col("m") > SMALL))
    for turn in range(TURNS):
        if not rows.limit(1).count():
            return known
        # Every document meets a few others of its bucket, dealt anew in each turn.
        lot = F.xxhash64("doc_id", F.lit(turn))
        dealt = rows.withColumn("lot", lot)
        dealt = dealt.withColumn("share", F.pmod(F.xxhash64("lot"), F.ceil(F.col("m") / TABLE)))
        beside = Window.partitionBy("sig", "share").orderBy("lot")
        met = dealt.select("doc_id", "n", "component", F.lag(F.struct("doc_id", "n", "component")).over(beside).alias("o"))
        met = met.where((F.col("component") != F.col("o.component")) & _near(F.col("n"), F.col("o.n"), num, den))
        pairs = met.select(F.least("doc_id", "o.doc_id").alias("a"), F.greatest("doc_id", "o.doc_id").alias("b")).distinct()
        edges.append(checkpointed(verified(pairs, sets, num, den)))
        known, rows = classed(rows.drop("component"))
    if not rows.limit(1).count():
        return known
    edges.append(checkpointed(tiled(rows, sets, num, den)))
    return components(reduce(DataFrame.union, edges))


def tiled(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between documents of different classes that share a bucket directly or over others.

    Such documents form clusters. A cluster is dealt to blocks by size band (as wide as the threshold, so
    links stay within a band or join neighbours) and hash, each with a bounded number of tokens; every
    block of documents outside the cluster's largest class meets every block of the cluster.
    """
    docs = checkpointed(rows.select("doc_id", "n", "component").distinct())
    pivots = checkpointed(rows.groupBy("sig").agg(F.min("doc_id").alias("p"), F.count("*").alias("m")))
    paired = by_signature(rows.drop("m"), pivots, rows.count(), {"p": "p"})
    cluster = components(paired.select("doc_id", "p").distinct(), "doc_id", "p").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    docs = docs.join(cluster, "doc_id").withColumn("band", F.floor(F.log(F.col("n")) / (math.log(den / num) * 1.0001)).cast("int"))
    main = docs.groupBy("cluster", "component").agg(F.count("*").alias("m")).groupBy("cluster").agg(F.max(F.struct("m", "component")).alias("x"))
    docs = checkpointed(docs.join(main.select("cluster", F.col("x.component").alias("main")), "cluster"))
    tiles = []
    sides = {0: docs.where("component <> main"), 1: docs}
    sizes = {side: own.groupBy("cluster", "band").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_TOKENS, F.count("*") / BLOCK_DOCS)).alias("blocks")) for side, own in sides.items()}
    for side, own in sides.items():
        mine = own.join(sizes[side], ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).drop("blocks")
        facing = sizes[1 - side].select("cluster", F.col("band").alias("other"), F.col("blocks"))
        mine = mine.withColumn("other", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).join(facing, ["cluster", "other"])
        mine = mine.withColumn("facing", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        place = [F.struct("band", "block").alias("x"), F.struct(F.col("other").alias("band"), F.col("facing").alias("block")).alias("y")]
        tiles.append(mine.select("cluster", "doc_id", "component", F.lit(side).alias("side"), *(place if side == 0 else place[::-1])).toDF("cluster", "doc_id", "component", "side", "x", "y"))
    both = tiles[0].union(tiles[1]).withColumn("tile", F.xxhash64("cluster", "x", "y")).select("tile", "side", "doc_id", "component")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def meet(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, component = table.column("doc_id").to_pylist(), table.column("component").to_pylist()
        lists = table.column("tokens").combine_chunks()
        flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        size = np.diff(offsets)
        names = {c: i for i, c in enumerate(dict.fromkeys(component))}
        root = list(range(len(names)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        out: list[tuple] = []
        if len(left) and len(right):
            tokens = np.concatenate([flat[offsets[j] : offsets[j + 1]] for j in right])
            starts = np.concatenate([[0], np.cumsum(size[right])[:-1]])
            mark = np.zeros(flat.max() + 1, dtype=np.int32)
            for i in left.tolist():
                own = flat[offsets[i] : offsets[i + 1]]
                mark[own] = 1
                shared = np.add.reduceat(mark[tokens], starts)
                mark[own] = 0
                for j in right[shared * den >= num * (size[i] + size[right] - shared)].tolist():
                    a, b = find(names[component[i]]), find(names[component[j]])
                    if a != b:
                        root[a] = b
                        out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        kinds = table.schema.field("doc_id").type
        return pa.table({"a": pa.array([x for x, _ in out], type=kinds), "b": pa.array([y for _, y in out], type=kinds)})

    held = both.join(sets.select("doc_id", "tokens"), "doc_id")
    return held.groupBy("tile").applyInArrow(meet, f"a {kind}, b {kind}")


def classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Two documents link when their sets of ``k``-word shingles have a Jaccard similarity of at least
    ``num / den``. Texts without words (or null) have empty sets and link with nothing. Rows that share
    an id count as one document; rows without an id link with nothing and have no component.
    """
    if not 0 < num <= den or 2 * num < den:
        raise ValueError("the threshold must be between one half and one")
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    profile = checkpointed(profiles(source, k, num, den))
    usable = profile.where("n > 0 and doc_id is not null")
    reps = checkpointed(usable.groupBy("f", "n").agg(F.min("doc_id").alias("rep")))
    heads = keep_keys(usable.where(F.size("head") > 0).select("doc_id", "n", "head"), reps.select(F.col("rep").alias("doc_id")), "doc_id")
    tokens = heads.select("doc_id", "n", F.explode("head").alias("h"))
    twice = tokens.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    need = F.ceil(F.col("n") * LOOK_PERCENT / 100.0 - 1e-9)
    held = tokens.join(twice.hint("shuffle_hash"), "h").groupBy("doc_id", "n").agg(F.count("*").alias("c"))
    involved = checkpointed(held.where(F.col("c") >= need).select("doc_id").distinct())
    sets = checkpointed(whole_sets(keep_keys(source, involved, "doc_id"), k))

    tokens = sets.select("doc_id", "n", F.explode("tokens").alias("h"))
    counts = tokens.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    shared = tokens.join(counts.hint("shuffle_hash"), "h").groupBy("doc_id", "n").agg(F.collect_list("c").alias("counts"), F.collect_list("h").alias("tokens"))
    able = shared.where(F.size("tokens") * F.lit(den) >= F.lit(num) * F.col("n"))
    index = checkpointed(indexed(able, num, den))
    known = checkpointed(links(sets, index, num, den))

    found = reps.join(known, reps["rep"] == known["node"], "left").select("f", "n", F.coalesce("component", "rep").alias("component_id"))
    named = usable.select("doc_id", "n", "f").join(found.hint("shuffle_hash"), ["f", "n"]).select("doc_id", "n", "component_id")
    rest = profile.where("not (n > 0 and doc_id is not null)").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return named.unionByName(rest).withColumnRenamed("n", "n_shingles")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that share a class with a document of smaller id."""
    found = classes(docs, k, num, den, doc_id=doc_id, text=text)
    return keep_keys(docs, checkpointed(found.where("component_id < doc_id").select("doc_id").distinct()).withColumnRenamed("doc_id", doc_id), doc_id, anti=True)
