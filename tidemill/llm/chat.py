"""Conversations from reply trees, in a chat template that can be read back.

Messages of a tree point to the message they answer. Repeated self-joins double the known distance to
the root (so their number grows with the logarithm of the longest path), rank the branches by score,
and mark the messages on each chosen root-to-leaf path, which is then formatted as one conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemill.llm.tables import checkpointed

ROLE, TEXT, END, ESCAPE = "<|turn|>", "<|text|>", "<|end|>", "\\"
#: Strings with a meaning in this or other common templates; inside roles and texts they are escaped.
CONTROLS = [ROLE, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
_CONTROL = "|".join(map(re.escape, CONTROLS))
_HIDE = re.compile(rf"{re.escape(ESCAPE)}|{_CONTROL}")
_SHOW = re.compile(rf"{re.escape(ESCAPE)}({re.escape(ESCAPE)}|{_CONTROL})")
_SCAN = re.compile(rf"{re.escape(ESCAPE)}(?:{re.escape(ESCAPE)}|{_CONTROL})|{re.escape(ROLE)}|{re.escape(TEXT)}|{re.escape(END)}")


def escape(text: str) -> str:
    return _HIDE.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _SHOW.sub(lambda m: m[1], text)


@dataclass
class Formatted:
    text: str
    spans: list[tuple[int, int]]


def format_turns(turns: list[tuple[str, str]], trained: str = "assistant") -> Formatted:
    """One conversation, with the character ranges of the texts of role ``trained`` as its loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{ROLE}{escape(role)}{TEXT}", escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return Formatted("".join(parts), spans)


def read_turns(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, role, at = [], "", 0
    for m in _SCAN.finditer(text):
        if m[0] == ROLE:
            at = m.end()
        elif m[0] == TEXT:
            role, at = unescape(text[at : m.start()]), m.end()
        elif m[0] == END:
            turns.append((role, unescape(text[at : m.start()])))
    return turns


def chains(rows: DataFrame, tree: str, order: str, role: str, text: str) -> DataFrame:
    """Messages of linear conversations: each answers the one before it, ties of ``order`` by role and text."""
    by = Window.partitionBy("tree").orderBy(F.col("place").asc_nulls_first(), "role", "text")
    own = rows.select(rows[tree].alias("tree"), rows[order].alias("place"), F.coalesce(rows[role].cast("string"), F.lit("")).alias("role"), F.coalesce(rows[text].cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("node", F.row_number().over(by).cast("bigint"))
    return own.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def best_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """Messages of the ``keep`` best root-to-leaf paths of each tree, with ``branch`` from 1 and ``depth`` from 0.

    ``messages``: tree, node, parent, role, text, score. A branch scores the mean of its messages, null
    scores counting 0; ties go to the smaller leaf. A message whose parent is null or missing starts
    a path; of repeated (tree, node) rows the smallest counts; messages on a cycle hang from no root
    and are in no path. A null tree is a tree of its own; messages without a node are left out.
    """
    m = messages.select(F.coalesce(F.col("tree").cast("string"), F.lit("\0")).alias("t"), "tree", F.col("node").alias("n"), "parent", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).where("n is not null")
    m = checkpointed(m.groupBy("t", "n").agg(F.min(F.struct("parent", "role", "text", "score", "tree")).alias("x")).select("t", "n", "x.*"))
    known = m.select(F.col("t").alias("__t"), F.col("n").alias("__n"))
    links = m.join(known, (F.col("t") == F.col("__t")) & (F.col("parent") == F.col("__n")), "left")
    # hop: the ancestor ``steps`` messages above, null beyond the root; total: scores from here to below it.
    jumps = checkpointed(links.select("t", "n", F.col("__n").alias("hop"), F.lit(1).cast("bigint").alias("steps"), F.col("score").alias("total")))
    leaves = m.select("t", "n").join(jumps.where("hop is not null").select(F.col("t").alias("__t"), F.col("hop").alias("__n")).distinct(), (F.col("t") == F.col("__t")) & (F.col("n") == F.col("__n")), "left_anti")
    leaves = checkpointed(leaves)
    limit, levels = max(1, m.count()).bit_length() + 1, []
    while len(levels) < limit and jumps.where("hop is not null").limit(1).count():
        levels.append(jumps)
        above = jumps.select(F.col("t").alias("__t"), F.col("n").alias("__n"), F.col("hop").alias("__hop"), F.col("steps").alias("__steps"), F.col("total").alias("__total"))
        # Messages that have reached their root stay as they are.
        further = jumps.where("hop is not null").join(above, (F.col("t") == F.col("__t")) & (F.col("hop") == F.col("__n")))
        jumps = checkpointed(jumps.where("hop is null").select("t", "n", "hop", "steps", "total").union(further.select("t", "n", F.col("__hop").alias("hop"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), (F.col("total") + F.coalesce("__total", F.lit(0.0))).alias("total"))))
    rooted = jumps.where("hop is null")
    ends = leaves.join(rooted, ["t", "n"])
    rank = F.row_number().over(Window.partitionBy("t").orderBy(F.desc(F.col("total") / F.col("steps")), "n"))
    path = checkpointed(ends.withColumn("branch", rank).where(F.col("branch") <= keep).select("t", "branch", "n", (F.col("steps") - 1).alias("depth")))
    for level in reversed(range(len(levels))):
        up = levels[level].where("hop is not null").select(F.col("t").alias("__t"), F.col("n").alias("__n"), "hop")
        higher = path.join(up, (F.col("t") == F.col("__t")) & (F.col("n") == F.col("__n"))).select("t", "branch", F.col("hop").alias("n"), (F.col("depth") - F.lit(1 << level)).alias("depth"))
        # Stored, as each level reads the path twice and the plan would double with it.
        path = checkpointed(path.union(higher))
    return path.join(m, ["t", "n"]).select("tree", "branch", "depth", F.col("n").alias("node"), "role", "text")


def format_paths(paths: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per (``tree``, ``branch``): ``formatted`` text and ``loss``, the character ranges of the mask.

    The messages are dealt and sorted by Spark and read as a stream, so a task holds one conversation
    at a time; the longest conversation, which is one row of the result, bounds the memory.
    """
    rows = paths.select("tree", "branch", "depth", "role", "text").repartition("tree", "branch").sortWithinPartitions("tree", "branch", "depth")
    kind = rows.schema["tree"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, out, size = None, [], [], 0
        types: list = []

        def close() -> None:
            nonlocal size
            made = format_turns(turns, trained)
            out.append((*key, made.text, [{"first": a, "last": b} for a, b in made.spans]))
            size += len(made.text)

        def batch() -> pa.RecordBatch:
            nonlocal size
            made = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=["tree", "branch", "formatted", "loss"])
            out.clear()
            size = 0
            return made

        for b in batches:
            types = [b.schema.field("tree").type, b.schema.field("branch").type, pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))]
            for tree, branch, role, text in zip(*[b.column(x).to_pylist() for x in ("tree", "branch", "role", "text")]):
                if (tree, branch) != key:
                    if key is not None:
                        close()
                    key, turns = (tree, branch), []
                turns.append((role, text))
                if size > 4 << 20:
                    yield batch()
        if key is not None:
            close()
        if out:
            yield batch()

    return rows.mapInArrow(run, f"tree {kind}, branch int, formatted string, loss array<struct<first:bigint,last:bigint>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted text holds: ``tree``, ``n_turns``, ``turns`` (role, newline, text, newline of
    each), ``masked`` (the unescaped text under the mask) and ``formatted_chars``."""
    kind = formatted.schema["tree"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, loss = b.column("formatted").to_pylist(), b.column("loss").to_pylist()
            turns = [read_turns(t) for t in texts]
            masked = ["".join(unescape(t[s["first"] : s["last"]]) for s in spans) for t, spans in zip(texts, loss)]
            cols = [b.column("tree"), pa.array([len(x) for x in turns], type=pa.int64()), pa.array(["".join(f"{r}\n{t}\n" for r, t in x) for x in turns], type=pa.string()),
                    pa.array(masked, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["tree", "n_turns", "turns", "masked", "formatted_chars"])

    return formatted.select("tree", "formatted", "loss").mapInArrow(run, f"tree {kind}, n_turns bigint, turns string, masked string, formatted_chars bigint")
