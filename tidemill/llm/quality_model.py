"""Quality scores from boosted trees over statistics of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemill.llm import boosting
from tidemill.llm.stats import COUNTS, EXTRA, text_stats
from tidemill.llm.tables import checkpointed, first_by_hash

#: Most labelled ids that the trees are fitted on, taken in the order of a hash of the id.
FIT_ROWS = 20_000

SHARES = {
    "n_symbols": "n_chars", "n_upper": "n_chars", "n_digits": "n_chars", "n_punct": "n_chars", "n_pipes": "n_chars", "n_bangs": "n_chars", "n_wide": "n_chars",
    "n_dup_lines": "n_lines", "n_words": "n_lines", "n_repeat_words": "n_words", "n_run_words": "n_words", "n_distinct_words": "n_words",
    "n_cap_words": "n_words", "n_short_words": "n_words", "n_long_words": "n_words", "word_chars": "n_words",
}


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Shares and the log of the length, one row per text."""
    cols = [counts[a] / np.maximum(counts[b], 1) for a, b in SHARES.items()]
    return np.stack([np.log1p(counts["n_words"]), *cols], axis=1).astype(float)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0)).cast("int")


def score(docs: DataFrame, labels: DataFrame, *, label: str = "quality", doc_id: str = "doc_id", text: str = "text", parts: int = 3, held: int = 1, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``score`` and ``predicted``.

    Labels are read only of ids outside the held-out part; a null label is none, and an id labelled
    twice takes its larger label. Null and empty texts are scored like any other, as texts without
    words; so is everything when there is no label at all (score one half). Of rows that share an id one is learned
    from, the one with the least counts. Whole texts are read, however long.
    """
    table = checkpointed(text_stats(docs, [doc_id], text, extra=True).withColumnRenamed("k0", "doc_id"))
    known = labels.select(labels[doc_id].alias("doc_id"), labels[label].cast("int").alias("label")).where("label is not null and doc_id is not null")
    known = known.where(fold(F.col("doc_id"), parts) != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    # At most ``fit_rows`` ids, so the statistics stay where they are; then one row an id.
    known = checkpointed(first_by_hash(known, "doc_id", fit_rows))
    rows = table.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(*COUNTS, *EXTRA)).alias("s"))
    sample = rows.select("doc_id", "label", "s.*").orderBy(F.xxhash64("doc_id")).toPandas()
    counts = {n: sample[n].to_numpy() for n in COUNTS + EXTRA}
    trees = boosting.grow(features(counts), (sample["label"].to_numpy() > 0).astype(float))
    held_model = table.sparkSession.sparkContext.broadcast(vars(trees))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = boosting.Trees(**held_model.value)
        for b in batches:
            x = features({n: b.column(n).to_numpy() for n in COUNTS + EXTRA})
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    kind = table.schema["doc_id"].dataType.simpleString()
    out = table.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
