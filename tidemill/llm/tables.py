"""Scratch tables and joins that check the size of a side before they send it to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemill.session import checkpointed

#: Keys that one task may hold: 2 million longs are 16 MB.
FEW_KEYS = 2_000_000


def keep_keys(df: DataFrame, keys: DataFrame, column: str, anti: bool = False, few: int = FEW_KEYS) -> DataFrame:
    """Rows of ``df`` whose key is (or with ``anti`` is not) in ``keys``, a counted one-column table.

    Up to ``few`` keys go to every task and ``df`` stays where it is; more are joined by shuffle.
    """
    right = keys.select(F.col(column).alias("__key"))
    if right.count() <= few:
        right = F.broadcast(right)
    else:
        right = right.hint("shuffle_hash")
    how = "left_anti" if anti else "left_semi"
    return df.join(right, F.col(column).eqNullSafe(F.col("__key")), how)


def first_by_hash(keys: DataFrame, column: str, rows: int) -> DataFrame:
    """The first ``rows`` rows of a table with distinct ``column``, in the order of its hash.

    Counted rows give a bound on the hash, so that little more than ``rows`` of them are ever sorted. The bound leaves
    six standard deviations to spare; should that not be enough, a few rows less are returned.
    """
    lot, found = F.xxhash64(column), keys.count()
    share = (rows + 6 * rows**0.5 + 50) / max(found, 1)
    if share < 1:
        keys = keys.where(lot < int((share - 0.5) * 2.0**64))
    return keys.orderBy(lot, column).limit(rows)


def with_document(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with ``__document``, by which rows are kept or dropped: the id, or the hash of the text of a row without one."""
    own = docs[doc_id]
    return docs.withColumn("__document", F.struct(own.alias("id"), F.when(own.isNull(), F.xxhash64(docs[text].cast("string"))).otherwise(0).alias("text")))


__all__ = ["FEW_KEYS", "checkpointed", "first_by_hash", "keep_keys", "with_document"]
