"""Connected components with DataFrame operations only.

Every node points to a parent with a smaller or equal id. Each round hooks parents (and nodes) to the
smallest grandparent among their neighbours and shortens the paths, so the number of rounds grows
with the logarithm of the longest path. All steps are joins whose right side has one row per node and
minima that combine before the shuffle, so a node may have any number of neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemill.llm.tables import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``) for every node of ``edges``; the component is its smallest node.

    Null ends, loops and repeated edges are fine: an edge with a null end is ignored, and a loop only
    makes its node known.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = checkpointed(e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))).distinct())
    parent = checkpointed(both.groupBy(F.col("u").alias("x")).agg(F.least(F.col("x"), F.min("v")).alias("p")))
    while True:
        grand = checkpointed(parent.join(parent.select(F.col("x").alias("p"), F.col("p").alias("g")), "p").select("x", "p", "g"))
        near = both.join(grand.select(F.col("x").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("m"))
        near = near.join(grand.select(F.col("x").alias("u"), "p", "g"), "u")
        hooks = F.array(F.struct(F.col("p").alias("x"), F.col("m").alias("p")), F.struct(F.col("u").alias("x"), F.least("m", "g").alias("p")))
        after = checkpointed(near.select(F.inline(hooks)).groupBy("x").agg(F.min("p").alias("p")))
        # A round that moves no pointer has the answer.
        moved = after.withColumnRenamed("p", "q").join(grand, "x").where("q < p or p <> g").limit(1).count()
        parent = after
        if not moved:
            return parent.select(F.col("x").alias("node"), F.col("p").alias("component"))
