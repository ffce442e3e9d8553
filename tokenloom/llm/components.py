"""Connected components of an edge table, by alternating star contractions in the shared folder.

Public method (Kiveris et al., "Connected Components in MapReduce and Beyond"). Every round is
written out, so lineage stays short and a lost executor costs one round at most. The minimum per
node combines before its shuffle; a hub's edges are joined, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger node ``a`` to the smaller ``b``."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(low, "a")
    side = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return side.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: for every node of ``edges`` (long ``a``, ``b``) the smallest id reachable.

    Loops and repeated edges are allowed; nodes without an edge do not appear. No edges: no rows.
    """
    state = materialize(
        edges.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )

    def mark(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    seen = mark(state)
    while seen[0]:
        state = materialize(_small(_large(state).distinct()), "stars")
        now = mark(state)
        if now == seen:
            break
        seen = now
    roots = state.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return state.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
