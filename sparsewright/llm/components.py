"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsewright.llm.store import cut


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the least of u's neighbourhood."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of integers -> (node, root): the least node that each linked node reaches.

    Each round is written out, so a lost executor costs one round at most.
    Unlinked nodes have no row.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")))
    was = None
    while True:
        seen = tuple(now.agg(mark.alias("m")).first()[0])
        if seen == was or not seen[0]:
            break
        was = seen
        now = cut(_small(_large(now)), "edges")
    rooted = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rooted.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
