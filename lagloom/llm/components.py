"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.llm.common import materialize


def _state(edges: DataFrame) -> tuple:
    """Number and order-free digest of the rows: two numbers for the driver."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def stars(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """From links (u, v), u > v, to rows (u, v): v is the smallest node of u's component, for every other node u.

    Rounds end at a fixed point; the number of rounds grows with the logarithm
    of the number of nodes.  Each round is written to the shared folder.
    """
    edges = materialize(edges.select("u", "v").where("u > v").distinct(), "links")
    before = _state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            return edges
        edges = materialize(_small_star(_large_star(edges)), "links")
        after = _state(edges)
        if after == before:
            return edges
        before = after
    raise RuntimeError("components did not settle")
