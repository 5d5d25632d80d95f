"""Connected components of an edge table, by alternating star contraction on DataFrames.

Every round is two shuffles with map-side combination; no vertex's edges are gathered in one task and nothing but a
count goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.shared import stored


def _large_star(e: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to the smallest vertex of its neighbourhood (itself included)."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(e: DataFrame) -> DataFrame:
    """Each vertex links its smaller neighbours, and itself, to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) long, in any direction and number -> (id, component): the least id that each vertex reaches.

    Self-links and nulls are ignored; vertices without a link to another vertex are not returned. Rounds double the
    reach, so ``most_rounds`` is never met in practice; if it were, an error is raised rather than a wrong result.
    """
    e = stored(
        edges.filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(most_rounds):
        e = stored(_small_star(_large_star(e)), "stars")
        # a forest of stars is a fixed point: number of links and sum of the hashes of all links stay as they were
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        before = now
    raise RuntimeError("components did not settle")
