"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualis.llm.common import stored


def star(links: DataFrame, large: bool) -> DataFrame:
    """Every node hands its smallest neighbour to its larger neighbours (large star), or to its
    smaller ones and itself (small star). A node's minimum is aggregated before it meets its links."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        new = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = both.where("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        new = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return new.where("u <> v").distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``u, root`` for every node of the links ``u, v``; the root is the smallest node reachable.

    Each round is written to the shared folder, which cuts the lineage. It ends when the links no longer change:
    each node then points to its root. Rounds grow with the logarithm of the longest path.
    """
    links = stored(links.select("u", "v").where("u <> v").distinct(), label)
    before = None
    while True:
        links = stored(star(star(links, large=True), large=False), label)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return links.select("u", F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
