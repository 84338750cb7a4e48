"""Connected components of a graph given as a table of links.

Rounds of two contractions: every node is linked to the least of its neighbours
(larger neighbours first, then smaller ones), until only stars are left. Rounds grow
with the logarithm of a component's diameter; each is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import Table


def _nearest(links: DataFrame) -> DataFrame:
    """(u, least): the least of u and its neighbours v."""
    return links.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _nearest(both)
    moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.filter("least < u").select("u", F.col("least").alias("v"))).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = _nearest(links)
    moved = links.join(least, "u").filter("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct()


def components(links: DataFrame) -> Table:
    """(node, component) for every node of the links (u, v): component is the least node reachable. Loops and repeated links don't matter."""
    ordered = links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = Table(ordered, "links")
    while True:
        ends = now.df.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(now.df.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("root")))
        tangled = ends.groupBy("n").agg(F.sum("child").alias("children"), F.max("root").alias("root")).filter("children > 1 or (children > 0 and root > 0)")
        if tangled.isEmpty():
            break
        after = Table(_small_star(_large_star(now.df)), "links")
        now.drop()
        now = after
    stars = now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = Table(stars.unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    now.drop()
    return out
