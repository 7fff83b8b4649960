"""Connected components of a link table, by large and small stars.

Each round points every node at the least node around it, first from above,
then from below; links become stars on the least node of their component in a
number of rounds that grows with the logarithm of the longest path. Every step
is an aggregate with a map-side combine and a join on a written table, so a
node with very many links is split like any skewed key. The driver sees two
numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b) with a > b, distinct."""
    if large:
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = links
    least = written(around.groupBy("a").agg(F.min("b").alias("m"))
                    .select("a", F.least("a", "m").alias("m")), "component-least")
    moved = around.join(least, "a")
    out = moved.where(F.col("b") > F.col("a")) if large else moved
    out = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; ``component`` is the least
    node reachable. ``links``: two columns a, b of one ordered type, in any
    direction, repeats and loops allowed."""
    ordered = (links.where(F.col("a") != F.col("b"))
               .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now = written(ordered, "component-links")

    def mark(t: DataFrame):
        return t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    seen = mark(now)
    while seen[0]:
        now = written(_star(written(_star(now, True), "component-links"), False), "component-links")
        new = mark(now)
        if new == seen:
            break
        seen = new
    return (now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")))
            .distinct())
