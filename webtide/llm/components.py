"""Connected components of a link table, by large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).
Both steps replace links without changing the components, until every node
links straight to the smallest node of its component. No step gathers a
node's neighbours: each is an aggregate (with map-side combine) joined back
to the links, so a node with very many links is split like any skewed join.
Each round is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    up = links.select(F.col("b").alias("a"), F.col("a").alias("v"))  # neighbours above a
    return up.join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    down = links.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """``links`` has columns a, b (comparable, not null). Returns (node,
    component): every node that has a link, with the smallest node that it
    reaches. Self-links and repeated links are allowed; an empty table gives
    an empty table. ``rounds`` bounds the loop far above the logarithmic
    number that the method needs; passing it is an error, not a result."""
    links = stored(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()

    seen = mark(links)
    for _ in range(rounds):
        if not seen[0]:
            break
        links = stored(_small_star(_large_star(links)))
        now = mark(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
