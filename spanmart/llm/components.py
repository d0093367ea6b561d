"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmart.llm.common import cut

MAX_ROUNDS = 100


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) for every node of an edge table (a, b) of longs; the component is its smallest node.

    Large stars hang every neighbour above a node onto the smallest one; small stars do so
    for those below.  Rows never outnumber the edges, a node's neighbours are only aggregated
    and joined (never listed), and the rounds grow with the logarithm of the longest chain.
    Every round is written to the shared checkpoint folder.  Null ends are left out.
    """
    both = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    links = cut(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        turned = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = turned.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = turned.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.distinct()
        # Every row now points downwards: hang a node and its lower neighbours onto the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        hung = large.join(low, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        links = cut(hung.unionByName(low.select("a", F.col("least").alias("b"))).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        before = tuple(now)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
