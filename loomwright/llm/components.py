"""Connected components of a table of links, by alternating star contractions.

Large-star links each node's larger neighbours to its smallest neighbour, small-star its smaller
ones; the links end as stars round each component's smallest node, after about log(n) rounds. Each
round is a written table, so a lost executor costs one round at most. Nothing is collected but the
number of changed links. A hub of very many links is no hot key: join_counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.dealing import join_counted
from loomwright.session import written


def _star(edges: DataFrame, large: bool, count: int) -> DataFrame:
    """One star step over distinct links (a > b), at most count of them."""
    if large:
        sides = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges
    low = sides.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
    joined = join_counted(sides, low, ["a"], 2 * count).withColumn("low", F.least("low", "a"))
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
    return out.where("a > b").distinct()


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link (a, b); component is the smallest node."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges = written(edges, "links")
    state = None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
        edges = written(_star(edges, True, now[0]), "links")
        edges = written(_star(edges, False, now[0]), "links")
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select("b", "b").distinct())
