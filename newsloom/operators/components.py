"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.runtime import checkpointed

#: Nodes up to this many have their minima broadcast. Beyond, edges that make a node a hub, and the hubs that are broadcast.
MOST_NODES, HUB, MOST_HUBS = 100_000, 200, 200_000


def _with_least(edges: DataFrame, node: str, other: str, small: bool) -> tuple[DataFrame, DataFrame]:
    """edges with m, the smallest `other` of their `node`, and the table (node, m) itself.

    The minima are summed up before the shuffle. A small graph's minima are broadcast. In a large one the edges of hubs meet them
    by a broadcast, where they lie, so only nodes of few edges are shuffled by their key; there are at most edges / HUB hubs, and
    above MOST_HUBS they are shuffled like the others.
    """
    least = edges.groupBy(node).agg(F.min(other).alias("m"), F.count("*").alias("n"))
    if small:
        least = least.drop("n")
        return edges.join(F.broadcast(least), node), least  # at most MOST_NODES rows
    least = checkpointed(least)
    hubs = least.where(F.col("n") > HUB)
    least = least.drop("n")
    known = hubs.limit(MOST_HUBS + 1).count()
    if not 0 < known <= MOST_HUBS:
        return edges.join(least, node), least
    hubs = hubs.select(F.col(node).alias("hub"), F.col("m").alias("hub_m"))
    met = edges.join(F.broadcast(hubs), F.col(node) == F.col("hub"), "left")
    few = met.where("hub is null").select(*edges.columns).join(least, node)
    return met.where("hub is not null").select(*edges.columns, F.col("hub_m").alias("m")).unionByName(few), least


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node ties its larger neighbours to the smallest node it knows."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select("b", "a"))
    met, _ = _with_least(both, "v", "u", small)
    return met.where("u > v").select(F.col("u").alias("a"), F.least("v", "m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node ties its smaller neighbours, and itself, to the smallest of them."""
    met, least = _with_least(edges, "a", "b", small)
    across = met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return across.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); label is the smallest node of its component.

    Loops and repeated edges do no harm; no edges give no rows. Every round is a few shuffles of edges, with partial minima before
    them; edges of hubs are not shuffled by the hub. Rounds grow with the logarithm of the longest path.
    """
    stars = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    n, before = stars.count(), None
    while True:
        small = 2 * n <= MOST_NODES
        stars = checkpointed(_small_star(_large_star(stars, small), small))
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).union(stars.select("b", "b").distinct())
        n, before = state[0], state
