"""Connected components of a graph of ids (numbers or strings), by alternating large-star and small-star steps.

Every step is a map and one grouping. A node's star is rewired to its smallest
neighbour, so paths shorten by half per round and the number of edges never grows.
Neighbour lists are never gathered in one place: the minimum per node is an aggregate
that combines before the shuffle, and the edges meet it in a join whose large keys are
split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .lineage import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Rewire (a, b): to the smallest of a's neighbours and a itself."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
    joined = both.join(least, both["a"] == least["of"])
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component is its smallest node.

    Each round is written to the shared folder, so a lost executor costs one round. Raises if ``rounds`` are not enough.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        state = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h"), F.count_distinct("a").alias("d")).first()
        # Done when every node has one edge, to its root, and no root has one itself; a round that changes nothing shows it.
        if state["n"] == 0 or state == before:
            break
        before = state
        edges = stored(_star(_star(edges, True), False))
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
