"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.functions.skew import lookup_join
from codelake.functions.storage import Stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").bitwiseAND(F.lit(0xFFFFFF)))).first())


def _stars(links: DataFrame) -> bool:
    """Whether every node has one link to a smaller one or none, and only nodes without one are linked to."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("out")))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return seen.where("out > 1 or (out > 0 and least = 0)").isEmpty()


def components(edges: DataFrame, store: Stored) -> DataFrame:
    """Columns ``node`` and ``label``, the least node of its component.

    ``edges`` has columns ``a`` and ``b``. Rounds of large-star and small-star
    steps: each links nodes to the least node they know, so the rounds grow
    with the logarithm of a component's size. Nodes stay rows throughout; the
    least neighbour is a sum that combines before the shuffle, and a node with
    very many neighbours is salted where they meet it. Every round is a table in
    the shared folder.
    """
    current = store.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    known = _digest(current)
    while True:
        both = _both(current)
        # Each node's larger neighbours go to the least of its neighbourhood.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = lookup_join(both.where("b > a"), least, ["a"], "inner").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        # Each node and its smaller neighbours go to the least of them. No node has many left here: those
        # of a common neighbour now point to one least node each.
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        moved = F.explode(F.array(F.col("a"), F.col("b"))).alias("a")
        small = large.join(least, "a").select(moved, F.col("low").alias("b"))
        current = store.table(small.where("a <> b").distinct(), "links")
        now = _digest(current)
        # Stars stay as they are in a further round, which need not be run to see it.
        if now == known or (now[0] == known[0] and _stars(current)):
            break
        known = now
    tops = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(tops)
