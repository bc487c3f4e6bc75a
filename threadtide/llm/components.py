"""Connected components by alternating star contractions: each round is two combinable aggregates and two joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadtide.llm.shared import cut

#: Rounds grow with the logarithm of the longest chain; more than this means that something is wrong.
MAX_ROUNDS = 60


def _pointed(edges: DataFrame, from_node: str, to_node: str) -> DataFrame:
    return edges.select(F.col(from_node).alias("node"), F.col(to_node).alias("other"))


def _star(pairs: DataFrame) -> DataFrame:
    """Link every `other` of a node, and the node itself, to the least of them all."""
    least = pairs.groupBy("node").agg(F.min("other").alias("least")).withColumn("least", F.least("node", "least"))
    moved = pairs.join(least, "node").select(F.col("other").alias("hi"), F.col("least").alias("lo"))
    own = least.select(F.col("node").alias("hi"), F.col("least").alias("lo"))
    return moved.unionByName(own).where("hi <> lo").distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """node and component (least node it is connected to) of every node of an undirected edge list.

    Self links and repeated edges change nothing; null ends are no nodes; an empty list has no rows.
    """
    found = cut(
        edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo")).distinct()
    )
    state = None
    for _ in range(MAX_ROUNDS):
        both = _pointed(found, "hi", "lo").unionByName(_pointed(found, "lo", "hi"))
        large = _large(both)
        found = cut(_star(_pointed(large, "hi", "lo")))
        now = found.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == state:
            return found.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                found.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        state = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _large(both: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    least = both.groupBy("node").agg(F.min("other").alias("least")).withColumn("least", F.least("node", "least"))
    return (
        both.where("other > node").join(least, "node")
        .select(F.col("other").alias("hi"), F.col("least").alias("lo")).where("hi <> lo").distinct()
    )
