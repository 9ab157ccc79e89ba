"""Distributed connected components by contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import written


def contract(links: DataFrame) -> list[DataFrame]:
    """Rounds of contraction: tables (node, into) that lead every linked node to one node of its component.

    Each round, every node goes into the neighbour (or itself) of most neighbours, ties by a hash of
    node and round, so a repeated task decides the same. Nodes that stay are not linked with each
    other and have as many neighbours as any of theirs, so those are at least as many as they, and
    all move: every round leaves half of the nodes at most, a star's centre alone. Links inside a
    merged node vanish.
    """
    edges = links.select("a", "b").where("a <> b").distinct()
    rounds: list[DataFrame] = []
    while True:
        edges = written(edges, "links")
        if edges.isEmpty():
            return rounds
        turn = F.lit(len(rounds))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct((-F.col("d")).alias("d"), F.xxhash64(turn, c).alias("p"), F.col(c).alias("id"))
        degrees = both.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
        ranked = both.join(degrees.withColumnRenamed("a", "b"), "b").select("a", rank("b").alias("m"))
        best = ranked.groupBy("a").agg(F.min("m").alias("m"), F.count(F.lit(1)).alias("d"))
        into = F.least(F.col("m"), rank("a"))["id"]
        moves = written(best.select(F.col("a").alias("node"), into.alias("into")).where("node <> into"), "moves")
        rounds.append(moves)
        for end in ("a", "b"):
            moved = moves.select(F.col("node").alias(end), F.col("into").alias("_into"))
            edges = edges.join(moved, end, "left").withColumn(end, F.coalesce("_into", end)).drop("_into")
        edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in ``links`` (columns a, b of one type that has an order); component is its smallest node.

    Loops and repeated links do no harm; without links the result is empty. Nothing is collected:
    every round is a grouping and two joins on node ids; a node with very many links has them
    pre-aggregated before the shuffle, and its joins are split by adaptive execution.
    """
    rounds = contract(links)
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    # A node of one round may be the goal of others of that round, so every round is looked up in later ones only.
    final = rounds[-1]
    for moves in reversed(rounds[:-1]):
        later = final.select(F.col("node").alias("into"), F.col("into").alias("_last"))
        led = moves.join(later, "into", "left").select("node", F.coalesce("_last", "into").alias("into"))
        final = written(led.unionByName(final.join(moves.select("node"), "node", "left_anti")), "members")
    members = final.unionByName(final.select(F.col("into").alias("node"), "into")).distinct()
    smallest = members.groupBy("into").agg(F.min("node").alias("component"))
    return members.join(smallest, "into").select("node", "component")
