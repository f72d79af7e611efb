"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweave.llm.common import Scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, component: the smallest node of its component) of every node of ``edges(a, b)``, both long.

    In each round every node points to the neighbour, or itself, that comes first in a random order of the round, and
    the edges are contracted along; a chain so shrinks by a constant factor, as a star does at once. Each round's
    edges and pointers are written to the shared folder, until the pointers are followed back at the end. Rows with nulls
    and loops count for nothing; repeated edges count once. No edges: an empty result.
    """
    with Scratch(edges.sparkSession) as scratch:
        live = scratch.write(edges.where("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct(), "edges")
        pointers: list[DataFrame] = []
        while not live.isEmpty():
            rank = lambda c: F.xxhash64(c, F.lit(len(pointers)))
            near = live.select(F.col("a").alias("node"), F.col("b").alias("to")).unionAll(live.select("b", "a"))
            first = F.min(F.struct(rank(F.col("to")).alias("r"), F.col("to"))).alias("best")
            own = F.struct(rank(F.col("node")).alias("r"), F.col("node").alias("to"))
            step = scratch.write(near.groupBy("node").agg(first).select("node", F.least("best", own)["to"].alias("to")), "pointers")
            pointers.append(step)
            moved = live.join(step.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b")
            live = scratch.write(moved.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        if not pointers:
            return edges.sparkSession.createDataFrame([], "node long, component long")
        at = pointers[0]
        for step in pointers[1:]:
            at = at.join(step.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        at = scratch.write(at, "roots", keep=True)
    least = at.groupBy("to").agg(F.min("node").alias("component"))
    return at.join(least, "to").select("node", "component")
