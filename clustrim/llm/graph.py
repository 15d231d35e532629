"""Connected components by alternating large-star and small-star rounds, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _nearest(e: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours, over directed edges (u, v)."""
    return e.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); component is the smallest node reachable.

    Self loops only name a node.  A node in no edge is not returned.  Hubs are safe: the smallest
    neighbour comes from a partial aggregate and is written, so that the join back has two plain exchanges,
    whose hot keys Spark can split.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.write(e, "edges")
    last = None
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star = both.join(scratch.write(_nearest(both), "near"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        loops = e.where("u = v")
        star = scratch.write(star.union(loops).distinct(), "star")
        small = star.join(scratch.write(_nearest(star), "near"), "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
        new = scratch.write(small.distinct(), "edges")
        state = new.where("u != v").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        scratch.drop("star", "near")
        scratch.drop("edges", keep=1)
        e = new
        if (state["n"], state["h"]) == last:
            break
        last = (state["n"], state["h"])
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))

