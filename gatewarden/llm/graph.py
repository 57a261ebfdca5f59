"""Connected components of an edge table, without collecting edges or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node of its component.

    Alternating large-star and small-star steps until nothing changes; each step only takes minima per
    node before it joins, so a hub's neighbours are never gathered.  Steps grow with the logarithm of
    the longest path; each is written to the shared folder.
    """
    e = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    step = 0
    while True:
        # large star: neighbours above a node move to the smallest neighbour
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # small star: a node and the neighbours below it move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m")
        new = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        step += 1
        new = scratch.write(new, f"{name}-{step}")
        same = e.join(new, ["a", "b"], "left_anti").isEmpty() and new.join(e, ["a", "b"], "left_anti").isEmpty()
        if step > 1:
            scratch.drop(f"{name}-{step - 2}")
        e = new
        if same:
            break
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
