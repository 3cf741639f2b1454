"""Connected components of an undirected graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.runtime import discard, materialize


def connected_components(edges: DataFrame, *, max_rounds: int = 40) -> DataFrame:
    """(node, component): each node of ``edges`` (a, b) with the least node that it is connected to.

    Every round links each node's larger neighbours to its least one, then each node's smaller
    neighbours likewise, so a chain of length n needs about log n rounds and no neighbourhood is
    gathered in one place. Nulls, loops and repeated edges change nothing; a node only seen
    in loops is its own component; an empty table gives an empty table.
    """
    edges = materialize(edges.select("a", "b"), "edges")  # read twice, computed once
    alone = edges.filter("a = b").select(F.col("a").alias("node")).distinct()
    links = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialize(links, "links")
    before = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        older, links = links, materialize(small, "links")
        discard(older)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    known = members.unionByName(roots).distinct()
    return known.unionByName(alone.join(known, "node", "left_anti").select("node", F.col("node").alias("component")))
