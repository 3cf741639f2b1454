"""The property graph of venues, prototypes, evidence and topics: tables, integrity, neighbours, retrieval, snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ranking import canonical_rank
from rankloom.operators.retrieval import bm25


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, n): dangling ends, repeated nodes, repeated edges and loops of (id, kind) and (source, target, kind); 0 where a rule holds."""
    known = nodes.select("id").distinct()
    end = lambda c: edges.select(F.col(c).alias("id")).join(known, "id", "left_anti")
    parts = {
        "dangling_source": end("source"), "dangling_target": end("target"), "repeated_node": nodes.groupBy("id").count().filter("count > 1"),
        "repeated_edge": edges.groupBy("source", "target", "kind").count().filter("count > 1"), "loop": edges.filter("source = target"),
    }
    out = None
    for rule, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, kind, n): nodes and edges by kind."""
    n = nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("part"), "kind", "n")
    return n.unionByName(edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), "kind", "n"))


def neighbours(seeds: DataFrame, edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(seed, neighbour, kind, direction): what is one edge away from each seed (id), either way."""
    e = edges.filter(F.col("kind").isin(kinds)) if kinds else edges
    s = seeds.select(F.col("id").alias("seed")).distinct()
    out = e.join(s, F.col("source") == F.col("seed")).select("seed", F.col("target").alias("neighbour"), "kind", F.lit("out").alias("direction"))
    back = e.join(s, F.col("target") == F.col("seed")).select("seed", F.col("source").alias("neighbour"), "kind", F.lit("in").alias("direction"))
    return out.unionByName(back).distinct()


def property_graph_run(queries: DataFrame, prototypes: DataFrame, evidence: DataFrame, *, prototype_weight: float = 1.0, evidence_weight: float = 1.0, pool: int = 1000, k: int = 100) -> DataFrame:
    """Run over venues: ranks of their best prototype and best evidence unit by BM25, fused by reciprocal rank.

    ``prototypes`` and ``evidence``: unit_id, doc_id, text; only eligible units. A venue's evidence counts 1 + .15 ln(1 + edges) / ln(1 + most edges)
    times, edges being its evidence units. Each side gives at most ``pool`` venues per query.
    """
    p = bm25(queries, prototypes, unit="unit_id", text="text", doc="doc_id", k=pool)
    e = bm25(queries, evidence, unit="unit_id", text="text", doc="doc_id", k=pool)
    edges = evidence.groupBy("doc_id").agg(F.count("*").alias("edges"))
    most = edges.agg(F.max("edges").alias("most"))
    boost = edges.crossJoin(F.broadcast(most)).select("doc_id", (1 + 0.15 * F.log1p("edges") / F.log1p("most")).alias("boost"))
    parts = p.select("query_id", "doc_id", (prototype_weight / (60 + F.col("rank"))).alias("s"))
    parts = parts.unionByName(e.join(boost, "doc_id").select("query_id", "doc_id", (evidence_weight * F.col("boost") / (60 + F.col("rank"))).alias("s")))
    return canonical_rank(parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 12).alias("score")), k)


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes nodes and edges as Parquet under ``path``; raises before anything is written if the graph is not whole."""
    broken = [r.asDict() for r in integrity(nodes, edges).filter("n > 0").collect()]  # five rows at most
    if broken:
        raise ValueError(f"graph not whole: {broken}")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_snapshot(spark, path: str) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """Nodes and edges of a snapshot."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
