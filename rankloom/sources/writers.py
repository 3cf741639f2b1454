"""Sinks: runs with manifests, vectors, knowledge-graph exports, CSV for spreadsheets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.quality import canonical_json_digest


def run_digest(run: DataFrame) -> str:
    """Digest of a run that does not depend on the order of its rows."""
    r = run.agg(F.count("*").alias("n"), F.sum(F.xxhash64("query_id", "doc_id", "rank").cast("decimal(38,0)")).alias("s")).first()
    return canonical_json_digest([r["n"], str(r["s"])])


def write_run(run: DataFrame, path: str, *, method: str, top_k: int) -> dict:
    """Writes a ranked run as Parquet, sorted within query, then its manifest; the manifest comes last, so a run without one is not whole."""
    run.repartition("query_id").sortWithinPartitions("query_id", "rank").write.mode("overwrite").parquet(f"{path}/rows")
    stored = run.sparkSession.read.parquet(f"{path}/rows")
    counts = stored.agg(F.count("*").alias("rows"), F.countDistinct("query_id").alias("queries")).first()
    manifest = {"schema": 1, "method": method, "top_k": top_k, "rows": counts["rows"], "queries": counts["queries"], "digest": run_digest(stored)}
    run.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def write_vectors(vectors: DataFrame, path: str, *, vector: str) -> None:
    """Vectors as array<float>; lengths must be one (within .001)."""
    n = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    if vectors.filter((n < 0.999) | (n > 1.001)).limit(1).count():
        raise ValueError("vectors must be normalised")
    vectors.withColumn(vector, F.col(vector).cast("array<float>")).write.mode("overwrite").parquet(path)


def knowledge_graph(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Chunks, entities and relationships of a graph (nodes: id, type, name, text; edges: src, rel, dst)."""
    return {
        "chunks": nodes.filter("text is not null and text <> ''").select(F.col("id").alias("source_id"), F.col("text").alias("content")),
        "entities": nodes.select(F.concat_ws(":", "type", "id").alias("entity_name"), F.col("type").alias("entity_type"), F.col("name").alias("description"), F.col("id").alias("source_id")),
        "relationships": edges.select(F.col("src").alias("src_id"), F.col("dst").alias("tgt_id"), F.col("rel").alias("keywords"), F.concat_ws(" ", "src", "rel", "dst").alias("description")),
    }


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; cells that a spreadsheet would run as formulas are quoted by an apostrophe."""
    safe = [F.when(F.col(c).cast("string").rlike(r"^[=+\-@\t]"), F.concat(F.lit("'"), F.col(c).cast("string"))).otherwise(F.col(c).cast("string")).alias(c) for c in df.columns]
    df.select(*safe).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
