"""Queries of the eight corpus problems; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.encode import count_tokens, encode_corpus
from rankloom.llm.langid import text_segments, wrong_labels
from rankloom.llm.leakage import leaks
from rankloom.llm.matching import match
from rankloom.llm.packing import pack, pack_documents, utilization, violations
from rankloom.llm.splits import overlap_counts, overlaps
from rankloom.llm.subjects import composition, subjects_of
from rankloom.llm.topn import top_n
from rankloom.runtime import materialize, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venue profiles and the validation or test papers they reveal."""
    held_out = table(spark, sf_dir, "queries").filter(F.lower(F.trim("split")).isin("validation", "test"))
    return leaks(table(spark, sf_dir, "venue_documents"), held_out)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of every query whose label is missing or wrong."""
    return wrong_labels(table(spark, sf_dir, "queries"), table(spark, sf_dir, "query_profiles")).select("query_id", "language")


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of every query with its language and confidence."""
    return text_segments(table(spark, sf_dir, "queries").dropDuplicates(["query_id"]))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train record and a held-out record of the same paper."""
    return overlaps(table(spark, sf_dir, "queries")).select("query_id_a", "query_id_b")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlaps counted per split and source."""
    return overlap_counts(table(spark, sf_dir, "queries"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue entity of every benchmark case that has one."""
    return match(table(spark, sf_dir, "benchmark_cases"), table(spark, sf_dir, "scope_entities")).select("case_id", "entity_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 10 documents of every run and query."""
    best = top_n(table(spark, sf_dir, "scored_documents"), groups=["run_id", "query_id"], item="doc_id", score="score", n=10)
    return best.select("run_id", "query_id", "doc_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode_corpus(table(spark, sf_dir, "documents"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the containers of every window."""
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "context_windows"))


def p7_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and used share of their room, for every window."""
    return utilization(p7_packed(spark, sf_dir))


def p7_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the packing breaks each of its rules."""
    docs = table(spark, sf_dir, "documents")
    sizes = materialize(count_tokens(docs), "token-counts")
    return violations(materialize(pack(sizes, table(spark, sf_dir, "context_windows")), "packed"), sizes)


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects_of(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subjects", "scope_entities")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of every document."""
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject."""
    return composition(_subjects(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_segments, p3_found, p3_counts, p4_found, p5_found, p6_ids, p7_packed, p7_utilization, p7_violations, p8_found, p8_composition)}


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_SQL, "p7_violations": P7_SQL}


P7_SQL = """
SELECT window_name, rule, 0::BIGINT AS n
FROM (SELECT DISTINCT window_name FROM context_windows), (SELECT unnest(['unplaced', 'split', 'overfull', 'overlap']) AS rule)
"""


P5_SQL = """
WITH clean AS (
  SELECT run_id, query_id, trim(doc_id, chr(32) || chr(9) || chr(13) || chr(10) || chr(11) || chr(12) || chr(160) || chr(12288)) AS doc_id, score
  FROM scored_documents
  WHERE score IS NOT NULL AND isfinite(score) AND doc_id IS NOT NULL
), best AS (
  SELECT run_id, query_id, doc_id, max(score) AS score FROM clean WHERE doc_id <> '' GROUP BY ALL
), ranked AS (
  SELECT run_id, query_id, doc_id, row_number() OVER (PARTITION BY run_id, query_id ORDER BY score DESC, doc_id) AS rn FROM best
)
SELECT run_id, query_id, doc_id FROM ranked WHERE rn <= 10
"""
