"""Building corpora of papers and profiles: reject ladders, merges, profiles, samples, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reject_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, else ok."""
    c = F.lit("ok")
    for name, test in reversed(rules):
        c = F.when(test, name).otherwise(c)
    return c


NOTICE = r"(?i)^\s*(correction|erratum|corrigendum|retraction|editorial|preface|book review|call for|index of|acknowledg\w*|勘误|编者按)"


def is_notice(title: Column) -> Column:
    return F.coalesce(title.rlike(NOTICE), F.lit(False))


def keep_longest(rows: DataFrame, *, by: str, text: str, order: str) -> DataFrame:
    """One row per key: the longest text, the first in order among equals."""
    w = Window.partitionBy(by).orderBy(F.coalesce(F.length(text), F.lit(-1)).desc(), F.col(order))
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def merge_papers(rows: DataFrame, *, by: str, title: str, abstract: str, source: str) -> DataFrame:
    """One row per paper: longest title and abstract (least text among equals) and all sources."""
    longest = lambda c: F.max_by(c, F.struct(F.length(c), F.hex(c)))
    return rows.groupBy(by).agg(longest(title).alias(title), longest(abstract).alias(abstract), F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"), F.count("*").alias("n"))


def latest(rows: DataFrame, *, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def profile_grades(papers: DataFrame, *, by: str, abstract: str) -> DataFrame:
    """Per venue: papers, abstracts, grade A to D and tier warm, few-shot, cold."""
    p = papers.groupBy(by).agg(F.count("*").alias("papers"), F.count(F.when(F.length(F.trim(abstract)) > 0, 1)).alias("abstracts"))
    grade = F.when(F.col("abstracts") >= 10, "A").when(F.col("papers") >= 10, "B").when(F.col("papers") >= 1, "C").otherwise("D")
    tier = F.when(F.col("papers") >= 5, "warm").when(F.col("papers") >= 1, "few-shot").otherwise("cold")
    return p.withColumn("grade", grade).withColumn("tier", tier)


def hash_bucket(c: Column, buckets: int) -> Column:
    """Bucket of the first eight hexadecimal digits of SHA-256."""
    return (F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def fallback_prototypes(papers: DataFrame, *, by: str, key: str, date: str, text: str, buckets: int = 4, newest: int = 8) -> DataFrame:
    """Prototypes of a venue: papers in hash buckets, the newest of each, joined."""
    b = papers.withColumn("bucket", hash_bucket(F.col(key), buckets))
    w = Window.partitionBy(by, "bucket").orderBy(F.col(date).desc_nulls_last(), F.col(key))
    kept = b.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= newest)
    return kept.groupBy(by, "bucket").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(text).alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def temporal_split(date: Column, train_end: str, dev_end: str) -> Column:
    """train, dev or test by ISO dates; null dates are undated."""
    return F.when(date.isNull(), "undated").when(date <= train_end, "train").when(date <= dev_end, "dev").otherwise("test")


def digest_part(c: Column, divisor: int) -> Column:
    """Stable part of a key: the first 15 hexadecimal digits of SHA-256 modulo ``divisor``."""
    return (F.conv(F.substring(F.sha2(c, 256), 1, 15), 16, 10).cast("bigint") % divisor).cast("int")


def seeded_sample(rows: DataFrame, *, by: list[str], key: str, seed: str, n: int) -> DataFrame:
    """``n`` rows of each stratum in order of a seeded digest."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256)
    w = Window.partitionBy(*by).orderBy(digest, key)
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def upsert(base: DataFrame, updates: DataFrame, *, key: str, columns: list[str]) -> DataFrame:
    """Every row of a key takes the non-null values of its update."""
    u = updates.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = base.join(u, key, "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def densify(grid_left: DataFrame, grid_right: DataFrame, facts: DataFrame, keys: list[str], fill: dict[str, object]) -> DataFrame:
    """Every combination of two small dimensions with its facts; missing ones filled."""
    return grid_left.crossJoin(F.broadcast(grid_right)).join(facts, keys, "left").na.fill(fill)


def inverted_abstract(words: Column) -> Column:
    """Text of a map from word to positions."""
    placed = F.flatten(F.transform(F.map_entries(words), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")
