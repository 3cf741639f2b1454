"""The venue catalogue: entity resolution, hard filters, summaries, crosswalks, lookup."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.functions.text import compact_issn, normalize_name, tokens, valid_issn
from rankloom.operators.components import connected_components

# Levels of each ranking, best first.
LEVELS = {"ccf": ("A", "B", "C"), "th_cpl": ("A", "B"), "cas": ("1", "2", "3", "4"), "jcr": ("Q1", "Q2", "Q3", "Q4")}
AT_OR_ABOVE = "及以上"


def parse_targets(values: list[str]) -> list[tuple[str, str]]:
    """(dataset, level) of target expressions such as "CCF-A", "JCR Q1", "中科院2区及以上"; alternatives are separated by commas or bars."""
    out: list[tuple[str, str]] = []
    for raw in re.split(r"[,，;；|/、]|\bor\b|或", " , ".join(values)):
        text = raw.strip()
        if not text:
            continue
        above = text.endswith(AT_OR_ABOVE)
        text = text.removesuffix(AT_OR_ABOVE).strip().lower()
        dataset = next((d for d, names in (("ccf", ("ccf",)), ("th_cpl", ("th-cpl", "th_cpl", "thcpl", "清华")), ("cas", ("cas", "中科院")), ("jcr", ("jcr",))) if any(text.startswith(n) for n in names)), None)
        level = re.search(r"(q[1-4]|[1-4](?=区|$)|[abc])\s*(?:区|类)?$", text)
        if not dataset or not level:
            raise ValueError(f"not a target: {raw.strip()}")
        found = level.group(1).upper()
        if found not in LEVELS[dataset]:
            raise ValueError(f"no such level: {raw.strip()}")
        stop = LEVELS[dataset].index(found)
        for lv in LEVELS[dataset][0 if above else stop : stop + 1]:
            if (dataset, lv) not in out:
                out.append((dataset, lv))
    return out


def at_or_above(level: Column, dataset: str, least: str) -> Column:
    """Whether a level is ``least`` or better."""
    return level.isin(*LEVELS[dataset][: LEVELS[dataset].index(least) + 1])


def resolve_entities(records: DataFrame, *, key: str, keys: dict[str, Column]) -> DataFrame:
    """(key, entity_id): records connected by any equal, non-empty value of ``keys`` are one entity, named by its least record.

    Every value is a node, so a value shared by many records gives as many edges, not their square.
    """
    edges = None
    for kind, c in keys.items():
        e = records.select(F.col(key).cast("bigint").alias("r"), c.alias("v")).filter("v is not null and v <> ''").select(F.concat(F.lit("r"), F.lpad("r", 19, "0")).alias("a"), F.concat(F.lit(f"v:{kind}:"), "v").alias("b"))
        edges = e if edges is None else edges.unionByName(e)
    own = records.select(F.concat(F.lit("r"), F.lpad(F.col(key).cast("bigint"), 19, "0")).alias("a")).select("a", F.col("a").alias("b"))
    found = connected_components(edges.unionByName(own)).filter("node like 'r%'")
    return found.select(F.substring("node", 2, 19).cast("bigint").alias(key), F.substring("component", 2, 19).cast("bigint").alias("entity_id"))


def hard_filter(rows: DataFrame, *, entity: str, target: Column, area: Column, scope: Column, reviewed: Column) -> DataFrame:
    """Complete groups of the entities that pass: area on rows of the target only, scope and review on any row."""
    passed = rows.groupBy(entity).agg(F.max(F.when(target & area, 1)).alias("t"), F.max(F.when(scope, 1)).alias("s"), F.max(F.when(reviewed, 1)).alias("r")).filter("t = 1 and s = 1 and r = 1")
    return rows.join(passed.select(entity), entity, "left_semi")


def area_summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def group_text(rows: DataFrame, *, by: str, order: str, value: str, separator: str = " | ") -> DataFrame:
    """Distinct values of each group in order of first occurrence, joined."""
    first = rows.filter(F.col(value).isNotNull() & (F.trim(value) != "")).groupBy(by, value).agg(F.min(order).alias("o"))
    listed = F.array_sort(F.collect_list(F.struct("o", value)))
    return first.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x[value]), separator).alias("text"))


def issn_tokens(rows: DataFrame, *, key: str, issns: str) -> DataFrame:
    """(key, issn): valid ISSNs of each row, in one spelling."""
    t = rows.select(key, F.explode(issns).alias("raw"))
    return t.filter(valid_issn(F.col("raw"))).select(key, compact_issn(F.col("raw")).alias("issn")).distinct()


def issn_crosswalk(cases: DataFrame, owners: DataFrame, *, key: str, entity: str) -> DataFrame:
    """(key, status, entity): exact with exactly one owner of any ISSN, ambiguous with several, unmapped with none."""
    hits = cases.join(owners, "issn", "left").groupBy(key).agg(F.countDistinct(entity).alias("n"), F.min(entity).alias(entity))
    return hits.select(key, F.when(F.col("n") == 1, "exact").when(F.col("n") > 1, "ambiguous").otherwise("unmapped").alias("status"), F.when(F.col("n") == 1, F.col(entity)).alias(entity))


def strict_universe(owners: DataFrame, *, entity: str) -> DataFrame:
    """(entity): entities none of whose ISSNs belongs to another one."""
    shared = owners.groupBy("issn").agg(F.countDistinct(entity).alias("n")).filter("n > 1").select("issn")
    return owners.select(entity).distinct().join(owners.join(shared, "issn", "left_semi").select(entity).distinct(), entity, "left_anti")


def lookup(rows: DataFrame, needle: str, fields: list[str]) -> DataFrame:
    """Rows whose field equals or contains the needle; exact ones first, with the fields that matched."""
    n = F.lit(needle.strip().lower())
    exact = F.array_compact(F.array(*[F.when(F.lower(f) == n, F.lit(f)) for f in fields]))
    part = F.array_compact(F.array(*[F.when(F.lower(f).contains(n), F.lit(f)) for f in fields]))
    return rows.withColumn("exact", F.size(exact) > 0).withColumn("matched", F.array_join(part, ",")).filter(F.col("matched") != "")


def fused_score(bm25: Column, best: Column, cosine: Column, graph: Column, phrase: Column, exact: Column) -> Column:
    """Browser fusion: 100 (.6 bm25/max + .3 cosine + .1 graph), 8 more for the phrase, at most 99; 100 for an exact name."""
    base = 100 * (0.6 * F.when(best > 0, bm25 / best).otherwise(0.0) + 0.3 * cosine + 0.1 * graph) + F.when(phrase, 8).otherwise(0)
    return F.when(exact, F.lit(100.0)).otherwise(F.least(F.lit(99.0), base))


def explainable_scores(query: DataFrame, documents: DataFrame, fields: dict[str, float], *, key: str, concepts: DataFrame | None = None) -> DataFrame:
    """Online ranking formula: per word the best field weight times its idf times min(count, 2), concepts with their own
    idf, divided by the root of the number of words and concepts; with the top matched words.

    ``query``: term, count (one query). ``concepts``: doc key and concept weight already multiplied by its idf.
    """
    parts = None
    for name, w in fields.items():
        p = documents.select(F.col(key).alias("doc_id"), F.explode(F.array_distinct(tokens(F.col(name)))).alias("term")).select("doc_id", "term", F.struct(F.lit(float(w)).alias("w"), F.lit(name).alias("field")).alias("f"))
        parts = p if parts is None else parts.unionByName(p)
    best = parts.groupBy("doc_id", "term").agg(F.max("f").alias("f"))
    n = documents.select(key).distinct().agg(F.count("*").alias("n"))
    df = best.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    size = query.agg(F.count("*").alias("size"))
    hits = best.join(query, "term").join(df, "term").withColumn("part", F.col("f.w") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1) * F.least("count", F.lit(2)))
    summed = hits.groupBy("doc_id").agg(F.sum("part").alias("raw"), F.slice(F.sort_array(F.collect_list(F.struct("part", "term")), asc=False), 1, 6).alias("top"))
    if concepts is not None:
        summed = summed.join(concepts.groupBy("doc_id").agg(F.sum("weight").alias("c"), F.count("*").alias("k")), "doc_id", "left")
        summed = summed.withColumn("raw", F.col("raw") + F.coalesce("c", F.lit(0.0)))
    return summed.crossJoin(F.broadcast(size)).select("doc_id", F.round(F.col("raw") / F.sqrt(F.greatest("size", F.lit(1))), 9).alias("score"), F.array_join(F.transform("top", lambda x: x["term"]), ",").alias("terms"))


def bonus(raw: Column, similarity: Column, graph: Column, mixed: Column) -> Column:
    """Semantic bonuses: 6 above a similarity of .35, 4 for the graph, 5 for the mixed channel."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return raw + 6 * F.greatest(F.lit(0.0), (similarity - 0.35) / 0.65) + 4 * clamp(graph) + 5 * clamp(mixed)


def top_per_stratum(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rn") <= n)


def name_key(c: Column) -> Column:
    return normalize_name(c)
