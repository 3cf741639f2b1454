"""Audits and reviews: label handling, exclusions, blinded pools, agreement, coverage, candidate features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.functions.text import shingle_similarity


def enrich(records: DataFrame, scopes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Records with the scope of equal ``keys``, and status matched, ambiguous (several scopes; none is taken) or unmatched.

    Null keys match nothing. Records keep their number of rows.
    """
    one = scopes.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in columns])
    joined = records.join(one, keys, "left")
    status = F.when(F.col("_n").isNull(), "unmatched").when(F.col("_n") > 1, "ambiguous").otherwise("matched")
    return joined.withColumn("status", status).withColumns({c: F.when(F.col("_n") == 1, F.col(c)) for c in columns}).drop("_n")


def unmatched(scopes: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Scopes that no record takes."""
    return scopes.join(records.select(*keys).distinct(), keys, "left_anti")


def translate(qrels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Qrels in another namespace: (query_id, doc_id, gain) through (old, new); several that meet keep the greatest gain, unmapped ones keep a null doc_id."""
    moved = qrels.join(mapping.select(F.col("old").alias("doc_id"), "new"), "doc_id", "left")
    return moved.groupBy("query_id", F.col("new").alias("doc_id")).agg(F.max("gain").alias("gain"))


def unseal(blind: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(side, n): keys in both, only blind and only among the labels; a run may be judged where the last two are 0."""
    both = blind.select(key).distinct().withColumn("l", F.lit(1)).join(labels.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    side = F.when(F.col("r").isNull(), "blind_only").when(F.col("l").isNull(), "labels_only").otherwise("both")
    return both.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def reuse_by_key(rows: DataFrame, *, key: str, value: str) -> DataFrame:
    """(key, value) where all known values of a key are the same, so that it may stand in for rows without one."""
    known = rows.filter(F.col(key).isNotNull() & (F.col(key) != "") & F.col(value).isNotNull() & (F.trim(value) != ""))
    return known.groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value)).filter("_n = 1").drop("_n")


def remap(rows: DataFrame, *, key: str, ids: str, crosswalk: DataFrame) -> DataFrame:
    """Rows with each element of the list ``ids`` replaced through (old, new); unknown ones stay, order and repeats are kept."""
    placed = rows.select(key, F.posexplode(ids).alias("_at", "old")).join(crosswalk, "old", "left")
    listed = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("new", "old").alias("v")))).alias("_l"))
    return rows.drop(ids).join(listed.select(key, F.transform("_l", lambda x: x["v"]).alias(ids)), key, "left")


def top_units(first_stage: DataFrame, units: DataFrame, *, order: list[Column], n: int) -> DataFrame:
    """Pairs for a reranker: each candidate (query_id, doc_id, rank) with the first ``n`` units of its document."""
    w = Window.partitionBy("doc_id").orderBy(*order)
    few = units.withColumn("unit_rank", F.row_number().over(w)).filter(F.col("unit_rank") <= n)
    return first_stage.join(few, "doc_id")


def exclude_citing(prototypes: DataFrame, excluded: DataFrame, *, key: str, sources: str) -> DataFrame:
    """Prototypes none of whose sources is excluded; one without sources stays."""
    cited = prototypes.select(key, F.explode(sources).alias("source")).join(excluded.select("source").distinct(), "source", "left_semi")
    return prototypes.join(cited.select(key).distinct(), key, "left_anti")


def names_in_text(queries: DataFrame, *, text: str, name: str) -> DataFrame:
    """Queries that name their own venue, by normalised text and name with word boundaries (names from 4 characters on)."""
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return queries.filter((F.length(name) >= 4) & F.contains(pad(text), pad(name)))


def disagreement(ratings: DataFrame, *, item: str, rating: str) -> DataFrame:
    """(item, ratings, kinds, least, most) of items that were not rated alike."""
    g = ratings.groupBy(item).agg(F.count("*").alias("ratings"), F.count_distinct(rating).alias("kinds"), F.min(rating).alias("least"), F.max(rating).alias("most"))
    return g.filter("kinds > 1")


def rank_fingerprint(run: DataFrame, *, by: list[str], item: str = "doc_id", rank: str = "rank") -> DataFrame:
    """(by, fingerprint): SHA-256 of the items in order of rank; scores do not count. Runs are cut to a top k before."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(item).cast("string").alias("d"))))
    return run.groupBy(*by).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["d"]), "\n"), 256).alias("fingerprint"))


def micro_recall(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """One row: relevant documents, those found within ``k``, and their share over all queries together."""
    hits = run.filter(F.col("rank") <= k).select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    return qrels.select("query_id", "doc_id").distinct().join(hits, ["query_id", "doc_id"], "left").agg(F.count("*").alias("relevant"), F.count("hit").alias("found")).withColumn("recall", F.round(F.try_divide("found", "relevant"), 6))


def blinded_pool(runs: DataFrame, *, k: int, seed: str) -> DataFrame:
    """(query_id, doc_id, alias, position): union of the first ``k`` of every method, each document once, in the order of a seeded digest; the alias hides its identity."""
    pool = runs.filter(F.col("rank") <= k).select("query_id", "doc_id").distinct()
    digest = F.sha2(F.concat_ws("\x1f", F.lit(seed), "query_id", "doc_id"), 256)
    w = Window.partitionBy("query_id").orderBy("_d", "doc_id")
    return pool.withColumn("_d", digest).select("query_id", "doc_id", F.concat(F.lit("item-"), F.substring("_d", 1, 12)).alias("alias"), F.row_number().over(w).alias("position"))


def public_columns(df: DataFrame, forbidden: tuple[str, ...] = ("method", "score", "rank", "run_id", "model")) -> list[str]:
    """Columns of a public table, nested ones included, that would break its blinding."""
    found: list[str] = []

    def walk(prefix: str, kind) -> None:  # noqa: ANN001
        for field in getattr(kind, "fields", ()):
            if field.name.lower() in forbidden:
                found.append(prefix + field.name)
            walk(f"{prefix}{field.name}.", getattr(field.dataType, "elementType", field.dataType))

    walk("", df.schema)
    return found


def rank_fusion(local: DataFrame, api: DataFrame, *, weight: float = 1.0, least: float = 60.0) -> DataFrame:
    """Local ranks (query_id, doc_id, rank) fused with judged ones (also relevance 0..100): 1/(60 + local rank) + w rel/100/(60 + judged rank).

    Documents that only the judge has need a relevance of ``least``. Ties go to the higher relevance, then the better local rank.
    """
    l_, a = local.select("query_id", "doc_id", F.col("rank").alias("rl")), api.select("query_id", "doc_id", F.col("rank").alias("ra"), F.col("relevance").alias("rel"))
    both = l_.join(a, ["query_id", "doc_id"], "full").filter(F.col("rl").isNotNull() | (F.col("rel") >= least))
    zero = F.lit(0.0)
    score = F.coalesce(1 / (60 + F.col("rl")), zero) + F.coalesce(weight * (F.col("rel") / 100) / (60 + F.col("ra")), zero)
    scored = both.withColumn("score", F.round(score, 12))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce("rel", zero).desc(), F.col("rl").asc_nulls_last(), "doc_id")
    return scored.select("query_id", "doc_id", "score", F.row_number().over(w).alias("rank"))


def agreement(runs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, agreement): share of the methods whose first ``k`` hold the candidate."""
    top = runs.filter(F.col("rank") <= k)
    methods = top.groupBy("query_id").agg(F.count_distinct("method").alias("m"))
    return top.groupBy("query_id", "doc_id").agg(F.count_distinct("method").alias("n")).join(methods, "query_id").select("query_id", "doc_id", F.round(F.col("n") / F.col("m"), 6).alias("agreement"))


def evidence_coverage(history: Column, prototypes: Column, scope: Column) -> Column:
    """.5 for history, .3 for prototypes, .2 for a scope statement; each within 0..1."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    return 0.5 * clamp(history) + 0.3 * clamp(prototypes) + 0.2 * clamp(scope)


def method_pairs(metrics: DataFrame, *, method: str = "method", query: str = "query_id", value: str = "value") -> DataFrame:
    """(a, b, n, difference, wins, losses) of all unordered pairs of methods over the queries that both have.

    The methods are a handful; pairs are formed per query among them.
    """
    m = metrics.select(F.col(method).alias("m"), F.col(query).alias("q"), F.col(value).alias("v"))
    left, right = m.withColumnsRenamed({"m": "a", "v": "va"}), m.withColumnsRenamed({"m": "b", "v": "vb"})
    both = left.join(right, "q").filter("a < b")
    d = F.col("va") - F.col("vb")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("difference"), F.count(F.when(d > 0, 1)).alias("wins"), F.count(F.when(d < 0, 1)).alias("losses"))


def near_duplicates(texts: DataFrame, *, key: str, split: str, shingles: str, least: float = 0.9, rarest: int = 20, common: int = 100) -> DataFrame:
    """(a, b, similarity) of different texts that stand in different splits and are alike.

    ``shingles`` is an array column. Rows of equal shingles are one text, named by its least key, so copies give no pairs. Candidates share one of
    the ``rarest`` shingles of both that stands in at most ``common`` different texts: the audit's own rule. Similarity is
    the larger of Jaccard and containment. Texts of equal shingles in several splits are exact copies and are reported by the exact audits.
    """
    t = texts.filter(F.size(shingles) > 0).select(F.col(key).cast("string").alias("k"), F.col(split).alias("s"), F.array_sort(shingles).alias("g"))
    unique = t.groupBy("g").agg(F.min("k").alias("k"), F.collect_set("s").alias("s"))
    flat = unique.select("k", F.explode("g").alias("x"))
    df = flat.groupBy("x").agg(F.count("*").alias("n"))
    w = Window.partitionBy("k").orderBy("n", "x")
    kept = flat.join(df, "x").withColumn("r", F.row_number().over(w)).filter((F.col("r") <= rarest) & F.col("n").between(2, common)).select("k", "x")
    pairs = kept.select(F.col("k").alias("a"), "x").join(kept.select(F.col("k").alias("b"), "x"), "x").filter("a < b").select("a", "b").distinct()
    side = lambda n: unique.select(F.col("k").alias(n), F.col("g").alias(f"g{n}"), F.col("s").alias(f"s{n}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = F.size(F.array_union("sa", "sb")) > 1
    return full.filter(apart).withColumn("similarity", F.round(shingle_similarity(F.col("ga"), F.col("gb")), 6)).filter(F.col("similarity") >= least).select("a", "b", "similarity")


def allocate_diagonal(available: dict[tuple[str, str], int], total: int) -> dict[tuple[str, str], int]:
    """Seats for strata (row, column): an equal share each, what is left over along diagonals, none beyond what is available."""
    rows, cols = sorted({r for r, _ in available}), sorted({c for _, c in available})
    seats = dict.fromkeys(available, 0)
    order = sorted(available, key=lambda s: ((cols.index(s[1]) - rows.index(s[0])) % max(1, len(cols)), rows.index(s[0])))
    while sum(seats.values()) < min(total, sum(available.values())):
        for s in order:
            if seats[s] < available[s] and sum(seats.values()) < total:
                seats[s] += 1
    return seats


def pack_prompt(sizes: list[int], limit: int) -> list[int]:
    """Positions of the evidence rows that fit a prompt, in order; one that does not fit is skipped and the next are tried."""
    out, used = [], 0
    for i, n in enumerate(sizes):
        if used + n <= limit:
            out.append(i)
            used += n
    return out


def page(df: DataFrame, order: list[Column], *, offset: int, limit: int) -> DataFrame:
    """One page of a total order."""
    if offset < 0 or limit < 1:
        raise ValueError("offset must not be negative and limit positive")
    return df.orderBy(*order).offset(offset).limit(limit)


def date_window(start: str | None, end: str | None, today: str, days: int = 365) -> tuple[str, str]:
    """A window of ISO dates with defaults: to today, ``days`` back; raises if it is empty or lies in the future."""
    import datetime as dt

    last = dt.date.fromisoformat(end or today)
    first = dt.date.fromisoformat(start) if start else last - dt.timedelta(days=days)
    if first > last or last > dt.date.fromisoformat(today):
        raise ValueError("not a window of past dates")
    return first.isoformat(), last.isoformat()


def call_bound(items: int, batch: int, retries: int, providers: int) -> int:
    """The most external calls that a job may make."""
    return -(-items // batch) * (1 + retries) * providers
