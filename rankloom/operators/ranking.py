"""Ranking, fusion and routing of runs. A run is a relation (query_id, doc_id, score[, rank])."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["query_id"]

# Shares of the six recall channels, and what each channel is good at
# (precise, ambiguous, long, cross-disciplinary, multilingual).
RECALL_MIX = {"combined": 12, "vector": 8, "lightrag": 6, "graph": 6, "area": 4, "hint": 4}
TRAITS = {
    "combined": (1, 0.35, 0.45, 0.35, 0.45), "vector": (0.55, 1, 0.9, 0.72, 0.88), "lightrag": (0.4, 0.82, 0.82, 1, 0.76),
    "graph": (0.72, 0.52, 0.67, 1, 0.48), "area": (0.3, 1, 0.92, 0.92, 1), "hint": (0.42, 0.78, 0.65, 0.8, 0.82),
}


def finite(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))


def canonical_rank(run: DataFrame, k: int | None = None, *, by: list[str] = KEY, item: str = "doc_id") -> DataFrame:
    """Adds rank: score descending, item ascending, from 1; only the first ``k`` stay.

    Spark limits each group before its shuffle (WindowGroupLimit), so a hot query costs k rows per task.
    """
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col(item))
    ranked = run.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= k) if k else ranked


def max_pool(units: DataFrame, *, by: list[str] = KEY, item: str = "doc_id") -> DataFrame:
    """Units to documents: the best score of each."""
    return units.groupBy(*by, item).agg(F.max("score").alias("score"))


def rrf(runs: dict[str, DataFrame], *, rrf_k: int = 60, weights: dict[str, float] | None = None, k: int | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked runs over the union of their queries."""
    parts = [r.select("query_id", "doc_id", (F.lit((weights or {}).get(m, 1.0)) / (rrf_k + F.col("rank"))).alias("s")) for m, r in runs.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return canonical_rank(union.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 12).alias("score")), k)


def minmax(run: DataFrame, *, by: list[str] = KEY, flat: float = 1.0) -> DataFrame:
    """Adds norm: score between the least (0) and the greatest (1) of its query; ``flat`` where all are equal."""
    w = Window.partitionBy(*by)
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return run.withColumn("norm", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(F.lit(flat)))


def channel_features(ranked: DataFrame) -> DataFrame:
    """Adds feature: .7 of the normalised score and .3 of the rank discount."""
    return minmax(ranked).withColumn("feature", 0.7 * F.col("norm") + 0.3 / F.log2(F.col("rank") + 1))


def pivot_channels(features: DataFrame, channels: list[str]) -> DataFrame:
    """One row per candidate, one column per channel (0 where it is missing) and whether it was there."""
    cols = []
    for c in channels:
        cols.append(F.coalesce(F.max(F.when(F.col("channel") == c, F.col("feature"))), F.lit(0.0)).alias(c))
        cols.append((F.count(F.when(F.col("channel") == c, 1)) == 0).cast("int").alias(f"{c}_missing"))
    return features.groupBy("query_id", "doc_id").agg(*cols)


def linear_fusion(pivoted: DataFrame, weights: dict[str, float], k: int | None = None) -> DataFrame:
    """A fixed linear combination of channel features, ranked."""
    score = sum((F.col(c) * F.lit(w) for c, w in weights.items()), F.lit(0.0))
    return canonical_rank(pivoted.select("query_id", "doc_id", F.round(score, 12).alias("score")), k)


def largest_remainder(weights: dict[str, float], total: int, capacity: dict[str, int] | None = None) -> dict[str, int]:
    """Hamilton apportionment of ``total`` seats, within capacities where given."""
    names = list(weights)
    share = sum(weights.values()) or 1.0
    exact = {n: weights[n] * total / share for n in names}
    cap = {n: (capacity or {}).get(n, total) for n in names}
    seats = {n: min(cap[n], int(exact[n])) for n in names}
    order = sorted(names, key=lambda n: (-(exact[n] - int(exact[n])), names.index(n)))
    while sum(seats.values()) < min(total, sum(cap.values())):
        for n in order:
            if sum(seats.values()) < total and seats[n] < cap[n]:
                seats[n] += 1
    return seats


def adaptive_budget(profile: dict[str, float], observed: dict[str, dict[str, float]], total: int) -> dict[str, int]:
    """Seats per channel from what a query is like and how well each channel did; at least one for each channel with candidates."""
    a, long, cross, lang = (profile.get(x, 0.0) for x in ("ambiguity", "length", "cross_disciplinary", "language"))
    able = {c: o for c, o in observed.items() if o.get("count", 0) > 0}
    utility = {}
    for c, o in able.items():
        t = TRAITS[c]
        quality = (0.46 * o.get("confidence", 0) + 0.34 * o.get("coverage", 0) + 0.2 * o.get("freshness", 0)) ** 1.35
        utility[c] = max(1e-12, quality * (1 + 0.6 * (1 - a) * t[0] + 0.9 * a * t[1] + 0.55 * long * t[2] + 0.9 * cross * t[3] + 0.5 * lang * t[4]))
    base = {c: 1 for c in list(able)[:total]}
    room = {c: int(able[c]["count"]) - 1 for c in base}
    extra = largest_remainder({c: utility[c] for c in base}, min(total - len(base), sum(room.values())), room) if base else {}
    return {c: base[c] + extra.get(c, 0) for c in base}


POOL = "query_id string, doc_id string, channel string, position int, backfilled boolean"


def multichannel_pool(runs: DataFrame, quotas: dict[str, int], limit: int) -> DataFrame:
    """Pool of candidates per query: each channel's quota without repeats, in order of channels, then round-robin backfill.

    ``runs``: query_id, doc_id, channel, rank. Sequential by nature, so one grouped-map call per query; channels
    are cut to ``limit`` candidates first, which bounds a group at ``limit`` times the number of channels.
    """
    cut = runs.filter((F.col("rank") <= limit) & F.col("channel").isin(*quotas))

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = {c: pdf[pdf.channel == c].sort_values(["rank", "doc_id"]).doc_id.tolist() for c in quotas}
        seen, out = set(), []
        for c, n in quotas.items():
            for d in lists[c]:
                if n and len(out) < limit and d not in seen:
                    seen.add(d)
                    out.append((d, c, False))
                    n -= 1
        queues = {c: [d for d in ds if d not in seen] for c, ds in lists.items()}
        while len(out) < limit and any(queues.values()):
            for c in quotas:
                while queues[c] and queues[c][0] in seen:
                    queues[c].pop(0)
                if queues[c] and len(out) < limit:
                    d = queues[c].pop(0)
                    seen.add(d)
                    out.append((d, c, True))
        return pd.DataFrame([(pdf.query_id.iloc[0], d, c, i + 1, b) for i, (d, c, b) in enumerate(out)], columns=["query_id", "doc_id", "channel", "position", "backfilled"])

    return cut.select(F.col("query_id").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), "channel", "rank").groupBy("query_id").applyInPandas(pool, POOL)


def ordered_union(lists: DataFrame) -> DataFrame:
    """Union of ranked lists (query_id, doc_id, source_order, rank): the first occurrence of each document stays, in order."""
    first = lists.groupBy("query_id", "doc_id").agg(F.min(F.struct("source_order", "rank")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at.source_order", "at.rank", "doc_id")
    return first.select("query_id", "doc_id", F.row_number().over(w).alias("position"))


def top_jaccard(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Per query, Jaccard similarity of the first ``k`` of two ranked runs."""
    left = a.filter(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("l"))
    right = b.filter(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("r"))
    both = left.join(right, ["query_id", "doc_id"], "full")
    return both.groupBy("query_id").agg((F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1)) / F.count("*")).alias("jaccard"))


def round_robin(rows: DataFrame, stratum: list[str], key: str, seed: str) -> DataFrame:
    """Interleaves strata: within each the order of a seeded digest, then one of each stratum in turn."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(seed), F.col(key).cast("string")), 256)
    w = Window.partitionBy(*stratum).orderBy(digest, key)
    return rows.withColumn("turn", F.row_number().over(w))


def pairwise_ranker(x: np.ndarray, y: np.ndarray, query: np.ndarray, *, epochs: int = 200, rate: float = 0.08, l2: float = 0.01, negatives: int = 20) -> np.ndarray:
    """Weights of a pairwise logistic ranker, from driver-side arrays; positives against the hardest negatives of their query."""
    pairs = []
    for q in np.unique(query):
        rows = np.flatnonzero(query == q)
        pos, neg = rows[y[rows] > 0], rows[y[rows] <= 0]
        hard = neg[np.argsort(-x[neg].sum(1), kind="stable")[:negatives]]
        pairs += [x[p] - x[n] for p in pos for n in hard]
    w = np.full(x.shape[1], 1.0 / x.shape[1])
    if not pairs:
        return w
    d = np.array(pairs)
    for _ in range(epochs):
        margin = np.clip(d @ w, -60, 60)
        w -= rate * (-(d / (1 + np.exp(margin))[:, None]).mean(0) + l2 * w)
    return w
