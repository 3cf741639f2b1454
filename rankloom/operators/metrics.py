"""Evaluation of runs: ranking metrics, statistics, calibration, agreement."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Z = 1.959963984540054


def query_metrics(ranked: DataFrame, qrels: DataFrame, queries: DataFrame, ks: list[int]) -> DataFrame:
    """Per query hit@k, recall@k, mrr@k, ndcg@k and ap@k; queries without relevant or retrieved documents score 0.

    ``qrels``: query_id, doc_id, gain > 0. One pass: conditional sums over the join of run and qrels.
    """
    top = max(ks)
    ideal_rank = Window.partitionBy("query_id").orderBy(F.col("gain").desc(), "doc_id")
    ideal = qrels.withColumn("r", F.row_number().over(ideal_rank))
    totals = ideal.groupBy("query_id").agg(F.count("*").alias("relevant"), *[F.sum(F.when(F.col("r") <= k, (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(F.col("r") + 1))).alias(f"idcg{k}") for k in ks])
    hits = ranked.filter(F.col("rank") <= top).join(qrels, ["query_id", "doc_id"])
    seen = Window.partitionBy("query_id").orderBy("rank")
    hits = hits.withColumn("nth", F.row_number().over(seen))
    cols = []
    for k in ks:
        in_k = F.col("rank") <= k
        cols += [
            F.count(F.when(in_k, 1)).alias(f"found{k}"), F.min(F.when(in_k, F.col("rank"))).alias(f"first{k}"),
            F.sum(F.when(in_k, (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(F.col("rank") + 1))).alias(f"dcg{k}"),
            F.sum(F.when(in_k, F.col("nth") / F.col("rank"))).alias(f"prec{k}"),
        ]
    per = queries.select("query_id").distinct().join(totals, "query_id", "left").join(hits.groupBy("query_id").agg(*cols), "query_id", "left")
    out = [F.col("query_id")]
    for k in ks:
        zero = F.lit(0.0)
        out += [
            F.coalesce((F.col(f"found{k}") > 0).cast("double"), zero).alias(f"hit_{k}"),
            F.coalesce(F.col(f"found{k}") / F.col("relevant"), zero).alias(f"recall_{k}"),
            F.coalesce(1.0 / F.col(f"first{k}"), zero).alias(f"mrr_{k}"),
            F.coalesce(F.col(f"dcg{k}") / F.col(f"idcg{k}"), zero).alias(f"ndcg_{k}"),
            F.coalesce(F.col(f"prec{k}") / F.col("relevant"), zero).alias(f"ap_{k}"),
        ]
    return per.select(*out)


def macro(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of every metric over queries, whole or by strata."""
    skip = {"query_id", *(by or [])}
    return metrics.groupBy(*(by or [])).agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in metrics.columns if c not in skip])


def wilson(successes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval."""
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half


def reliability_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) of rows with score in 0..1 and label 0/1."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("score") * bins)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("confidence"), F.round(F.avg("label"), 6).alias("accuracy"))


def safe_threshold(scored: DataFrame, precision: float) -> DataFrame:
    """One row: the lowest score whose prefix, whole tie groups included, keeps the precision; with its coverage."""
    # A RANGE frame takes all rows of equal score; levels are few, so the running sums go over them, not over rows.
    levels = scored.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("hits"))
    w = Window.orderBy(F.col("score").desc())
    run = levels.withColumn("seen", F.sum("n").over(w)).withColumn("right", F.sum("hits").over(w))
    return run.filter(F.col("right") >= precision * F.col("seen")).agg(F.min("score").alias("threshold"), F.max("seen").alias("accepted"))


def step_adjust(p_values: DataFrame) -> DataFrame:
    """Adds Holm and Benjamini-Hochberg adjusted values to (name, p)."""
    order = Window.orderBy("p", "name")
    ranked = p_values.withColumn("r", F.row_number().over(order)).crossJoin(p_values.agg(F.count("*").alias("m")))
    up = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy("r").rowsBetween(0, Window.unboundedFollowing)
    holm = F.least(F.lit(1.0), F.max(F.col("p") * (F.col("m") - F.col("r") + 1)).over(up))
    bh = F.least(F.lit(1.0), F.min(F.col("p") * F.col("m") / F.col("r")).over(down))
    return ranked.select("name", "p", F.round(holm, 9).alias("holm"), F.round(bh, 9).alias("bh"))


def fleiss_kappa(counts: DataFrame, raters: int) -> DataFrame:
    """One row of kappa from (item, category, n), every item rated by ``raters``; null if one category holds all."""
    items = counts.groupBy("item").agg(((F.sum(F.col("n") * F.col("n")) - raters) / (raters * (raters - 1))).alias("agree"))
    observed = items.agg(F.avg("agree").alias("po"), F.count("*").alias("items"))
    share = counts.groupBy("category").agg(F.sum("n").alias("n")).crossJoin(observed.select("items"))
    expected = share.agg(F.sum(F.pow(F.col("n") / (F.col("items") * raters), 2)).alias("pe"))
    return observed.crossJoin(expected).select(F.round(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")), 6).alias("kappa"))


def paired_bootstrap(differences: list[float], *, rounds: int = 2000, seed: int = 7, level: float = 0.95) -> dict[str, float]:
    """Mean, percentile interval and share above zero of resampled means of per-query differences."""
    d = np.asarray(differences, dtype=np.float64)
    if not len(d):
        return {"mean": 0.0, "low": 0.0, "high": 0.0, "above": 0.0}
    rng = np.random.default_rng(seed)
    means = []
    for at in range(0, rounds, 256):
        pick = rng.integers(0, len(d), size=(min(256, rounds - at), len(d)))
        means.append(d[pick].mean(axis=1))
    m = np.concatenate(means)
    low, high = np.quantile(m, [(1 - level) / 2, (1 + level) / 2])
    return {"mean": float(d.mean()), "low": float(low), "high": float(high), "above": float((m > 0).mean())}


def poisson_bootstrap(differences: DataFrame, *, rounds: int = 400, seed: int = 7, level: float = 0.95) -> DataFrame:
    """One row (mean, low, high, above) of resampled means of (query_id, difference), without collecting them.

    Every row draws a Poisson weight for each round from a hash of its query and the round, so rounds are sums over one scan, and the
    result does not depend on how rows are dealt to partitions. Use :func:`paired_bootstrap` for a small sample.
    """
    # Cumulative Poisson(1) probabilities.
    steps = (0.3678794411714423, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
    u = F.pmod(F.xxhash64(F.lit(seed), "query_id", "i"), F.lit(1 << 40)) / float(1 << 40)
    weight = sum(((u > x).cast("int") for x in steps), F.lit(0))
    drawn = differences.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("w", weight)
    means = drawn.groupBy("i").agg((F.sum(F.col("w") * F.col("difference")) / F.greatest(F.sum("w"), F.lit(1))).alias("m"))
    tail = (1 - level) / 2
    spread = means.agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"), F.avg((F.col("m") > 0).cast("double")).alias("above"))
    return differences.agg(F.avg("difference").alias("mean")).crossJoin(spread)  # one row each


def exact_signs(differences: DataFrame, *, key: str, value: str) -> DataFrame:
    """One row (p) of the two-sided sign-flip test over all sign patterns of at most 20 values numbered 0, 1, .. by ``key``."""
    spark = differences.sparkSession
    n = differences.count()
    if n > 20:
        raise ValueError("more than 20 values: use permutation_p")
    patterns = spark.range(1 << n).withColumnRenamed("id", "k")
    rows = F.broadcast(differences.select(F.col(key).cast("int").alias("i"), F.col(value).alias("d")))  # at most 20 rows
    flipped = patterns.crossJoin(rows).groupBy("k").agg(F.avg(F.when(F.expr("(shiftright(k, i) & 1) = 1"), -F.col("d")).otherwise(F.col("d"))).alias("s"))
    observed = differences.agg(F.abs(F.avg(value)).alias("m"))
    return flipped.crossJoin(F.broadcast(observed)).agg(F.round(F.avg((F.abs("s") >= F.col("m") - 1e-15).cast("double")), 6).alias("p"))


def grid_losses(scored: DataFrame) -> DataFrame:
    """(i, nll): mean log loss at each temperature of the grid, from (label, z), in one scan."""
    losses = []
    for t in SelectiveCalibrator.grid().tolist():
        q = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), 1 / (1 + F.exp(-F.col("z") / t))))
        losses.append(F.avg(-(F.col("label") * F.log(q) + (1 - F.col("label")) * F.log(1 - q))))
    return scored.agg(F.array(*losses).alias("l")).select(F.posexplode("l").alias("i", "nll")).select(F.col("i").cast("bigint").alias("i"), F.round("nll", 6).alias("nll"))


def permutation_p(differences: list[float], *, rounds: int = 10_000, seed: int = 7, exact_up_to: int = 16) -> float:
    """Two-sided sign-flip test: all sign patterns up to ``exact_up_to`` values, else random ones with add-one."""
    d = np.asarray(differences, dtype=np.float64)
    n = len(d)
    if not n:
        return 1.0
    observed = abs(d.mean()) - 1e-15
    if n <= exact_up_to:
        signs = 1 - 2 * (np.arange(1 << n)[:, None] >> np.arange(n) & 1)
        return float((np.abs((signs * d).mean(axis=1)) >= observed).mean())
    rng = np.random.default_rng(seed)
    hits = 0
    for at in range(0, rounds, 256):
        signs = rng.integers(0, 2, size=(min(256, rounds - at), n)) * 2 - 1
        hits += int((np.abs((signs * d).mean(axis=1)) >= observed).sum())
    return (hits + 1) / (rounds + 1)


class SelectiveCalibrator:
    """Temperature by log loss over a grid, then the widest threshold of safe precision; abstains with a reason."""

    def __init__(self, precision: float = 0.15, coverage: float = 0.15, agreement: float = 0.1):
        self.precision, self.coverage, self.agreement = precision, coverage, agreement
        self.temperature, self.threshold = 1.0, math.inf

    @staticmethod
    def grid() -> np.ndarray:
        return np.exp(-2 + 4 * np.arange(161) / 160)

    def scaled(self, p: np.ndarray, t: float) -> np.ndarray:
        p = np.clip(p, 1e-9, 1 - 1e-9)
        return 1 / (1 + np.exp(-np.log(p / (1 - p)) / t))

    def fit(self, p: np.ndarray, y: np.ndarray) -> SelectiveCalibrator:
        losses = []
        for t in self.grid():
            q = np.clip(self.scaled(p, t), 1e-12, 1 - 1e-12)
            losses.append(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())
        self.temperature = float(self.grid()[int(np.argmin(losses))])
        q = self.scaled(p, self.temperature)
        for level in np.unique(q):
            taken = q >= level
            if y[taken].mean() >= self.precision:
                self.threshold = float(level)
                break
        return self

    def decide(self, p: float, coverage: float, agreement: float) -> tuple[bool, float, str]:
        """(abstain, confidence, reason)."""
        q = float(self.scaled(np.array([p]), self.temperature)[0])
        confidence = q * (0.5 + 0.5 * math.sqrt(max(0.0, coverage * agreement)))
        if coverage < self.coverage:
            return True, confidence, "low_coverage"
        if agreement < self.agreement:
            return True, confidence, "low_agreement"
        if q < self.threshold:
            return True, confidence, "low_confidence"
        return False, confidence, "accepted"
