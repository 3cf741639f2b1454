"""Retrieval over relations of postings and vectors; every retriever returns a run."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.functions.text import tokens
from rankloom.operators.ranking import canonical_rank

# Weights of catalogue fields.
FIELD_WEIGHTS = {"name": 2.5, "abbreviation": 4.0, "area": 3.5, "taxonomy": 2.5, "scope": 5.0, "topics": 5.5, "official": 1.0}


def postings(units: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): one row per unit and term."""
    words = units.select(F.col(key).alias(key), tokens(F.col(text)).alias("w"))
    terms = words.select(key, F.size("w").alias("length"), F.explode("w").alias("term"))
    return terms.groupBy(key, "term").agg(F.count("*").alias("tf"), F.max("length").alias("length"))


def statistics(post: DataFrame, *, key: str) -> DataFrame:
    """One row: number of units with a term, and their mean length."""
    per = post.groupBy(key).agg(F.max("length").alias("length"))
    return per.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))


def query_terms(queries: DataFrame, *, key: str = "query_id", text: str = "text") -> DataFrame:
    return queries.select(F.col(key).alias("query_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def bm25(queries: DataFrame, units: DataFrame, *, unit: str, text: str, doc: str | None = None, k1: float = 1.2, b: float = 0.75, k: int | None = None) -> DataFrame:
    """BM25 over units, pooled to documents by their best unit.

    Scores are rounded to 9 places before ranking, so that ties do not depend on the order of summation.
    """
    if not (k1 > 0 and 0 <= b <= 1):
        raise ValueError("k1 must be positive and b within 0..1")
    post = postings(units, key=unit, text=text)
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    weighted = post.join(df, "term").crossJoin(F.broadcast(statistics(post, key=unit)))  # one row of statistics
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avgdl")))
    scored = query_terms(queries).join(weighted, "term").groupBy("query_id", unit).agg(F.sum(part).alias("score"))
    if doc and doc != unit:
        scored = scored.join(units.select(unit, doc), unit)
    pooled = scored.groupBy("query_id", F.col(doc or unit).alias("doc_id")).agg(F.round(F.max("score"), 9).alias("score"))
    return canonical_rank(pooled, k)


def tfidf(queries: DataFrame, units: DataFrame, *, unit: str, text: str, k: int | None = None) -> DataFrame:
    """Cosine of sublinear tf-idf vectors; queries are normalised over words that the index knows."""
    post = postings(units, key=unit, text=text)
    stats = post.select(unit).distinct().agg(F.count("*").alias("n"))
    df = post.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))
    idf = df.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    d = post.join(idf, "term").select(unit, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    dn = d.groupBy(unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    q = query_terms(queries).join(idf, "term").select("query_id", "term", ((1 + F.log("qf")) * F.col("idf")).alias("qw"))
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    dot = q.join(d, "term").groupBy("query_id", unit).agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    scored = dot.join(dn, unit).join(qn, "query_id").select("query_id", F.col(unit).alias("doc_id"), F.round(F.col("dot") / (F.col("dn") * F.col("qn")), 9).alias("score"))
    return canonical_rank(scored, k)


def field_recall(query_words: DataFrame, entities: DataFrame, fields: dict[str, float], *, key: str, k: int | None = None) -> DataFrame:
    """Field-weighted lexical recall: the best field of each word times its idf over the entities given.

    Filters come before this call: document frequencies are those of the allowed set.
    """
    parts = None
    for name, w in fields.items():
        p = entities.select(F.col(key).alias("doc_id"), F.explode(F.array_distinct(tokens(F.col(name)))).alias("term")).withColumn("w", F.lit(float(w)))
        parts = p if parts is None else parts.unionByName(p)
    best = parts.groupBy("doc_id", "term").agg(F.max("w").alias("w"))
    n = entities.select(key).distinct().agg(F.count("*").alias("n"))
    df = best.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    words = query_words.select("query_id", "term").distinct()
    hits = words.join(best, "term").join(df, "term")
    scored = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)), 9).alias("score"))
    return canonical_rank(scored, k)


def cooccurrence(pairs: DataFrame, *, item: str, topic: str) -> DataFrame:
    """Topic pairs with their number of common items and strength n / sqrt(fa fb)."""
    t = pairs.select(F.col(item).alias("i"), F.col(topic).alias("t")).filter("i is not null and t is not null").distinct()
    f = t.groupBy("t").agg(F.count("*").alias("f"))
    both = t.select("i", F.col("t").alias("a")).join(t.select("i", F.col("t").alias("b")), "i").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return both.join(f.withColumnsRenamed({"t": "a", "f": "fa"}), "a").join(f.withColumnsRenamed({"t": "b", "f": "fb"}), "b").select("a", "b", "n", F.round(F.col("n") / F.sqrt(F.col("fa") * F.col("fb")), 8).alias("strength"))


def expand_topics(seeds: DataFrame, related: DataFrame, *, neighbours: int = 5, least: float = 0.5) -> DataFrame:
    """(seed, topic, strength): the nearest topics of each seed; the limit comes before the threshold."""
    edges = related.select("a", "b", "strength").unionByName(related.select(F.col("b").alias("a"), F.col("a").alias("b"), "strength"))
    w = Window.partitionBy("a").orderBy(F.col("strength").desc(), F.col("b"))
    near = edges.join(seeds.select(F.col("topic").alias("a")), "a").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= neighbours)
    return near.filter(F.col("strength") >= least).select(F.col("a").alias("seed"), F.col("b").alias("topic"), "strength")


BLOCK_ROWS = 2048


def packed_blocks(vectors: DataFrame, *, key: str, vector: str, extra: str | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """(ids, extra, matrix): vectors at most ``rows`` at a time, as bytes of 64-bit integers and of unit vectors in doubles. Null and zero vectors are left out.

    Keys and ``extra`` are integers, and all vectors of one call have the same length.
    """
    import pyarrow as pa

    other = F.col(extra).cast("bigint") if extra else F.lit(0).cast("bigint")
    src = vectors.select(F.col(key).cast("bigint").alias("k"), other.alias("x"), F.col(vector).cast("array<double>").alias("v")).filter("k is not null and size(v) > 0 and not exists(v, y -> y is null)")

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                m = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                norms = np.sqrt((m * m).sum(1))
                keep = norms > 0
                ids, other = (part.column(c).to_numpy(zero_copy_only=False)[keep].astype(np.int64) for c in (0, 1))
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([other.tobytes()]), pa.array([(m[keep] / norms[keep, None]).tobytes()])], names=["ids", "extra", "matrix"])

    return src.mapInArrow(run, "ids binary, extra binary, matrix binary")


def _cells(queries: DataFrame, vectors: DataFrame, cell, schema: str) -> DataFrame:  # noqa: ANN001
    """``cell`` applied to every pair of a block of queries and a block of vectors; blocks are packed rows, so cells are few and spread over all tasks."""
    import pyarrow as pa

    pairs = vectors.crossJoin(queries.select(F.col("ids").alias("q_ids"), F.col("extra").alias("q_extra"), F.col("matrix").alias("q_matrix")))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for ids, extra, matrix, q_ids, q_extra, q_matrix in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                d, q = np.frombuffer(ids, dtype=np.int64), np.frombuffer(q_ids, dtype=np.int64)
                out = cell(d, np.frombuffer(extra, dtype=np.int64), np.frombuffer(matrix).reshape(len(d), -1), q, np.frombuffer(q_extra, dtype=np.int64), np.frombuffer(q_matrix).reshape(len(q), -1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    return pairs.mapInArrow(run, schema)


def _best(scores: np.ndarray, d: np.ndarray, q: np.ndarray, k: int | None, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, doc, score) of held cells, only the first ``k`` of each query by score, then id."""
    rows = []
    for i in range(len(q)):
        own = np.flatnonzero(held[i])
        if k is not None and len(own) > k:
            own = own[np.lexsort((d[own], -scores[i, own]))[:k]]
        rows.append(own)
    row = np.repeat(np.arange(len(q)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    return q[row], d[col], scores[row, col]


def cosine(queries: DataFrame, vectors: DataFrame, *, key: str, vector: str, least: float | None = None, k: int | None = 10, pool: str | None = None) -> DataFrame:
    """Exact cosine scan of a stated set of queries over all vectors, clamped to -1..1 and rounded to 6 places.

    Blocks of queries meet blocks of vectors in one matrix product each, and each cell gives its ``k`` best only: nothing is broadcast beyond what the
    optimizer finds small, and no number of queries is too many. With ``pool``, an integer column, documents are its values and score by their best vector.
    A query does not find itself; null and zero vectors neither ask nor answer.
    """

    def cell(d, extra, m, q, _, qm):  # noqa: ANN001, ANN202
        scores = np.round(np.clip(qm @ m.T, -1.0, 1.0), 6) + 0.0
        held = q[:, None] != d[None, :]
        if least is not None:
            held &= scores >= least
        if pool:
            names, where = np.unique(extra, return_inverse=True)
            best = np.full((len(names), len(q)), -2.0)
            np.maximum.at(best, where, np.where(held, scores, -2.0).T)
            return _best(best.T, names, q, k, best.T > -2.0)
        return _best(scores, d, q, k, held)

    q, v = packed_blocks(queries, key=key, vector=vector), packed_blocks(vectors, key=key, vector=vector, extra=pool)
    scored = _cells(q, v, cell, "query_id bigint, doc_id bigint, score double")
    if pool:
        scored = scored.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return canonical_rank(scored, k)


def signbit_cosine(queries: DataFrame, vectors: DataFrame, *, key: str, vector: str, k: int = 10, shortlist: float = 0.5, floor: int = 80) -> DataFrame:
    """Cosine rescoring of a shortlist by Hamming distance of sign bits.

    The shortlist of a query are all vectors within the least distance that holds ``shortlist`` of all vectors (and ``floor`` of them), so it grows with the
    table and recall does not fall: the distances are counted first, then the vectors within are rescored exactly.
    """
    signs = lambda m: np.where(m >= 0, 1.0, -1.0)
    distances = lambda qm, m: np.rint((m.shape[1] - signs(qm) @ signs(m).T) / 2).astype(np.int64)

    def count(d, _, m, q, __, qm):  # noqa: ANN001, ANN202
        h = np.where(q[:, None] != d[None, :], distances(qm, m), m.shape[1] + 1)
        n = np.apply_along_axis(np.bincount, 1, h, minlength=m.shape[1] + 2)[:, :-1]
        row, at = np.nonzero(n)
        return q[row], at, n[row, at]

    v = packed_blocks(vectors, key=key, vector=vector)
    counts = _cells(packed_blocks(queries, key=key, vector=vector), v, count, "query_id bigint, h bigint, n bigint").groupBy("query_id", "h").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("query_id").orderBy("h")
    run = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("query_id")))
    radius = run.filter(F.col("upto") >= F.least("total", F.greatest(F.lit(floor), F.ceil(F.col("total") * shortlist)))).groupBy("query_id").agg(F.min("h").alias("radius"))
    asked = queries.select(F.col(key).cast("bigint").alias("query_id"), F.col(vector).alias("_v")).join(radius, "query_id")

    def rescore(d, _, m, q, reach, qm):  # noqa: ANN001, ANN202
        held = (q[:, None] != d[None, :]) & (distances(qm, m) <= reach[:, None])
        return _best(np.round(np.clip(qm @ m.T, -1.0, 1.0), 6) + 0.0, d, q, k, held)

    scored = _cells(packed_blocks(asked, key="query_id", vector="_v", extra="radius"), v, rescore, "query_id bigint, doc_id bigint, score double")
    return canonical_rank(scored, k)


def sign_bits(vector: Column, dims: int) -> Column:
    """Signs of a vector as 64-bit words: bit i of word i // 64 is set where component i is not negative."""
    words = []
    for w in range(0, dims, 64):
        bits = F.lit(0).cast("bigint")
        for i in range(w, min(dims, w + 64)):
            bits = bits.bitwiseOR(F.when(F.element_at(vector, i + 1) >= 0, F.shiftleft(F.lit(1).cast("bigint"), i - w)).otherwise(F.lit(0).cast("bigint")))
        words.append(bits)
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
