"""Queries of retrieval, fusion and evaluation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.functions.text import NARROW, STOP_WORDS, WIDE, tokens
from rankloom.operators import catalog as cat
from rankloom.operators import metrics as mt
from rankloom.operators import quality as ql
from rankloom.operators import ranking as rk
from rankloom.operators import retrieval as rt
from rankloom.plans.registry import query

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def folded(c: str) -> str:
    return f"replace(replace(lower(translate({c}, '{WIDE.replace(chr(39), chr(39) * 2)}', '{NARROW.replace(chr(39), chr(39) * 2)}')), 'ß', 'ss'), '&', ' and ')"


def words(c: str) -> str:
    runs = f"regexp_extract_all({folded(f"coalesce({c}, '')")}, '[a-z0-9][a-z0-9_+#.\\-]*|[㐀-鿿]+')"
    chars = "list_concat(list_transform(range(1, length(v) + 1), lambda i: substr(v, i, 1)), list_transform(range(1, length(v)), lambda i: substr(v, i, 2)))"
    return f"list_filter(flatten(list_transform({runs}, lambda v: CASE WHEN regexp_matches(v, '^[㐀-鿿]') THEN {chars} ELSE [regexp_replace(v, '[.-]+$', '')] END)), lambda t: t <> '' AND t NOT IN ({STOP}))"


UNITS = f"units AS (SELECT doc_id, {words('text')} AS w FROM venue_documents), post AS (SELECT doc_id, term, count(*) AS tf, max(length) AS length FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM units) GROUP BY ALL)"
TERMS = f"qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({words('text')}) AS term FROM probe_queries) GROUP BY ALL)"
BM25 = f"""{UNITS}, stats AS (SELECT count(*) AS n, avg(length) AS avgdl FROM (SELECT doc_id, max(length) AS length FROM post GROUP BY doc_id)),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term), {TERMS},
bm25 AS (SELECT query_id, doc_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl))), 9) AS score FROM qt JOIN post USING (term) JOIN df USING (term), stats GROUP BY query_id, doc_id),
bm25_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25)"""
TFIDF = """idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM df, (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM post)),
dw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM post JOIN idf USING (term)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM dw GROUP BY doc_id),
qw AS (SELECT query_id, term, (1 + ln(qf)) * idf AS qw FROM qt JOIN idf USING (term)), qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qn FROM qw GROUP BY query_id),
tfidf AS (SELECT query_id, doc_id, round(sum(qw * w) / (max(dn) * max(qn)), 9) AS score FROM qw JOIN dw USING (term) JOIN dn USING (doc_id) JOIN qn USING (query_id) GROUP BY query_id, doc_id),
tfidf_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM tfidf)"""
BOTH = f"WITH {BM25}, {TFIDF}"


def _bm25(t, k: int | None = None) -> DataFrame:  # noqa: ANN001
    return rt.bm25(t("probe_queries"), t("venue_documents"), unit="doc_id", text="text", k=k)


def _tfidf(t, k: int | None = None) -> DataFrame:  # noqa: ANN001
    return rt.tfidf(t("probe_queries"), t("venue_documents"), unit="doc_id", text="text", k=k)


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm25_r WHERE rank <= 10")
def bm25_t10(t):
    return _bm25(t, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"{BOTH} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM tfidf_r WHERE rank <= 10")
def tfidf_cosine_t10(t):
    return _tfidf(t, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {UNITS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, round(ln((1 + (SELECT count(DISTINCT doc_id) FROM post)) / (1 + count(*)::DOUBLE)) + 1, 6) AS idf FROM post GROUP BY term")
def term_statistics(t):
    post = rt.postings(t("venue_documents"), key="doc_id", text="text")
    n = post.select("doc_id").distinct().agg(F.count("*").alias("n"))
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).crossJoin(F.broadcast(n)).select("term", "df", "cf", F.round(F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1, 6).alias("idf"))


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({words('text')}) AS term FROM documents) GROUP BY term")
def tokenize_counts(t):
    return t("documents").select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"""WITH {BM25.replace('FROM venue_documents', 'FROM documents')}, pooled AS (SELECT query_id, source, max(score) AS score FROM bm25 JOIN documents USING (doc_id) GROUP BY ALL)
SELECT query_id, source AS doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source) AS rank FROM pooled WHERE source IS NOT NULL""")
def bm25_maxpool_source(t):
    run = rt.bm25(t("probe_queries"), t("documents"), unit="doc_id", text="text", doc="source")
    return rk.canonical_rank(run.drop("rank").filter("doc_id is not null")).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"{BOTH} SELECT query_id, doc_id, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, sum(s) AS s FROM (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS s FROM bm25_r UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) FROM tfidf_r) GROUP BY ALL) QUALIFY rank <= 10")
def rrf_fuse_t10(t):
    return rk.rrf({"bm25": _bm25(t), "tfidf": _tfidf(t)}, k=10).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query(f"{BOTH} SELECT query_id, doc_id, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, sum(s) AS s FROM (SELECT query_id, doc_id, 2.0::DOUBLE / (60 + rank) AS s FROM bm25_r UNION ALL SELECT query_id, doc_id, 0.5::DOUBLE / (60 + rank) FROM tfidf_r) GROUP BY ALL) QUALIFY rank <= 10")
def rrf_weighted(t):
    return rk.rrf({"bm25": _bm25(t), "tfidf": _tfidf(t)}, weights={"bm25": 2.0, "tfidf": 0.5}, k=10).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query(f"""WITH {BM25} SELECT query_id, doc_id, round(0.7 * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END + 0.3 / log2(rank + 1), 6) AS feature
FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM bm25_r)""")
def minmax_rank_features(t):
    return rk.channel_features(_bm25(t)).select("query_id", "doc_id", F.round("feature", 6).alias("feature"))


FEATURES = """, feats AS (SELECT 'bm25' AS channel, * FROM bm25_r UNION ALL SELECT 'tfidf', * FROM tfidf_r),
f AS (SELECT query_id, doc_id, channel, 0.7 * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END + 0.3 / log2(rank + 1) AS feature FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM feats WINDOW w AS (PARTITION BY channel, query_id))),
p AS (SELECT query_id, doc_id, coalesce(max(feature) FILTER (channel = 'bm25'), 0) AS bm25, coalesce(max(feature) FILTER (channel = 'tfidf'), 0) AS tfidf, (count(*) FILTER (channel = 'bm25') = 0)::INT AS bm25_missing, (count(*) FILTER (channel = 'tfidf') = 0)::INT AS tfidf_missing FROM f GROUP BY ALL)"""


def _pivot(t) -> DataFrame:  # noqa: ANN001
    f = rk.channel_features(_bm25(t)).withColumn("channel", F.lit("bm25")).unionByName(rk.channel_features(_tfidf(t)).withColumn("channel", F.lit("tfidf")))
    return rk.pivot_channels(f, ["bm25", "tfidf"])


@query(f"{BOTH}{FEATURES} SELECT query_id, doc_id, round(bm25, 6) AS bm25, round(tfidf, 6) AS tfidf, bm25_missing, tfidf_missing FROM p")
def channel_feature_pivot(t):
    return _pivot(t).select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"), F.round("tfidf", 6).alias("tfidf"), "bm25_missing", "tfidf_missing")


@query(f"{BOTH}{FEATURES} SELECT query_id, doc_id, round(0.6 * bm25 + 0.4 * tfidf, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(0.6 * bm25 + 0.4 * tfidf, 12) DESC, doc_id) AS rank FROM p QUALIFY rank <= 10")
def linear_fusion_fixed_weights(t):
    return rk.linear_fusion(_pivot(t), {"bm25": 0.6, "tfidf": 0.4}, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"{BOTH} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY o, r, doc_id) AS position FROM (SELECT query_id, doc_id, min(struct_pack(o := o, r := rank)).o AS o, min(struct_pack(o := o, r := rank)).r AS r FROM (SELECT 0 AS o, * FROM bm25_r WHERE rank <= 12 UNION ALL SELECT 1, * FROM tfidf_r WHERE rank <= 8) GROUP BY ALL)")
def routed_candidate_pool(t):
    parts = _bm25(t, 12).withColumn("source_order", F.lit(0)).unionByName(_tfidf(t, 8).withColumn("source_order", F.lit(1)))
    return rk.ordered_union(parts)


@query(f"{BOTH} SELECT query_id, round(count(*) FILTER (l AND r) / count(*)::DOUBLE, 6) AS jaccard FROM (SELECT query_id, doc_id, bool_or(m = 1) AS l, bool_or(m = 2) AS r FROM (SELECT query_id, doc_id, 1 AS m FROM bm25_r WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, 2 FROM tfidf_r WHERE rank <= 10) GROUP BY ALL) GROUP BY query_id")
def run_jaccard(t):
    return rk.top_jaccard(_bm25(t), _tfidf(t), 10).select("query_id", F.round("jaccard", 6).alias("jaccard"))


@query()
def multichannel_pool(t):
    runs = _bm25(t, 40).withColumn("channel", F.lit("combined")).unionByName(_tfidf(t, 40).withColumn("channel", F.lit("vector")))
    return rk.multichannel_pool(runs, rk.largest_remainder({c: rk.RECALL_MIX[c] for c in ("combined", "vector")}, 40), 40)


FIELDS = {"p_name": 2.5, "p_brand": 4.0, "p_type": 5.0}
FIELD_SQL = " UNION ALL ".join(f"SELECT p_partkey, unnest({words(c)}) AS term, {w}::DOUBLE AS w FROM part" for c, w in FIELDS.items())


@query(f"""WITH best AS (SELECT p_partkey AS doc_id, term, max(w) AS w FROM ({FIELD_SQL}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM best GROUP BY term),
q AS (SELECT DISTINCT n_name AS query_id, term FROM (SELECT n_name, unnest(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS term FROM nation JOIN part ON p_partkey = n_nationkey + 1))
SELECT query_id, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(w * (ln((n + 1) / (df + 1)) + 1)), 9) AS s FROM q JOIN best USING (term) JOIN df USING (term), (SELECT count(DISTINCT p_partkey)::DOUBLE AS n FROM part) GROUP BY ALL) QUALIFY rank <= 10""")
def field_weighted_recall(t):
    q = t("nation").join(t("part"), F.col("p_partkey") == F.col("n_nationkey") + 1).select(F.col("n_name").alias("query_id"), F.explode(F.regexp_extract_all(F.lower("p_type"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))
    return rt.field_recall(q, t("part"), FIELDS, key="p_partkey", k=10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


CO = """x AS (SELECT DISTINCT user_id AS i, event_type AS t FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL), f AS (SELECT t, count(*) AS f FROM x GROUP BY t),
co AS (SELECT a.t AS a, b.t AS b, count(*) AS n FROM x a JOIN x b ON a.i = b.i AND a.t < b.t GROUP BY ALL), s AS (SELECT a, b, n, round(n / sqrt(fa.f * fb.f), 8) AS strength FROM co JOIN f fa ON fa.t = a JOIN f fb ON fb.t = b)"""


@query(f"WITH {CO} SELECT a, b, n, round(strength, 6) AS strength FROM s")
def cooccurrence_strength(t):
    return rt.cooccurrence(t("events"), item="user_id", topic="event_type").select("a", "b", "n", F.round("strength", 6).alias("strength"))


@query(f"WITH {CO} SELECT seed, topic, round(strength, 6) AS strength FROM (SELECT a AS seed, b AS topic, strength, row_number() OVER (PARTITION BY a ORDER BY strength DESC, b) AS r FROM (SELECT a, b, strength FROM s UNION ALL SELECT b, a, strength FROM s)) WHERE r <= 2 AND strength >= 0.5")
def topic_expansion(t):
    related = rt.cooccurrence(t("events"), item="user_id", topic="event_type")
    seeds = t("events").select(F.col("event_type").alias("topic")).distinct()
    return rt.expand_topics(seeds, related, neighbours=2).select("seed", "topic", F.round("strength", 6).alias("strength"))


VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS nn FROM v)"
COS = f"{VEC}, c AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, d.label, round(greatest(-1, least(1, list_dot_product(q.e, d.e) / (q.nn * d.nn))), 6) AS score FROM n q JOIN n d ON q.vec_id <> d.vec_id AND q.vec_id % 20 = 0 AND q.nn > 0 AND d.nn > 0)"


@query(f"WITH {COS} SELECT query_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c QUALIFY rank <= 10")
def cosine_exact_t10(t):
    v = t("embeddings")
    return rt.cosine(v.filter("vec_id % 20 = 0"), v, key="vec_id", vector="embedding").select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query(f"WITH {COS} SELECT query_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score >= 0.35 QUALIFY rank <= 500")
def cosine_threshold_clamp(t):
    v = t("embeddings")
    return rt.cosine(v.filter("vec_id % 20 = 0"), v, key="vec_id", vector="embedding", least=0.35, k=500).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query(f"WITH {COS}, m AS (SELECT query_id, label AS doc_id, max(score) AS score FROM c GROUP BY ALL) SELECT query_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m")
def vector_label_maxpool(t):
    v = t("embeddings")
    return rt.cosine(v.filter("vec_id % 20 = 0"), v, key="vec_id", vector="embedding", k=None, pool="label").select("query_id", F.col("doc_id").cast("int").alias("doc_id"), F.round("score", 4).alias("score"), "rank")


@query(f"""WITH {VEC}, b AS (SELECT vec_id, e, nn, array_to_string(list_transform(e, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '')::BIT AS s FROM n WHERE nn > 0),
h AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, bit_count(xor(q.s, d.s))::INT AS h, round(greatest(-1, least(1, list_dot_product(q.e, d.e) / (q.nn * d.nn))), 6) AS score FROM b q JOIN b d ON q.vec_id <> d.vec_id AND q.vec_id % 20 = 0),
c AS (SELECT query_id, h, count(*) AS n FROM h GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY h) AS upto, sum(n) OVER (PARTITION BY query_id) AS total FROM c),
r AS (SELECT query_id, min(h) AS radius FROM u WHERE upto >= least(total, greatest(80, ceil(total * 0.5))) GROUP BY query_id)
SELECT query_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h JOIN r USING (query_id) WHERE h <= radius QUALIFY rank <= 10""")
def signbit_hamming_shortlist(t):
    v = t("embeddings")
    return rt.signbit_cosine(v.filter("vec_id % 20 = 0"), v, key="vec_id", vector="embedding", k=10).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query(f"""WITH {VEC}, b AS (SELECT vec_id, array_to_string(list_transform(e, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '')::BIT AS s FROM n) SELECT vec_id, bit_count(s)::INT AS positive FROM b""")
def sign_bit_counts(t):
    return t("embeddings").select("vec_id", rt.hamming(rt.sign_bits(F.col("embedding"), 64), F.array(F.lit(0).cast("bigint"))).cast("int").alias("positive"))


# Runs and judgements: the stored scores of all methods, and the venue that printed each paper.
RUN = """clean AS (SELECT method, query_id, trim(doc_id) AS doc_id, max(score) AS score FROM scored_documents WHERE score IS NOT NULL AND isfinite(score) AND trim(doc_id) <> '' GROUP BY ALL),
run AS (SELECT *, row_number() OVER (PARTITION BY method, query_id ORDER BY score DESC, doc_id) AS rank FROM clean),
gold AS (SELECT DISTINCT q.query_id, d.doc_id, 1 AS gain FROM queries q JOIN venue_documents d ON d.name = q.gold_venue_name), asked AS (SELECT DISTINCT query_id FROM run)"""


def _runs(t) -> DataFrame:  # noqa: ANN001
    s = t("scored_documents").withColumn("doc_id", F.trim("doc_id")).filter(rk.finite(F.col("score"))).filter("doc_id <> ''")
    return rk.canonical_rank(s.groupBy("method", "query_id", "doc_id").agg(F.max("score").alias("score")), by=["method", "query_id"])


def _gold(t) -> DataFrame:  # noqa: ANN001
    return t("queries").select("query_id", "gold_venue_name").join(t("venue_documents").select("doc_id", F.col("name").alias("gold_venue_name")), "gold_venue_name").select("query_id", "doc_id", F.lit(1).alias("gain")).distinct()


PER = f"""{RUN}, pooled AS (SELECT query_id, doc_id, max(10 - rank) AS score FROM run WHERE rank <= 10 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pooled),
tot AS (SELECT query_id, count(*) AS relevant FROM gold GROUP BY query_id),
per AS (SELECT a.query_id, coalesce(max(CASE WHEN g.doc_id IS NOT NULL AND r.rank <= 10 THEN 1.0 END), 0.0) AS hit_10, coalesce(count(g.doc_id) FILTER (r.rank <= 10) / max(relevant)::DOUBLE, 0) AS recall_10,
coalesce(1.0::DOUBLE / min(CASE WHEN g.doc_id IS NOT NULL AND r.rank <= 10 THEN r.rank END), 0) AS mrr_10 FROM asked a LEFT JOIN r USING (query_id) LEFT JOIN gold g ON g.query_id = a.query_id AND g.doc_id = r.doc_id LEFT JOIN tot ON tot.query_id = a.query_id GROUP BY a.query_id)"""


PER_NDCG = f"""WITH {PER}, hit AS (SELECT r.query_id, r.rank, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS nth FROM r JOIN gold g ON g.query_id = r.query_id AND g.doc_id = r.doc_id WHERE r.rank <= 10),
sums AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg, sum(nth / rank::DOUBLE) AS prec FROM hit GROUP BY query_id),
ideal AS (SELECT query_id, sum(1 / log2(n + 1)) AS idcg FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS n FROM gold) WHERE n <= 10 GROUP BY query_id)"""


def _metrics(t, ks: list[int]) -> DataFrame:  # noqa: ANN001
    pooled = _runs(t).filter("rank <= 10").groupBy("query_id", "doc_id").agg(F.max(10 - F.col("rank")).alias("score"))
    return mt.query_metrics(rk.canonical_rank(pooled), _gold(t), t("scored_documents").filter(rk.finite(F.col("score"))).filter("trim(doc_id) <> ''").select("query_id"), ks)


@query(f"WITH {PER} SELECT query_id, hit_10::DOUBLE AS hit_10, round(recall_10, 6) AS recall_10, round(mrr_10, 6) AS mrr_10 FROM per")
def ir_metrics_at_k(t):
    return _metrics(t, [10]).select("query_id", "hit_10", F.round("recall_10", 6).alias("recall_10"), F.round("mrr_10", 6).alias("mrr_10"))


@query(f"WITH {PER} SELECT count(*) AS queries, round(avg(hit_10::DOUBLE), 6) AS hit_10, round(avg(recall_10), 6) AS recall_10, round(avg(mrr_10), 6) AS mrr_10 FROM per")
def ir_metrics_macro(t):
    return mt.macro(_metrics(t, [10]).select("query_id", "hit_10", "recall_10", "mrr_10"))


@query(f"""{PER_NDCG} SELECT query_id, round(coalesce(dcg / idcg, 0), 6) AS ndcg_10, round(coalesce(prec / relevant, 0), 6) AS ap_10 FROM asked LEFT JOIN sums USING (query_id) LEFT JOIN tot USING (query_id) LEFT JOIN ideal USING (query_id)""")
def ir_metrics_ndcg_ap(t):
    return _metrics(t, [10]).select("query_id", F.round("ndcg_10", 6).alias("ndcg_10"), F.round("ap_10", 6).alias("ap_10"))


@query(f"WITH {PER}, src AS (SELECT query_id, min(source) AS source FROM queries GROUP BY query_id) SELECT coalesce(source, 'unknown') AS source, count(*) AS queries, round(avg(hit_10::DOUBLE), 6) AS hit_10, round(avg(mrr_10), 6) AS mrr_10 FROM per LEFT JOIN src USING (query_id) GROUP BY ALL")
def ir_metrics_strata(t):
    src = t("queries").groupBy("query_id").agg(F.min("source").alias("source"))
    m = _metrics(t, [10]).select("query_id", "hit_10", "mrr_10").join(src, "query_id", "left").withColumn("source", F.coalesce("source", F.lit("unknown")))
    return mt.macro(m, ["source"])


@query(f"WITH {RUN} SELECT method, count(*) AS rows, count(DISTINCT query_id) AS queries, count(*) FILTER (rank = 1) AS firsts, round(avg(score), 4) AS mean_score FROM run WHERE rank <= 5 GROUP BY method")
def canonical_run_summary(t):
    r = _runs(t).filter("rank <= 5")
    return r.groupBy("method").agg(F.count("*").alias("rows"), F.countDistinct("query_id").alias("queries"), F.count(F.when(F.col("rank") == 1, 1)).alias("firsts"), F.round(F.avg("score"), 4).alias("mean_score"))


@query(f"""WITH {RUN}, a AS (SELECT query_id, max(CASE WHEN method = 'dense' THEN score END) AS x, max(CASE WHEN method = 'rrf' THEN score END) AS y FROM run WHERE rank = 1 GROUP BY query_id)
SELECT query_id, round(x - y, 6) AS difference FROM a WHERE x IS NOT NULL AND y IS NOT NULL""")
def paired_differences(t):
    first = _runs(t).filter("rank = 1")
    a = first.filter("method = 'dense'").select("query_id", F.col("score").alias("x"))
    b = first.filter("method = 'rrf'").select("query_id", F.col("score").alias("y"))
    return a.join(b, "query_id").select("query_id", F.round(F.col("x") - F.col("y"), 6).alias("difference"))


@query("""WITH s AS (SELECT method, run_id || '/' || query_id AS query_id, doc_id, score, row_number() OVER (PARTITION BY method, run_id, query_id ORDER BY scored_at, doc_id, unit_no, score) AS rank FROM scored_documents), e AS (SELECT DISTINCT run_id || '/' || query_id AS query_id FROM scored_documents WHERE query_id IN (SELECT query_id FROM probe_queries)), per AS (SELECT query_id, count(*) AS n FROM s GROUP BY query_id),
o AS (SELECT *, lag(score) OVER w AS p, lag(doc_id) OVER w AS d FROM s WINDOW w AS (PARTITION BY query_id ORDER BY rank))
SELECT 'missing_query' AS rule, count(*) AS n FROM e WHERE query_id NOT IN (SELECT query_id FROM per)
UNION ALL SELECT 'foreign_query', count(*) FROM per WHERE query_id NOT IN (SELECT query_id FROM e)
UNION ALL SELECT 'foreign_document', count(*) FROM s WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM venue_documents)
UNION ALL SELECT 'duplicate_document', count(*) FROM (SELECT query_id, doc_id FROM s GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'not_finite', count(*) FROM s WHERE score IS NULL OR NOT isfinite(score)
UNION ALL SELECT 'too_long', count(*) FROM per WHERE n > 100
UNION ALL SELECT 'disorder', count(*) FROM o WHERE score > p OR score = p AND doc_id < d""")
def run_contract(t):
    w = Window.partitionBy("method", "run_id", "query_id").orderBy("scored_at", F.col("doc_id").asc_nulls_last(), F.col("unit_no").asc_nulls_last(), F.col("score").asc_nulls_last())
    s = t("scored_documents").withColumn("rank", F.row_number().over(w)).withColumn("query_id", F.concat_ws("/", "run_id", "query_id"))
    asked = t("scored_documents").join(t("probe_queries").select("query_id").distinct(), "query_id", "left_semi").select(F.concat_ws("/", "run_id", "query_id").alias("query_id"))
    return ql.run_violations(s.select("query_id", "doc_id", "score", "rank"), asked, t("venue_documents"), 100)


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def percentile_linear(t):
    return t("events").filter("value is not null").groupBy("event_type").agg(*[F.round(F.percentile("value", p), 6).alias(n) for p, n in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"))])


P = "p AS (SELECT n_name AS name, (n_nationkey + 1) / 500.0::DOUBLE AS p FROM nation)"


@query(f"WITH {P}, r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS r, count(*) OVER () AS m FROM p) SELECT name, p, round(least(1, max(p * (m - r + 1)) OVER (ORDER BY r)), 9) AS holm, round(least(1, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS bh FROM r")
def holm_bh_adjust(t):
    return mt.step_adjust(t("nation").select(F.col("n_name").alias("name"), ((F.col("n_nationkey") + 1) / F.lit(500.0)).alias("p")))


CAL = "s AS (SELECT (ambiguity * 0.9999)::DOUBLE AS score, (cross_disciplinary > 0.25)::INT AS label FROM query_profiles WHERE ambiguity IS NOT NULL AND cross_disciplinary IS NOT NULL AND ambiguity BETWEEN 0 AND 1)"


def _scored(t) -> DataFrame:  # noqa: ANN001
    return t("query_profiles").filter("ambiguity between 0 and 1 and cross_disciplinary is not null").select((F.col("ambiguity") * 0.9999).alias("score"), (F.col("cross_disciplinary") > 0.25).cast("int").alias("label"))


@query(f"WITH {CAL} SELECT least(9, floor(score * 10))::INT AS bin, count(*) AS n, round(avg(score), 6) AS confidence, round(avg(label), 6) AS accuracy FROM s GROUP BY ALL")
def ece_bins(t):
    return mt.reliability_bins(_scored(t))


@query(f"""WITH {CAL}, g AS (SELECT score, count(*) AS n, sum(label) AS h FROM s GROUP BY score), r AS (SELECT score, sum(n) OVER (ORDER BY score DESC) AS seen, sum(h) OVER (ORDER BY score DESC) AS hits FROM g)
SELECT min(score) AS threshold, max(seen)::BIGINT AS accepted FROM r WHERE hits >= 0.3 * seen""")
def precision_safe_threshold(t):
    return mt.safe_threshold(_scored(t), 0.3)


@query(f"WITH {CAL}, a AS (SELECT count(*)::DOUBLE AS n, avg(label) AS p, avg((score - label) * (score - label)) AS brier FROM s) SELECT round(p, 6) AS rate, round((p + {mt.Z * mt.Z} / (2 * n) - {mt.Z} * sqrt(p * (1 - p) / n + {mt.Z * mt.Z} / (4 * n * n))) / (1 + {mt.Z * mt.Z} / n), 6) AS low, round((p + {mt.Z * mt.Z} / (2 * n) + {mt.Z} * sqrt(p * (1 - p) / n + {mt.Z * mt.Z} / (4 * n * n))) / (1 + {mt.Z * mt.Z} / n), 6) AS high, round(brier, 6) AS brier FROM a")
def wilson_ci(t):
    a = _scored(t).agg(F.count("*").cast("double").alias("n"), F.sum("label").alias("h"), F.avg((F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))).alias("brier"))
    low, high = mt.wilson(F.col("h"), F.col("n"))
    return a.select(F.round(F.col("h") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round("brier", 6).alias("brier"))


@query(f"""WITH {CAL}, g AS (SELECT i, exp(-2 + 4 * i / 160.0::DOUBLE) AS t FROM range(161) r(i)), q AS (SELECT i, label, 1 / (1 + exp(-ln(x / (1 - x)) / t)) AS q FROM (SELECT label, least(1 - 1e-9, greatest(1e-9, score)) AS x FROM s), g)
SELECT i, round(avg(-(label * ln(least(1 - 1e-12, greatest(1e-12, q))) + (1 - label) * ln(1 - least(1 - 1e-12, greatest(1e-12, q))))), 6) AS nll FROM q GROUP BY i""")
def temperature_grid_nll(t):
    x = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col("score")))
    s = _scored(t).select("label", F.log(x / (1 - x)).alias("z"))
    return mt.grid_losses(s)


@query("""WITH c AS (SELECT p_brand AS item, p_size % 3 AS category, p_partkey FROM part), n AS (SELECT item, category, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY p_partkey) AS r FROM c) WHERE r <= 5 GROUP BY ALL),
full5 AS (SELECT * FROM n WHERE item IN (SELECT item FROM n GROUP BY item HAVING sum(n) = 5)), i AS (SELECT item, (sum(n * n) - 5) / 20.0::DOUBLE AS agree FROM full5 GROUP BY item), pe AS (SELECT sum(p * p) AS pe FROM (SELECT sum(n) / ((SELECT count(*) FROM i) * 5.0::DOUBLE) AS p FROM full5 GROUP BY category))
SELECT round(((SELECT avg(agree) FROM i) - pe) / (1 - pe), 6) AS kappa FROM pe""")
def fleiss_kappa(t):
    w = Window.partitionBy("item").orderBy("p_partkey")
    c = t("part").select(F.col("p_brand").alias("item"), (F.col("p_size") % 3).alias("category"), "p_partkey").withColumn("r", F.row_number().over(w)).filter("r <= 5")
    n = c.groupBy("item", "category").agg(F.count("*").alias("n"))
    full = n.groupBy("item").agg(F.sum("n").alias("s")).filter("s = 5").select("item")
    return mt.fleiss_kappa(n.join(full, "item", "left_semi"), 5)


@query("""WITH d AS (SELECT r_regionkey AS i, (sum(n_nationkey % 7 - 3))::DOUBLE AS d FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_regionkey), m AS (SELECT avg(d) AS m FROM d),
s AS (SELECT k, avg(CASE WHEN (k >> i) & 1 = 1 THEN -d ELSE d END) AS s FROM range(32) r(k), d GROUP BY k) SELECT round(count(*) FILTER (abs(s) >= abs((SELECT m FROM m)) - 1e-15) / 32.0::DOUBLE, 6) AS p FROM s""")
def exact_permutation(t):
    d = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_regionkey").agg(F.sum((F.col("n_nationkey") % 7) - 3).cast("double").alias("d"))
    return mt.exact_signs(d, key="r_regionkey", value="d")


@query()
def paired_bootstrap(t):
    first = _runs(t).filter("rank = 1")
    a = first.filter("method = 'dense'").select("query_id", F.col("score").alias("x"))
    return mt.poisson_bootstrap(a.join(first.filter("method = 'rrf'").select("query_id", F.col("score").alias("y")), "query_id").select("query_id", (F.col("x") - F.col("y")).alias("difference")))


@query(f"""WITH best AS (SELECT p_partkey AS doc_id, term, max(struct_pack(w := w, field := field)).w AS w FROM ({" UNION ALL ".join(f"SELECT p_partkey, unnest({words(c)}) AS term, {w}::DOUBLE AS w, '{c}' AS field FROM part" for c, w in FIELDS.items())}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM best GROUP BY term),
q AS (SELECT unnest(['brass', 'steel', 'large', 'part']) AS term, unnest([1, 3, 2, 1]) AS count)
SELECT doc_id, round(sum(w * (ln((n + 1) / (df + 1)) + 1) * least(count, 2)) / sqrt(4), 6) AS score FROM best JOIN q USING (term) JOIN df USING (term), (SELECT count(DISTINCT p_partkey)::DOUBLE AS n FROM part) GROUP BY doc_id""")
def explainable_ranker(t):
    q = t("part").sparkSession.createDataFrame([("brass", 1), ("steel", 3), ("large", 2), ("part", 1)], "term string, count int")
    return cat.explainable_scores(q, t("part"), FIELDS, key="p_partkey").select("doc_id", F.round("score", 6).alias("score"))
