"""Queries of the catalogue, of corpora, quality and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.functions import text as tf
from rankloom.operators import catalog as cat
from rankloom.operators import corpus as cp
from rankloom.operators import quality as ql
from rankloom.operators import ranking as rk
from rankloom.plans.registry import query
from rankloom.streaming import stateful as st

def _quoted(s: str) -> str:
    return s.replace("'", "''")


FOLD = f"replace(replace(lower(translate({{c}}, '{_quoted(tf.WIDE)}', '{_quoted(tf.NARROW)}')), 'ß', 'ss'), '&', ' and ')".replace("{c}", "@c@").replace("{", "{{").replace("}", "}}").replace("@c@", "{c}")
NAME = "trim(regexp_replace(" + FOLD + r", '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
DOI = r"regexp_replace(regexp_replace(lower(trim(doi)), '^(https?://[^/]+/|doi\s*:?\s*)', ''), '[.,;)\s]+$', '')"
BARE = "upper(regexp_replace(raw, '[^0-9Xx]', '', 'g'))"
CHECK = " + ".join(f"CAST(substr(b, {i}, 1) AS INT) * {9 - i}" for i in range(1, 8))
ISSN = f"""raw AS (SELECT entity_id, unnest(issns) AS raw FROM scope_entities), b AS (SELECT entity_id, raw, {BARE} AS b FROM raw), ok AS (SELECT entity_id, raw, b FROM b WHERE regexp_matches(b, '^[0-9]{{7}}[0-9X]$')),
valid AS (SELECT DISTINCT entity_id, b AS issn FROM ok WHERE substr(b, 8, 1) = CASE (11 - ({CHECK}) % 11) % 11 WHEN 10 THEN 'X' ELSE CAST((11 - ({CHECK}) % 11) % 11 AS VARCHAR) END)"""
CASES = ISSN.replace("raw AS (SELECT entity_id, unnest(issns) AS raw FROM scope_entities)", "raw AS (SELECT case_id AS entity_id, unnest(gold_issns) AS raw FROM benchmark_cases)").replace("raw AS (", "craw AS (", 1).replace("FROM raw)", "FROM craw)").replace("b AS (SELECT entity_id, raw,", "cb AS (SELECT entity_id, raw,").replace("FROM b WHERE", "FROM cb WHERE").replace("ok AS (", "cok AS (", 1).replace("FROM ok WHERE", "FROM cok WHERE").replace("valid AS (SELECT DISTINCT entity_id", "cvalid AS (SELECT DISTINCT entity_id AS case_id")


def _owners(t):  # noqa: ANN001, ANN202
    return cat.issn_tokens(t("scope_entities"), key="entity_id", issns="issns")


@query(f"WITH {ISSN} SELECT entity_id, issn FROM valid")
def issn_checksum(t):
    return _owners(t)


@query(f"WITH {ISSN}, {CASES} SELECT case_id, CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'ambiguous' ELSE 'unmapped' END AS status, CASE WHEN n = 1 THEN e END AS entity_id FROM (SELECT case_id, count(DISTINCT v.entity_id) AS n, min(v.entity_id) AS e FROM cvalid LEFT JOIN valid v USING (issn) GROUP BY case_id)")
def issn_crosswalk(t):
    cases = cat.issn_tokens(t("benchmark_cases"), key="case_id", issns="gold_issns")
    return cat.issn_crosswalk(cases, _owners(t), key="case_id", entity="entity_id")


@query(f"WITH {ISSN} SELECT issn, count(DISTINCT entity_id) AS owners FROM valid GROUP BY issn HAVING count(DISTINCT entity_id) > 1")
def issn_shared_owners(t):
    return _owners(t).groupBy("issn").agg(F.countDistinct("entity_id").alias("owners")).filter("owners > 1")


@query(f"WITH {ISSN} SELECT DISTINCT entity_id FROM valid WHERE entity_id NOT IN (SELECT entity_id FROM valid WHERE issn IN (SELECT issn FROM valid GROUP BY issn HAVING count(DISTINCT entity_id) > 1))")
def strict_journal_universe(t):
    return cat.strict_universe(_owners(t), entity="entity_id")


@query(f"""WITH RECURSIVE {ISSN}, nm AS (SELECT DISTINCT entity_id, 'n' || {NAME.format(c='name')} AS k FROM scope_entities WHERE {NAME.format(c='name')} <> '' UNION SELECT entity_id, 'i' || issn FROM valid),
e AS (SELECT DISTINCT a.entity_id AS a, b.entity_id AS b FROM nm a JOIN nm b USING (k)), cc(a, b) AS (SELECT entity_id, entity_id FROM scope_entities UNION SELECT cc.a, e.b FROM cc JOIN e ON cc.b = e.a)
SELECT a AS record_id, min(b) AS entity_id FROM cc GROUP BY a""")
def entity_resolution_cc(t):
    e = t("scope_entities")
    rows = e.select(F.col("entity_id").alias("record_id"), F.array(tf.normalize_name(F.col("name"))).alias("names")).unionByName(_owners(t).select(F.col("entity_id").alias("record_id"), F.array(F.concat(F.lit("#"), "issn")).alias("names")))
    flat = rows.select("record_id", F.explode("names").alias("v"))
    return cat.resolve_entities(flat, key="record_id", keys={"k": F.col("v")})


@query("SELECT DISTINCT p_partkey, p_brand, p_type, p_size FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING bool_or(p_size <= 10 AND lower(p_type) LIKE '%economy%') AND bool_or(lower(p_name) LIKE '%bolt%') AND bool_or(p_retailprice > 0))")
def target_hard_filter(t):
    p = t("part")
    out = cat.hard_filter(p, entity="p_brand", target=F.col("p_size") <= 10, area=F.lower("p_type").contains("economy"), scope=F.lower("p_name").contains("bolt"), reviewed=F.col("p_retailprice") > 0)
    return out.select("p_partkey", "p_brand", "p_type", "p_size").distinct()


@query("SELECT entity_id, quartile FROM scope_entities WHERE quartile IN ('Q1', 'Q2')")
def at_or_above_targets(t):
    return t("scope_entities").filter(cat.at_or_above(F.col("quartile"), "jcr", "Q2")).select("entity_id", "quartile")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def complete_groups_semi(t):
    urgent = t("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t("lineitem").select("l_orderkey", "l_linenumber").join(urgent, "l_orderkey", "left_semi")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9_+#.])compiler([^a-z0-9_+#.]|$)')")
def boundary_filter(t):
    return t("documents").filter(tf.boundary_match(F.col("text"), "compiler")).select("doc_id")


@query("SELECT c_mktsegment AS segment, n_name AS nation, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def area_summary(t):
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"))
    return cat.area_summary(j, ["segment", "nation"])


@query("SELECT p_type, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 40")
def options_top_areas(t):
    return t("part").groupBy("p_type").agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands")).orderBy(F.desc("n"), "p_type").limit(40)


@query("SELECT source, string_agg(lang, ' | ' ORDER BY o, lang) AS text FROM (SELECT source, lang, min(doc_id) AS o FROM documents WHERE lang IS NOT NULL AND trim(lang) <> '' GROUP BY ALL) WHERE source IS NOT NULL GROUP BY source")
def group_text_assembly(t):
    return cat.group_text(t("documents").filter("source is not null"), by="source", order="doc_id", value="lang")


@query("SELECT p_partkey, exact, matched FROM (SELECT p_partkey, lower(p_name) = 'economy' OR lower(p_type) = 'economy' OR lower(p_brand) = 'economy' AS exact, concat_ws(',', CASE WHEN lower(p_name) LIKE '%economy%' THEN 'p_name' END, CASE WHEN lower(p_type) LIKE '%economy%' THEN 'p_type' END, CASE WHEN lower(p_brand) LIKE '%economy%' THEN 'p_brand' END) AS matched FROM part) WHERE matched <> ''")
def search_lookup_exact_contains(t):
    return cat.lookup(t("part"), "Economy", ["p_name", "p_type", "p_brand"]).select("p_partkey", "exact", "matched")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def latest_n_per_key(t):
    return cat.top_per_stratum(t("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 3).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT query_id, length(abstract) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(length(abstract), -1) DESC, ingested_at) AS rn FROM queries) WHERE rn = 1")
def dedup_keep_longest(t):
    return cp.keep_longest(t("queries"), by="query_id", text="abstract", order="ingested_at").select("query_id", F.length("abstract").cast("bigint").alias("n"))


@query(f"WITH d AS (SELECT regexp_replace({DOI}, '\\.?v[0-9]+$', '') AS doi, source, title FROM queries WHERE regexp_matches({DOI}, '^10[.][0-9]+/.+')) SELECT doi, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n, max(length(title)) AS longest FROM d GROUP BY doi")
def merge_union_lists(t):
    d = t("queries").withColumn("doi", tf.version_token(F.col("doi"))).filter("doi is not null")
    return cp.merge_papers(d, by="doi", title="title", abstract="abstract", source="source").select("doi", "sources", "n", F.length("title").cast("bigint").alias("longest"))


@query("SELECT gold_venue_name AS venue, papers, abstracts, CASE WHEN abstracts >= 10 THEN 'A' WHEN papers >= 10 THEN 'B' WHEN papers >= 1 THEN 'C' ELSE 'D' END AS grade, CASE WHEN papers >= 5 THEN 'warm' WHEN papers >= 1 THEN 'few-shot' ELSE 'cold' END AS tier FROM (SELECT gold_venue_name, count(*) AS papers, count(*) FILTER (length(trim(abstract)) > 0) AS abstracts FROM queries GROUP BY ALL)")
def profile_grade_tier(t):
    return cp.profile_grades(t("queries").withColumnRenamed("gold_venue_name", "venue"), by="venue", abstract="abstract")


@query("SELECT split, bucket, count(*) AS n FROM (SELECT split, (('0x' || substr(sha256(query_id), 1, 8))::BIGINT % 4)::INT AS bucket FROM queries) GROUP BY ALL")
def hash_bucket_prototypes(t):
    return t("queries").select("split", cp.hash_bucket(F.col("query_id"), 4).alias("bucket")).groupBy("split", "bucket").agg(F.count("*").alias("n"))


@query("SELECT query_id, source FROM (SELECT query_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('s7:' || query_id), query_id) AS rn FROM (SELECT DISTINCT query_id, source FROM queries)) WHERE rn <= 25")
def seeded_stratum_sample(t):
    return cp.seeded_sample(t("queries").select("query_id", "source").distinct(), by=["source"], key="query_id", seed="s7", n=25)


@query("SELECT query_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('q' || chr(31) || query_id), query_id) AS turn FROM (SELECT DISTINCT query_id, source FROM queries)")
def round_robin_queue(t):
    return rk.round_robin(t("queries").select("query_id", "source").distinct(), ["source"], "query_id", "q")


@query("SELECT part, count(*) AS n FROM (SELECT CASE WHEN o_orderdate IS NULL THEN 'undated' WHEN strftime(o_orderdate, '%Y-%m-%d') <= '1995-12-31' THEN 'train' WHEN strftime(o_orderdate, '%Y-%m-%d') <= '1996-12-31' THEN 'dev' ELSE 'test' END AS part FROM orders) GROUP BY part")
def temporal_split_counts(t):
    d = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")
    return t("orders").select(cp.temporal_split(d, "1995-12-31", "1996-12-31").alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate")
def asof_guard_violations(t):
    return t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate < o_orderdate").select("l_orderkey", "l_linenumber")


@query(f"WITH d AS (SELECT query_id, split, {NAME.format(c='title')} AS k FROM queries WHERE title IS NOT NULL) SELECT k, count(DISTINCT query_id) AS rows, count(DISTINCT split) AS splits FROM d WHERE k <> '' GROUP BY k HAVING count(DISTINCT split) > 1")
def cross_split_exact_dup(t):
    return ql.cross_split_values(t("queries").withColumn("k", tf.normalize_name(F.col("title"))), "k")


@query(f"WITH d AS (SELECT query_id, split, CASE WHEN regexp_matches(regexp_replace({DOI}, '\\.?v[0-9]+$', ''), '^10[.][0-9]+/.+') THEN regexp_replace({DOI}, '\\.?v[0-9]+$', '') END AS k FROM queries) SELECT k, count(DISTINCT query_id) AS rows, count(DISTINCT split) AS splits FROM d WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT split) > 1")
def version_identity_leak(t):
    return ql.cross_split_values(t("queries").withColumn("k", tf.version_token(F.col("doi"))), "k")


@query(f"""WITH q AS (SELECT DISTINCT query_id, {NAME.format(c='title')} AS title FROM queries WHERE split <> 'train' AND length({NAME.format(c='title')}) >= 24 AND len(string_split({NAME.format(c='title')}, ' ')) >= 4), v AS (SELECT doc_id, {NAME.format(c='text')} AS text FROM venue_documents WHERE text IS NOT NULL)
SELECT DISTINCT query_id, doc_id FROM q JOIN v ON contains(' ' || v.text || ' ', ' ' || q.title || ' ')""")
def benchmark_contamination(t):
    q = t("queries").filter("split <> 'train'").filter(tf.distinctive_title(F.col("title"))).select("query_id", tf.normalize_name(F.col("title")).alias("title")).distinct()
    v = t("venue_documents").filter("text is not null").select("doc_id", tf.normalize_name(F.col("text")).alias("text"))
    return ql.contained_titles(q, v)


@query(f"WITH d AS (SELECT query_id, split, {DOI} AS k FROM queries) SELECT DISTINCT query_id FROM d WHERE split = 'train' AND k IS NOT NULL AND k <> '' AND k NOT IN (SELECT k FROM d WHERE split <> 'train' AND k IS NOT NULL)")
def identity_exclusion_anti(t):
    d = t("queries").select("query_id", "split", tf.normalize_doi(F.col("doi")).alias("k")).filter("k is not null")
    return d.filter("split = 'train' and k <> ''").join(d.filter("split <> 'train'").select("k"), "k", "left_anti").select("query_id").distinct()


@query("WITH p AS (SELECT DISTINCT n_regionkey AS l, CASE WHEN n_regionkey < 3 THEN n_regionkey ELSE 9 END AS r FROM nation) SELECT l, r FROM p WHERE l IN (SELECT l FROM p GROUP BY l HAVING count(*) = 1) AND r IN (SELECT r FROM p GROUP BY r HAVING count(*) = 1)")
def namespace_bijection(t):
    return ql.bijection(t("nation").select(F.col("n_regionkey").alias("l"), F.when(F.col("n_regionkey") < 3, F.col("n_regionkey")).otherwise(9).alias("r")), "l", "r")


@query("SELECT u.user_id, e.event_type, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL) u CROSS JOIN (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL) e LEFT JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) USING (user_id, event_type)")
def densify_grid_missing(t):
    e = t("events")
    facts = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    kinds = e.filter("event_type is not null").select("event_type").distinct()
    return cp.densify(e.filter("user_id is not null").select("user_id").distinct(), kinds, facts, ["user_id", "event_type"], {"n": 0})


@query("SELECT p_partkey, coalesce(u.s, p_size) AS p_size, coalesce(u.b, p_type) AS p_type FROM part LEFT JOIN (SELECT p_brand, max(p_size) AS s, CASE WHEN max(p_size) > 40 THEN NULL ELSE 'merged' END AS b FROM part GROUP BY p_brand) u USING (p_brand)")
def upsert_fanout(t):
    u = t("part").groupBy("p_brand").agg(F.max("p_size").alias("p_size")).withColumn("p_type", F.when(F.col("p_size") <= 40, "merged"))
    return cp.upsert(t("part").select("p_partkey", "p_brand", "p_size", "p_type"), u, key="p_brand", columns=["p_size", "p_type"]).drop("p_brand")


@query(f"SELECT DISTINCT query_id, {DOI} AS doi FROM queries")
def doi_normalize(t):
    return t("queries").select("query_id", tf.normalize_doi(F.col("doi")).alias("doi")).distinct()


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT DISTINCT case_id, CASE WHEN regexp_extract(lower(source_url), '^https?://([^/@?#:]+)(:[0-9]+)?([/?#]|$)', 1) <> '' THEN regexp_extract(lower(source_url), '^https?://([^/@?#:]+)(:[0-9]+)?([/?#]|$)', 1) END AS host FROM benchmark_cases")
def url_host_suffix(t):
    return t("benchmark_cases").select("case_id", tf.url_host(F.col("source_url")).alias("host")).distinct()


@query("SELECT p, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(d, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'day' WHEN regexp_matches(d, '^[0-9]{4}-[0-9]{2}$') THEN 'month' WHEN regexp_matches(d, '^[0-9]{4}$') THEN 'year' END AS p FROM (SELECT replace(trim(publication_date), '/', '-') AS d FROM queries)) GROUP BY p")
def date_precision(t):
    return t("queries").select(tf.date_precision(F.col("publication_date")).alias("p")).groupBy("p").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT query_id, len(regexp_replace(text, '[^一-鿿]', '', 'g')) AS h, len(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a FROM queries WHERE text IS NOT NULL)
SELECT DISTINCT query_id, CASE WHEN h + a = 0 THEN 'other' WHEN h >= 0.08 * (h + a) AND a >= 0.08 * (h + a) THEN 'mixed' WHEN h >= 0.08 * (h + a) THEN 'zh' ELSE 'en' END AS language FROM l""")
def language_signal(t):
    return t("queries").filter("text is not null").select("query_id", tf.language_signal(F.col("text")).alias("language")).distinct()


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN title IS NULL OR trim(title) = '' THEN 'no_title' WHEN regexp_matches(title, '(?i)^\\s*(correction|erratum|corrigendum|retraction|editorial|preface|book review|call for|index of|acknowledg\\w*|勘误|编者按)') THEN 'notice' WHEN abstract IS NULL OR trim(abstract) = '' THEN 'no_abstract' WHEN publication_date IS NULL OR trim(publication_date) = '' THEN 'no_date' ELSE 'ok' END AS reason FROM queries) GROUP BY reason")
def rejection_reasons(t):
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    reason = cp.reject_reason([("no_title", blank("title")), ("notice", cp.is_notice(F.col("title"))), ("no_abstract", blank("abstract")), ("no_date", blank("publication_date"))])
    return t("queries").select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT event_type, bucket, n, sum(n) OVER (PARTITION BY event_type ORDER BY bucket)::BIGINT AS upto FROM (SELECT event_type, CASE WHEN value <= 10 THEN 0 WHEN value <= 50 THEN 1 WHEN value <= 100 THEN 2 ELSE 3 END AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL)")
def latency_histogram_p95(t):
    return st.latency_histogram(t("events"), by=["event_type"], value="value", edges=[10, 50, 100])


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5 AS granted FROM events")
def budget_ledger(t):
    return st.budget_ledger(t("events"), by=["user_id"], order=["ts", "event_id"], budget=5).select("event_id", "ordinal", "granted")


@query("SELECT event_id, CASE WHEN p IS NULL THEN NULL WHEN value < p THEN round(value, 6) ELSE round(value - p, 6) END AS delta FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)")
def counter_delta_reset(t):
    return st.counter_deltas(t("events"), by=["user_id"], order=["ts", "event_id"], value="value").select("event_id", F.round("delta", 6).alias("delta"))


@query("WITH l AS (SELECT event_id, user_id, ts, sha256(event_id::VARCHAR) AS d, CASE WHEN event_id % 97 = 0 THEN 'x' ELSE coalesce(lag(sha256(event_id::VARCHAR)) OVER (PARTITION BY user_id ORDER BY event_id), '') END AS p FROM events) SELECT event_id FROM (SELECT *, coalesce(lag(d) OVER (PARTITION BY user_id ORDER BY event_id), '') AS want FROM l) WHERE p <> want")
def hash_chain_check(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    d = t("events").select("event_id", "user_id", F.sha2(F.col("event_id").cast("string"), 256).alias("d"))
    log = d.withColumn("p", F.when(F.col("event_id") % 97 == 0, "x").otherwise(F.coalesce(F.lag("d").over(w), F.lit(""))))
    return ql.chain_breaks(log, by=["user_id"], seq="event_id", digest="d", previous="p").select("event_id")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_event_per_key(t):
    return cp.latest(t("events"), by=["user_id", "event_type"], order=["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT event_type, sha256(string_agg(event_id::VARCHAR, chr(10) ORDER BY event_id::VARCHAR)) AS digest FROM events GROUP BY event_type")
def ordered_digest(t):
    return ql.ordered_digest(t("events"), ["event_type"], "event_id")


@query("SELECT event_type, sha256(string_agg(d, chr(10) ORDER BY r)) AS digest FROM (SELECT event_type, substr(sha256(event_id::VARCHAR), 1, 2) AS r, sha256(string_agg(event_id::VARCHAR, chr(10) ORDER BY event_id::VARCHAR)) AS d FROM events GROUP BY ALL) GROUP BY event_type")
def ranged_digest(t):
    return ql.ranged_digest(t("events"), ["event_type"], "event_id")


@query("""WITH s AS (SELECT DISTINCT query_id, split, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS g FROM (SELECT DISTINCT query_id, split, regexp_extract_all(lower(title), '[a-z0-9]+') AS w FROM queries WHERE title IS NOT NULL) WHERE len(w) >= 5), f AS (SELECT g FROM s GROUP BY g HAVING count(*) BETWEEN 2 AND 100)
SELECT a.query_id AS a, b.query_id AS b, count(*) AS common FROM s a JOIN f USING (g) JOIN s b USING (g) WHERE a.split = 'train' AND b.split <> 'train' GROUP BY ALL""")
def near_dup_shingles(t):
    w = F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9]+"), F.lit(0))
    s = t("queries").filter("title is not null").select("query_id", "split", F.explode(tf.shingles(w, 5)).alias("g")).distinct()
    # The shared-word limit of this audit is the rule itself: shingles of more than 100 titles are phrases.
    f = s.groupBy("g").agg(F.count("*").alias("n")).filter("n between 2 and 100").select("g")
    kept = s.join(f, "g")
    train = kept.filter("split = 'train'").select(F.col("query_id").alias("a"), "g")
    return train.join(kept.filter("split <> 'train'").select(F.col("query_id").alias("b"), "g"), "g").groupBy("a", "b").agg(F.count("*").alias("common"))


@query()
def rate_limiter(t):
    return st.rate_limit(t("events"), key="user_id", ts="ts", order="event_id", limit=3, window=3600.0)


@query()
def alert_transitions(t):
    sev = F.when(F.col("value") > 150, "critical").when(F.col("value") > 80, "warning").when(F.col("value").isNotNull(), "clean")
    return st.alert_transitions(t("events").withColumn("severity", sev), code="event_type", ts="ts", severity="severity", repeat_after=3600.0, recover_after=2)


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def event_windows(t):
    e = st.event_windows(t("events"), ts="ts", by="event_type", length="1 hour")
    return e.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")
