"""Queries of audits, reviews, the property graph and text functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.functions import text as tf
from rankloom.operators import audit as au
from rankloom.operators import graph as gr
from rankloom.operators import retrieval as rt
from rankloom.plans.corpus import FOLD, ISSN, NAME
from rankloom.plans.registry import query
from rankloom.plans.retrieval import RUN, _gold, _runs, folded, words

TITLE = NAME.format(c="title")


@query(f"SELECT DISTINCT query_id, trim(regexp_replace({FOLD.format(c='title')}, '[^\\p{{L}}\\p{{N}}_+#.]+', ' ', 'g')) AS search, trim(regexp_replace({FOLD.format(c='title')}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')) AS letters FROM queries")
def normal_forms(t):
    return t("queries").select("query_id", tf.normalize_search(F.col("title")).alias("search"), tf.normalize_letters(F.col("title")).alias("letters")).distinct()


@query(f"WITH {ISSN} SELECT entity_id, 'jcr-' || substr(sha256(string_agg(issn, chr(31) ORDER BY issn)), 1, 16) AS document_id FROM valid GROUP BY entity_id")
def issn_document_ids(t):
    from rankloom.operators.catalog import issn_tokens

    tokens = issn_tokens(t("scope_entities"), key="entity_id", issns="issns")
    return tokens.groupBy("entity_id").agg(F.concat(F.lit("jcr-"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("issn")), "\x1f"), 256), 1, 16)).alias("document_id"))


ONLINE = """f AS (SELECT lower(translate(coalesce(text, ''), '{w}', '{n}')) AS f FROM documents), h AS (SELECT f, regexp_extract_all(f, '[㐀-鿿]+') AS h FROM f)""".format(w=tf.WIDE.replace("'", "''"), n=tf.NARROW.replace("'", "''"))
STOP = ", ".join(f"'{w}'" for w in tf.STOP_WORDS)


@query(f"""WITH {ONLINE}, x AS (SELECT unnest(list_filter(regexp_extract_all(f, '[a-z0-9][a-z0-9+#.]*'), lambda t: length(t) >= 2 AND t NOT IN ({STOP}))) AS term FROM h
UNION ALL SELECT unnest(list_filter(h, lambda t: length(t) BETWEEN 3 AND 10)) FROM h UNION ALL SELECT unnest(flatten(list_transform(h, lambda v: list_transform(range(1, length(v)), lambda i: substr(v, i, 2))))) FROM h)
SELECT term, count(*) AS n FROM x GROUP BY term""")
def online_token_counts(t):
    return t("documents").select(F.explode(tf.counted_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


TERMS = ["federated learning", "wound healing", "考试焦虑", "retinal imaging"]
_COVER = "regexp_replace(lower(coalesce(text, '')), '\\s+', '', 'g')"


@query(f"SELECT doc_id, round(list_sum(list_transform(range(1, length(c) + 1), lambda i: CASE WHEN {' OR '.join(f'substr(c, (i - {k})::INT, {len(x)}) = ' + chr(39) + x + chr(39) + f' AND i > {k}' for x in (s.replace(' ', '') for s in TERMS[2:3]) for k in range(len(x)))} THEN 1 ELSE 0 END)) / length(c), 6) AS share FROM (SELECT doc_id, {_COVER} AS c FROM documents) WHERE length(c) BETWEEN 1 AND 400 AND contains(c, '考试焦虑')")
def covered_shares(t):
    compact = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", "")
    d = t("documents").filter(F.length(compact).between(1, 400) & compact.contains("考试焦虑"))
    return d.select("doc_id", F.round(tf.covered_share(F.col("text"), TERMS[2:3]), 6).alias("share"))


@query("SELECT DISTINCT query_id, o AS original, r AS review FROM (SELECT query_id, regexp_matches(t, '\\b(original research|original article|research article|empirical study)\\b|原创研究|原创论文|研究论文') AS o, regexp_matches(t, '\\b(review article|literature review|systematic review|survey paper|meta-analysis|overview)\\b|综述|元分析') AS r FROM (SELECT query_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '(not|no|without|rather than|instead of)\\s+(a |an |any )?(review|survey|overview|original research)s?', ' ', 'g'), '(不是|并非|非)(综述|原创研究|原创论文)', ' ', 'g') AS t FROM queries))")
def article_intents(t):
    original, review = tf.article_intents(F.col("text"))
    return t("queries").select("query_id", original.alias("original"), review.alias("review")).distinct()


FIELD_RULES = [("medicine", "medic|clinic|health|nurs|surg"), ("law", "law|legal|jurid"), ("computing", "comput|software|machine|informat"), ("economics", "econom|financ|manage|business"), ("education", "educat|teach|learn")]


@query("SELECT DISTINCT entity_id, CASE " + " ".join(f"WHEN regexp_matches(lower(category), '{p}') THEN '{n}'" for n, p in FIELD_RULES) + " ELSE 'other' END AS field FROM scope_entities")
def broad_field_rules(t):
    return t("scope_entities").select("entity_id", tf.first_rule(F.col("category"), FIELD_RULES).alias("field")).distinct()


@query("SELECT tag, count(*) AS documents FROM (SELECT unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in FIELD_RULES) + "], lambda x: x IS NOT NULL)) AS tag FROM documents) GROUP BY tag")
def concept_tags(t):
    return t("documents").select(F.explode(tf.matched_rules(F.col("text"), FIELD_RULES)).alias("tag")).groupBy("tag").agg(F.count("*").alias("documents"))


@query("SELECT doc_id, md5(regexp_replace(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'), ' '), '(?i)^abstract\\s*[:.]?\\s+', '')) AS digest FROM documents")
def markup_digest(t):
    return t("documents").select("doc_id", F.md5(tf.markup_text(F.col("text"))).alias("digest"))


@query("SELECT entity_id, raw, CASE WHEN regexp_matches(b, '^[0-9]{7}[0-9X]$') THEN b ELSE " + NAME.format(c="raw") + " END AS key FROM (SELECT DISTINCT entity_id, raw, regexp_replace(upper(trim(raw)), '[-‐-―\\s]', '', 'g') AS b FROM (SELECT entity_id, unnest(issns) AS raw FROM scope_entities))")
def lookup_keys(t):
    return t("scope_entities").select("entity_id", F.explode("issns").alias("raw")).select("entity_id", "raw", tf.lookup_key(F.col("raw")).alias("key")).distinct()


@query(f"SELECT query_id, array_to_string({words('text')}[1:12], ' ') AS terms FROM probe_queries")
def bounded_terms(t):
    return t("probe_queries").select("query_id", F.array_join(F.slice(tf.tokens(F.col("text")), 1, 12), " ").alias("terms"))


@query("SELECT DISTINCT case_id, h = 'journals.example' OR h LIKE '%.example' AS preferred FROM (SELECT case_id, regexp_extract(lower(source_url), '^https?://([^/@?#:]+)(:[0-9]+)?([/?#]|$)', 1) AS h FROM benchmark_cases WHERE source_url IS NOT NULL)")
def preferred_domains(t):
    return t("benchmark_cases").filter("source_url is not null").select("case_id", tf.host_ends_with(F.col("source_url"), ["journals.example", "example"]).alias("preferred")).distinct()


# --- joins and guards of the catalogue

@query(f"""WITH c AS (SELECT case_id, {NAME.format(c='gold_journal_name')} AS k FROM benchmark_cases), s AS (SELECT k, count(*) AS n, min(quartile) AS quartile FROM (SELECT DISTINCT entity_id, quartile, {NAME.format(c='name')} AS k FROM scope_entities WHERE name IS NOT NULL) GROUP BY k)
SELECT CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status, CASE WHEN n = 1 THEN quartile END AS quartile, count(*) AS n FROM c LEFT JOIN s USING (k) GROUP BY ALL""")
def scope_enrichment(t):
    s = t("scope_entities").filter("name is not null").select("entity_id", "quartile", tf.normalize_name(F.col("name")).alias("k")).distinct()
    c = t("benchmark_cases").select("case_id", tf.normalize_name(F.col("gold_journal_name")).alias("k"))
    return au.enrich(c, s, ["k"], ["quartile"]).groupBy("status", "quartile").agg(F.count("*").alias("n"))


@query(f"WITH {RUN}, m AS (SELECT doc_id AS old, 'e' || entity_id AS new FROM venue_documents WHERE entity_id IS NOT NULL) SELECT query_id, new AS doc_id, max(gain) AS gain FROM gold LEFT JOIN m ON old = doc_id GROUP BY ALL")
def qrel_translation(t):
    m = t("venue_documents").filter("entity_id is not null").select(F.col("doc_id").alias("old"), F.concat(F.lit("e"), "entity_id").alias("new"))
    return au.translate(_gold(t), m)


@query("SELECT side, count(*) AS n FROM (SELECT CASE WHEN p.query_id IS NULL THEN 'blind_only' WHEN q.query_id IS NULL THEN 'labels_only' ELSE 'both' END AS side FROM (SELECT DISTINCT query_id FROM queries) q FULL JOIN (SELECT DISTINCT query_id FROM query_profiles) p ON p.query_id = q.query_id) GROUP BY side")
def label_unseal(t):
    return au.unseal(t("queries"), t("query_profiles"), "query_id")


@query(f"WITH k AS (SELECT {NAME.format(c='name')} AS k, broad_field FROM scope_entities WHERE broad_field IS NOT NULL AND trim(broad_field) <> '') SELECT k, min(broad_field) AS broad_field FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT broad_field) = 1")
def scope_reuse(t):
    return au.reuse_by_key(t("scope_entities").select(tf.normalize_name(F.col("name")).alias("k"), "broad_field"), key="k", value="broad_field")


@query("SELECT entity_id, string_agg(coalesce(n, old)::VARCHAR, ',' ORDER BY pos) AS ids FROM (SELECT entity_id, unnest(row_ids) AS old, generate_subscripts(row_ids, 1) AS pos FROM (SELECT entity_id, min(row_ids) AS row_ids FROM scope_entities GROUP BY entity_id)) LEFT JOIN (SELECT p_partkey AS o, p_partkey + 1000000 AS n FROM part WHERE p_size > 25) ON o = old GROUP BY entity_id")
def evidence_remap(t):
    e = t("scope_entities").groupBy("entity_id").agg(F.min("row_ids").alias("row_ids"))
    walk = t("part").filter("p_size > 25").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 1000000).alias("new"))
    out = au.remap(e.filter("size(row_ids) > 0"), key="entity_id", ids="row_ids", crosswalk=walk)
    return out.select("entity_id", F.array_join(F.col("row_ids").cast("array<string>"), ",").alias("ids"))


@query(f"WITH {RUN}, u AS (SELECT doc_id, unit_no, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, unit_no) AS unit_rank FROM (SELECT trim(doc_id) AS doc_id, unit_no, count(*) AS n FROM scored_documents WHERE unit_no IS NOT NULL AND trim(doc_id) <> '' GROUP BY ALL)) SELECT query_id, doc_id, unit_no, unit_rank FROM run JOIN u USING (doc_id) WHERE method = 'dense' AND rank <= 20 AND unit_rank <= 2")
def rerank_pairs(t):
    u = t("scored_documents").filter("unit_no is not null").withColumn("doc_id", F.trim("doc_id")).filter("doc_id <> ''").groupBy("doc_id", "unit_no").agg(F.count("*").alias("n"))
    first = _runs(t).filter("method = 'dense' and rank <= 20").select("query_id", "doc_id")
    return au.top_units(first, u, order=[F.desc("n"), F.col("unit_no")], n=2).select("query_id", "doc_id", "unit_no", "unit_rank")


# --- audits

@query("SELECT doc_id FROM venue_documents WHERE doc_id NOT IN (SELECT doc_id FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '10\\.[0-9]{4,9}/[a-z0-9._/-]+')) AS d FROM venue_documents) WHERE d IN (SELECT lower(trim(doi)) FROM queries WHERE split <> 'train' AND doi IS NOT NULL))")
def prototype_exclusion(t):
    v = t("venue_documents").select("doc_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"10\.[0-9]{4,9}/[a-z0-9._/-]+"), F.lit(0)).alias("sources"))
    x = t("queries").filter("split <> 'train' and doi is not null").select(F.lower(F.trim("doi")).alias("source"))
    return au.exclude_citing(v, x, key="doc_id", sources="sources").select("doc_id")


@query(f"SELECT DISTINCT query_id FROM (SELECT query_id, {NAME.format(c='text')} AS x, {NAME.format(c='gold_venue_name')} AS v FROM queries) WHERE length(v) >= 4 AND contains(' ' || x || ' ', ' ' || v || ' ')")
def venue_named_in_query(t):
    q = t("queries").select("query_id", tf.normalize_name(F.col("text")).alias("x"), tf.normalize_name(F.col("gold_venue_name")).alias("v"))
    return au.names_in_text(q, text="x", name="v").select("query_id").distinct()


SHINGLES = "(CASE WHEN len(w) >= 12 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) WHEN length(n) >= 18 THEN list_distinct([substr(n, i, 18) FOR i IN range(1, length(n) - 16)]) ELSE [] END)"


@query(f"""WITH a AS (SELECT query_id, split, n, string_split(n, ' ') AS w FROM (SELECT query_id, split, {NAME.format(c='abstract')} AS n FROM queries WHERE abstract IS NOT NULL)), t AS (SELECT query_id AS k, split AS s, list_sort({SHINGLES}) AS g FROM a),
u AS (SELECT g, min(k) AS k, list_distinct(list(s)) AS s FROM t WHERE len(g) > 0 GROUP BY g), f AS (SELECT k, unnest(g) AS x FROM u), d AS (SELECT x, count(*) AS n FROM f GROUP BY x),
kept AS (SELECT k, x FROM (SELECT k, x, n, row_number() OVER (PARTITION BY k ORDER BY n, x) AS r FROM f JOIN d USING (x)) WHERE r <= 20 AND n BETWEEN 2 AND 100), p AS (SELECT DISTINCT a.k AS a, b.k AS b FROM kept a JOIN kept b USING (x) WHERE a.k < b.k),
s AS (SELECT a, b, len(list_intersect(x.g, y.g)) AS c, len(x.g) AS m, len(y.g) AS n FROM p JOIN u x ON x.k = a JOIN u y ON y.k = b WHERE len(list_distinct(list_concat(x.s, y.s))) > 1)
SELECT a, b, round(greatest(c / (m + n - c)::DOUBLE, c / least(m, n)::DOUBLE), 6) AS similarity FROM s WHERE round(greatest(c / (m + n - c)::DOUBLE, c / least(m, n)::DOUBLE), 6) >= 0.9""")
def near_dup_abstracts(t):
    # The generators keep the optimizer from computing the normal form anew for every shingle.
    q = t("queries").filter("abstract is not null").select("query_id", "split", F.explode(F.array(tf.normalize_name(F.col("abstract")))).alias("n"))
    q = q.select("query_id", "split", "n", F.explode(F.array(F.split("n", " "))).alias("w"))
    letters = F.length("n") - 17
    chars = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(letters, F.lit(1))), lambda i: F.substr("n", i, F.lit(18))))
    g = F.when(F.size("w") >= 12, tf.shingles(F.col("w"), 5)).when(letters >= 1, chars).otherwise(F.array().cast("array<string>"))
    return au.near_duplicates(q.withColumn("g", g), key="query_id", split="split", shingles="g")


@query("SELECT l_partkey, ratings, kinds, least, most FROM (SELECT l_partkey, count(*) AS ratings, count(DISTINCT l_returnflag) AS kinds, min(l_returnflag) AS least, max(l_returnflag) AS most FROM lineitem GROUP BY l_partkey) WHERE kinds > 1")
def disagreement_report(t):
    return au.disagreement(t("lineitem"), item="l_partkey", rating="l_returnflag")


@query(f"WITH {RUN} SELECT method, query_id, sha256(string_agg(doc_id, chr(10) ORDER BY rank)) AS fingerprint FROM run WHERE rank <= 20 GROUP BY method, query_id")
def rank_fingerprints(t):
    return au.rank_fingerprint(_runs(t).filter("rank <= 20"), by=["method", "query_id"])


@query(f"WITH {RUN} SELECT count(*) AS relevant, count(h.doc_id) AS found, round(count(h.doc_id) / count(*)::DOUBLE, 6) AS recall FROM gold g LEFT JOIN (SELECT DISTINCT query_id, doc_id FROM run WHERE rank <= 10) h ON h.query_id = g.query_id AND h.doc_id = g.doc_id")
def micro_recall(t):
    return au.micro_recall(_runs(t), _gold(t), 10)


@query(f"WITH {RUN}, p AS (SELECT DISTINCT query_id, doc_id, sha256('s3' || chr(31) || query_id || chr(31) || doc_id) AS d FROM run WHERE rank <= 5) SELECT query_id, doc_id, 'item-' || substr(d, 1, 12) AS alias, row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) AS position FROM p")
def blinded_pool(t):
    return au.blinded_pool(_runs(t), k=5, seed="s3")


@query(f"""WITH {RUN}, l AS (SELECT query_id, doc_id, rank AS rl FROM run WHERE method = 'dense' AND rank <= 20), a AS (SELECT query_id, doc_id, rank AS ra, 100 - 4 * rank AS rel FROM run WHERE method = 'rrf' AND rank <= 20),
f AS (SELECT query_id, doc_id, rl, rel, round(coalesce(1 / (60 + rl)::DOUBLE, 0) + coalesce((rel / 100.0::DOUBLE) / (60 + ra), 0), 12) AS score FROM l FULL JOIN a USING (query_id, doc_id) WHERE rl IS NOT NULL OR rel >= 60)
SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(rel, 0) DESC, rl NULLS LAST, doc_id) AS rank FROM f""")
def judged_rank_fusion(t):
    r = _runs(t).filter("rank <= 20")
    judged = r.filter("method = 'rrf'").withColumn("relevance", (100 - 4 * F.col("rank")).cast("double"))
    return au.rank_fusion(r.filter("method = 'dense'"), judged).withColumn("score", F.round("score", 9))


@query(f"WITH {RUN}, top AS (SELECT * FROM run WHERE rank <= 10), m AS (SELECT query_id, count(DISTINCT method) AS m FROM top GROUP BY query_id) SELECT query_id, doc_id, round(count(DISTINCT method) / max(m)::DOUBLE, 6) AS agreement FROM top JOIN m USING (query_id) GROUP BY query_id, doc_id")
def channel_agreement(t):
    return au.agreement(_runs(t), 10)


@query("SELECT doc_id, round(0.5 * least(1, coalesce(paper_count, 0) / 100.0::DOUBLE) + 0.3 * CASE WHEN profile_tier = 'warm' THEN 1 ELSE 0 END + 0.2 * CASE WHEN text IS NOT NULL THEN 1 ELSE 0 END, 6) AS coverage FROM venue_documents")
def evidence_coverage(t):
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    c = au.evidence_coverage(F.col("paper_count") / 100, flag(F.col("profile_tier") == "warm"), flag(F.col("text").isNotNull()))
    return t("venue_documents").select("doc_id", F.round(c, 6).alias("coverage"))


@query(f"WITH {RUN}, v AS (SELECT method, query_id, score FROM run WHERE rank = 1) SELECT a.method AS a, b.method AS b, count(*) AS n, round(avg(a.score - b.score), 6) AS difference, count(*) FILTER (a.score > b.score) AS wins, count(*) FILTER (a.score < b.score) AS losses FROM v a JOIN v b USING (query_id) WHERE a.method < b.method GROUP BY ALL")
def method_pairs(t):
    return au.method_pairs(_runs(t).filter("rank = 1"), value="score")


@query("SELECT CASE WHEN regexp_matches(lower(props), '\"k\": *[0-2]\\b') THEN 'timeout' WHEN value IS NULL THEN 'empty' WHEN value < 0 THEN 'negative' ELSE 'none' END AS family, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL")
def error_families(t):
    family = F.when(F.lower("props").rlike('"k": *[0-2]\\b'), "timeout").when(F.col("value").isNull(), "empty").when(F.col("value") < 0, "negative").otherwise("none")
    return t("events").filter("event_type = 'error'").groupBy(family.alias("family")).agg(F.count("*").alias("n"))


@query("SELECT profile_tier, count(*) AS n, count(text) AS with_text, round(avg(paper_count), 4) AS papers, count(*) FILTER (snapshot_date IS NULL) AS undated FROM venue_documents GROUP BY profile_tier")
def coverage_counters(t):
    return t("venue_documents").groupBy("profile_tier").agg(F.count("*").alias("n"), F.count("text").alias("with_text"), F.round(F.avg("paper_count"), 4).alias("papers"), F.count(F.when(F.col("snapshot_date").isNull(), 1)).alias("undated"))


@query(f"SELECT k, entity_id FROM (SELECT {NAME.format(c='name')} AS k, entity_id, row_number() OVER (PARTITION BY {NAME.format(c='name')} ORDER BY entity_id) AS rn FROM scope_entities WHERE name IS NOT NULL) WHERE rn = 1 AND k <> ''")
def alias_dedupe(t):
    a = t("scope_entities").filter("name is not null").select(tf.normalize_name(F.col("name")).alias("k"), "entity_id").filter("k <> ''")
    return a.groupBy("k").agg(F.min("entity_id").alias("entity_id"))


@query("SELECT user_id, least(n, 40) AS used, 40 - least(n, 40) AS remaining FROM (SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id)")
def key_pool_usage(t):
    n = F.least(F.count("*"), F.lit(40))
    return t("events").filter("user_id is not null").groupBy("user_id").agg(n.alias("used")).withColumn("remaining", 40 - F.col("used"))


@query("SELECT entity_id, count(DISTINCT quartile) AS kinds FROM scope_entities WHERE quartile IS NOT NULL GROUP BY entity_id HAVING count(DISTINCT quartile) > 1")
def mixed_types_guard(t):
    return t("scope_entities").filter("quartile is not null").groupBy("entity_id").agg(F.count_distinct("quartile").alias("kinds")).filter("kinds > 1")


@query("SELECT CASE WHEN l.doc_id NOT IN (SELECT doc_id FROM documents) THEN 'unknown_document' WHEN lower(trim(subject)) NOT IN (SELECT lower(trim(subject)) FROM subjects) THEN 'unknown_subject' ELSE 'ok' END AS status, count(*) AS n FROM subject_labels l GROUP BY ALL")
def annotation_guard(t):
    docs, subjects = t("documents").select("doc_id").distinct().withColumn("d", F.lit(1)), t("subjects").select(F.lower(F.trim("subject")).alias("s")).distinct().withColumn("k", F.lit(1))
    j = t("subject_labels").withColumn("s", F.lower(F.trim("subject"))).join(docs, "doc_id", "left").join(subjects, "s", "left")
    return j.groupBy(F.when(F.col("d").isNull(), "unknown_document").when(F.col("k").isNull(), "unknown_subject").otherwise("ok").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS texts, count(*) FILTER (h IN (SELECT md5(text) FROM venue_documents WHERE text IS NOT NULL AND doc_id < 'jcr-8')) AS hits FROM (SELECT DISTINCT md5(text) AS h FROM venue_documents WHERE text IS NOT NULL)")
def cache_plan(t):
    v = t("venue_documents").filter("text is not null")
    need = v.select(F.md5("text").alias("h")).distinct()
    held = v.filter("doc_id < 'jcr-8'").select(F.md5("text").alias("h")).distinct().withColumn("held", F.lit(1))
    return need.join(held, "h", "left").agg(F.count("*").alias("texts"), F.count("held").alias("hits"))


@query("SELECT event_id, severity FROM (SELECT event_id, CASE WHEN value > 150 THEN 'critical' WHEN value > 80 THEN 'warning' WHEN value IS NULL THEN 'unknown' ELSE 'clean' END AS severity FROM events) WHERE severity <> 'clean'")
def threshold_conditions(t):
    s = F.when(F.col("value") > 150, "critical").when(F.col("value") > 80, "warning").when(F.col("value").isNull(), "unknown").otherwise("clean")
    return t("events").select("event_id", s.alias("severity")).filter("severity <> 'clean'")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'click' THEN 1 ELSE 0 END DESC, ts, event_id) AS rn FROM events WHERE user_id IS NOT NULL) WHERE rn = 1")
def audit_event_dedupe(t):
    priority = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    w = Window.partitionBy("user_id").orderBy(priority.desc(), "ts", "event_id")
    return t("events").filter("user_id is not null").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("user_id", "event_id")


# --- property graph: venues, their profiles and the papers that they printed

NODES = """n AS (SELECT DISTINCT 'v' || entity_id AS id, 'venue' AS kind FROM scope_entities UNION ALL SELECT 'p' || doc_id, 'profile' FROM venue_documents),
e AS (SELECT 'v' || entity_id AS source, 'p' || doc_id AS target, 'HAS_PROFILE' AS kind FROM venue_documents WHERE entity_id IS NOT NULL)"""


def _graph(t) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    v = t("venue_documents")
    nodes = t("scope_entities").select(F.concat(F.lit("v"), "entity_id").alias("id"), F.lit("venue").alias("kind")).distinct().unionByName(v.select(F.concat(F.lit("p"), "doc_id").alias("id"), F.lit("profile").alias("kind")))
    edges = v.filter("entity_id is not null").select(F.concat(F.lit("v"), "entity_id").alias("source"), F.concat(F.lit("p"), "doc_id").alias("target"), F.lit("HAS_PROFILE").alias("kind"))
    return nodes, edges


@query(f"WITH {NODES} SELECT 'dangling_source' AS rule, count(*) AS n FROM e WHERE source NOT IN (SELECT id FROM n) UNION ALL SELECT 'dangling_target', count(*) FROM e WHERE target NOT IN (SELECT id FROM n) UNION ALL SELECT 'repeated_node', count(*) FROM (SELECT id FROM n GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'repeated_edge', count(*) FROM (SELECT source, target, kind FROM e GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'loop', count(*) FROM e WHERE source = target")
def graph_integrity(t):
    return gr.integrity(*_graph(t))


@query(f"WITH {NODES} SELECT 'node' AS part, kind, count(*) AS n FROM n GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM e GROUP BY kind")
def graph_summary(t):
    return gr.summary(*_graph(t))


@query(f"WITH {NODES}, s AS (SELECT DISTINCT id FROM n WHERE kind = 'venue') SELECT DISTINCT s.id AS seed, target AS neighbour, e.kind, 'out' AS direction FROM e JOIN s ON s.id = source")
def graph_neighbours(t):
    nodes, edges = _graph(t)
    return gr.neighbours(nodes.filter("kind = 'venue'"), edges)


def _bm(units: str, out: str) -> str:
    """SQL of BM25 over units (unit_id, doc_id, w), pooled to the best unit of a document and ranked."""
    return f"""{out}_p AS (SELECT unit_id, any_value(doc_id) AS doc_id, term, count(*) AS tf, max(length) AS length FROM (SELECT unit_id, doc_id, len(w) AS length, unnest(w) AS term FROM {units}) GROUP BY unit_id, term),
{out}_s AS (SELECT count(*) AS n, avg(length) AS avgdl FROM (SELECT unit_id, max(length) AS length FROM {out}_p GROUP BY unit_id)), {out}_d AS (SELECT term, count(*) AS df FROM {out}_p GROUP BY term),
{out}_u AS (SELECT query_id, unit_id, any_value(doc_id) AS doc_id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl))) AS s FROM qt JOIN {out}_p USING (term) JOIN {out}_d USING (term), {out}_s GROUP BY query_id, unit_id),
{out} AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(max(s), 9) AS score FROM {out}_u GROUP BY ALL) QUALIFY rank <= 1000)"""


@query(f"""WITH qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({words('text')}) AS term FROM probe_queries) GROUP BY ALL),
pu AS (SELECT doc_id AS unit_id, 'v' || entity_id AS doc_id, {words('text')} AS w FROM venue_documents WHERE entity_id IS NOT NULL), eu AS (SELECT doc_id AS unit_id, 'v' || entity_id AS doc_id, {words('text')} AS w FROM documents WHERE entity_id IS NOT NULL AND text IS NOT NULL),
{_bm('pu', 'p')}, {_bm('eu', 'e')}, b AS (SELECT doc_id, 1 + 0.15 * ln(1 + count(*)) / ln(1 + max(count(*)) OVER ()) AS boost FROM eu GROUP BY doc_id),
f AS (SELECT query_id, doc_id, round(sum(s), 12) AS s FROM (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS s FROM p UNION ALL SELECT query_id, doc_id, boost / (60 + rank) FROM e JOIN b USING (doc_id)) GROUP BY ALL)
SELECT query_id, doc_id, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""")
def property_graph_t10(t):
    venue = F.concat(F.lit("v"), "entity_id").alias("doc_id")
    p = t("venue_documents").filter("entity_id is not null").select(F.col("doc_id").alias("unit_id"), venue, "text")
    e = t("documents").filter("entity_id is not null and text is not null").select(F.col("doc_id").alias("unit_id"), venue, "text")
    return gr.property_graph_run(t("probe_queries"), p, e, k=10).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query("WITH x AS (SELECT DISTINCT p_brand AS i, p_type AS t FROM part), f AS (SELECT t, count(*) AS f FROM x GROUP BY t), co AS (SELECT a.t AS a, b.t AS b, count(*) AS n FROM x a JOIN x b ON a.i = b.i AND a.t < b.t GROUP BY ALL), s AS (SELECT a, b, round(n / sqrt(fa.f * fb.f), 8) AS s FROM co JOIN f fa ON fa.t = a JOIN f fb ON fb.t = b) SELECT seed, topic, round(s, 6) AS strength FROM (SELECT seed, topic, s, row_number() OVER (PARTITION BY seed ORDER BY s DESC, topic) AS r FROM (SELECT a AS seed, b AS topic, s FROM s UNION ALL SELECT b, a, s FROM s)) WHERE r <= 10")
def keyword_neighbours(t):
    related = rt.cooccurrence(t("part"), item="p_brand", topic="p_type")
    seeds = t("part").select(F.col("p_type").alias("topic")).distinct()
    return rt.expand_topics(seeds, related, neighbours=10, least=0.0).select("seed", "topic", F.round("strength", 6).alias("strength"))
