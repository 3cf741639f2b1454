import time

import numpy as np
import pytest

from rankloom.functions import text as tf
from rankloom.operators import catalog as cat
from rankloom.operators import corpus as cp
from rankloom.operators import metrics as mt
from rankloom.operators import quality as ql
from rankloom.operators import ranking as rk
from rankloom.operators import retrieval as rt
from rankloom.operators.components import connected_components
from rankloom.sources import readers, writers
from rankloom.streaming import stateful as st


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*(by or df.columns)).collect()]


def test_canonical_rank_breaks_ties_by_id(spark):
    run = spark.createDataFrame([("q", "b", 1.0), ("q", "a", 1.0), ("q", "c", 2.0)], "query_id string, doc_id string, score double")
    assert [r[1] for r in rows(rk.canonical_rank(run, 2), "rank")] == ["c", "a"]


def test_idf_counts_units(spark):
    docs = spark.createDataFrame([("1", "common alpha"), ("2", "common beta"), ("3", "gamma")], "doc_id string, text string")
    q = spark.createDataFrame([("q1", "alpha"), ("q2", "none here")], "query_id string, text string")
    assert [(r.query_id, r.doc_id) for r in rt.bm25(q, docs, unit="doc_id", text="text").collect()] == [("q1", "1")]
    run = rt.tfidf(q, docs, unit="doc_id", text="text").first()
    idf_c, idf_a = np.log(4 / 3) + 1, np.log(4 / 2) + 1
    assert abs(run.score - idf_a / np.hypot(idf_c, idf_a)) < 1e-6


def test_bm25_rejects_bad_parameters(spark):
    with pytest.raises(ValueError):
        rt.bm25(None, None, unit="u", text="t", k1=0)


def test_rrf_and_minmax(spark):
    run = spark.createDataFrame([("q", "a", 3.0, 1), ("q", "b", 3.0, 2)], "query_id string, doc_id string, score double, rank int")
    assert [r.norm for r in rk.minmax(run).collect()] == [1.0, 1.0]
    fused = rows(rk.rrf({"x": run, "y": run}), "rank")
    assert fused[0][1] == "a" and abs(fused[0][2] - 2 / 61) < 1e-9


def test_quotas_fill_the_limit():
    assert list(rk.largest_remainder(rk.RECALL_MIX, 40).values()) == [12, 8, 6, 6, 4, 4]
    for total in (1, 7, 39):
        assert sum(rk.largest_remainder(rk.RECALL_MIX, total).values()) == total
    assert rk.largest_remainder({"a": 1, "b": 9}, 10, {"a": 10, "b": 3}) == {"a": 7, "b": 3}


def test_adaptive_budget_shifts_with_ambiguity():
    seen = {c: {"confidence": 0.5, "coverage": 0.5, "freshness": 0.5, "count": 40} for c in rk.TRAITS}
    precise = rk.adaptive_budget({"ambiguity": 0.05}, seen, 40)
    fuzzy = rk.adaptive_budget({"ambiguity": 0.95, "cross_disciplinary": 0.8}, seen, 40)
    assert sum(precise.values()) == sum(fuzzy.values()) == 40
    assert fuzzy["combined"] < precise["combined"] and fuzzy["lightrag"] > precise["lightrag"]
    assert rk.adaptive_budget({}, {}, 40) == {}


def test_multichannel_pool_has_no_repeats(spark):
    runs = spark.createDataFrame([("q", d, c, i + 1) for c, ds in (("x", "abcd"), ("y", "abef")) for i, d in enumerate(ds)], "query_id string, doc_id string, channel string, rank int")
    got = rows(rk.multichannel_pool(runs, {"x": 2, "y": 1}, 5), "position")
    assert [r[1] for r in got] == ["a", "b", "e", "c", "f"]


def test_metrics_keep_misses(spark):
    run = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2)], "query_id string, doc_id string, rank int")
    gold = spark.createDataFrame([("q1", "b", 1), ("q2", "z", 1)], "query_id string, doc_id string, gain int")
    q = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    m = {r.query_id: r for r in mt.query_metrics(run, gold, q, [1, 2]).collect()}
    assert m["q1"].hit_1 == 0 and m["q1"].mrr_2 == 0.5 and m["q1"].ap_2 == 0.5 and m["q2"].ndcg_2 == 0
    assert abs(m["q1"].ndcg_2 - 1 / np.log2(3)) < 1e-9
    assert mt.macro(mt.query_metrics(run, gold, q, [2])).first().hit_2 == 0.5


def test_permutation_and_bootstrap_are_deterministic():
    assert mt.permutation_p([1.0, 1.0, 1.0]) == 0.25
    assert mt.permutation_p([]) == 1.0
    assert mt.permutation_p([0.1] * 20) == mt.permutation_p([0.1] * 20) < 0.01
    assert mt.paired_bootstrap([1.0, 2.0]) == mt.paired_bootstrap([1.0, 2.0])


def test_step_adjust_is_monotone(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    got = {r.name: r for r in mt.step_adjust(p).collect()}
    assert abs(got["a"].holm - 0.03) < 1e-9 and abs(got["c"].holm - 0.06) < 1e-9 and abs(got["b"].bh - 0.04) < 1e-9
    assert all(r.bh <= r.holm and r.holm >= r.p for r in got.values())


def test_safe_threshold_takes_whole_tie_groups(spark):
    s = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "score double, label int")
    r = mt.safe_threshold(s, 0.66).first()
    assert (r.threshold, r.accepted) == (0.5, 3)


def test_calibrator_abstains_in_order():
    c = mt.SelectiveCalibrator(precision=0.5).fit(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0]))
    assert c.decide(0.9, 0.0, 1.0)[2] == "low_coverage" and c.decide(0.9, 1.0, 0.0)[2] == "low_agreement"
    assert c.decide(0.95, 1.0, 1.0)[0] is False and c.decide(0.01, 1.0, 1.0)[2] == "low_confidence"


def test_pairwise_ranker_learns_the_sign():
    x = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.2], [0.1, 1.0]])
    w = rk.pairwise_ranker(x, np.array([1, 0, 1, 0]), np.array([0, 0, 1, 1]))
    assert w[0] > w[1]


def test_components_join_chains_and_hubs(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    edges = spark.createDataFrame([*chain, ("x", "y"), ("y", "x"), ("z", "z"), (None, "q")], "a string, b string")
    got = dict(rows(connected_components(edges)))
    assert {got[f"n{i:03}"] for i in range(61)} == {"n000"} and got["y"] == "x" and got["z"] == "z" and "q" not in got
    assert connected_components(edges.limit(0)).count() == 0


def test_entity_resolution_is_transitive(spark):
    r = spark.createDataFrame([(5, "a", "1"), (7, "b", "1"), (9, "b", "2"), (11, "", None)], "id bigint, name string, issn string")
    got = dict(rows(cat.resolve_entities(r, key="id", keys={"n": r["name"], "i": r["issn"]})))
    assert got == {5: 5, 7: 5, 9: 5, 11: 11}


def test_targets():
    assert cat.parse_targets(["CCF-B及以上", "JCR Q1"]) == [("ccf", "A"), ("ccf", "B"), ("jcr", "Q1")]
    assert cat.parse_targets(["中科院2区"]) == [("cas", "2")]
    with pytest.raises(ValueError):
        cat.parse_targets(["Q9"])


def test_issn_checksum(spark):
    df = spark.createDataFrame([("0378-5955",), ("2434-561X",), ("0378-5954",), ("ISSN 03785955",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(tf.valid_issn(df.s)).collect()] == [True, True, False, True, False, False]


def test_text_functions(spark):
    df = spark.createDataFrame([("https://doi.org/10.1/AB.v2.",)], "s string")
    r = df.select(tf.normalize_doi(df.s).alias("d"), tf.version_token(df.s).alias("v"), tf.redact(df.s).alias("x")).first()
    assert r.d == "10.1/ab.v2" and r.v == "10.1/ab"
    a, b = (spark.createDataFrame([(x,)], "w array<string>").w for x in (["a"], ["b"]))
    one = spark.createDataFrame([(["a", "b", "c"], ["a", "b"])], "x array<string>, y array<string>")
    assert one.select(tf.shingle_similarity(tf.shingles(one.x, 2), tf.shingles(one.y, 2))).first()[0] == 1.0


def test_run_contract_lists_breaches(spark):
    run = spark.createDataFrame([("q", "a", 1.0, 1), ("q", "b", 2.0, 2), ("x", "a", 1.0, 1)], "query_id string, doc_id string, score double, rank int")
    q = spark.createDataFrame([("q",), ("r",)], "query_id string")
    d = spark.createDataFrame([("a",)], "doc_id string")
    got = dict(rows(ql.run_violations(run, q, d, 1)))
    assert got == {"missing_query": 1, "foreign_query": 1, "foreign_document": 1, "duplicate_document": 0, "not_finite": 0, "too_long": 1, "disorder": 1}


def test_digests():
    assert ql.merkle_root(["aa" * 32]) == "aa" * 32
    assert ql.canonical_json_digest({"b": 1, "a": 2}) == ql.canonical_json_digest({"a": 2, "b": 1})


def test_corpus_helpers(spark):
    df = spark.createDataFrame([({"world": [1], "hello": [0, 2]},)], "m map<string,array<int>>")
    assert df.select(cp.inverted_abstract(df.m)).first()[0] == "hello world hello"
    base = spark.createDataFrame([("k", 1), ("k", 2), ("z", 3)], "id string, v int")
    up = spark.createDataFrame([("k", 9)], "id string, v int")
    assert rows(cp.upsert(base, up, key="id", columns=["v"])) == [("k", 9), ("k", 9), ("z", 3)]


def test_html_and_runs(spark, tmp_path):
    title, text, links = readers.parse_page("<html><title>T</title><script>no</script><body>A <a href='/x'>b</a> &amp; c</body></html>")
    assert (title, text, links) == ("T", "A b & c", ["/x"])
    run = spark.createDataFrame([("q", "a", 2.0, 1), ("q", "b", 1.0, 2)], "query_id string, doc_id string, score double, rank int")
    m = writers.write_run(run, str(tmp_path / "run"), method="m", top_k=2)
    assert m["rows"] == 2 and m["digest"] == writers.run_digest(run)
    (tmp_path / "r.json").write_text('{"query_id": "q", "scores": {"a": 1.5}}\n{"query_id": "p", "doc_id": "b", "score": 2}\n')
    assert rows(readers.read_run(spark, str(tmp_path / "r.json"))) == [("p", "b", 2.0), ("q", "a", 1.5)]
    (tmp_path / "c.csv").write_text("name,issn\n a  b ,\n")
    got = readers.read_catalog(spark, [str(tmp_path / "c.csv")], ["name", "issn"]).first()
    assert (got.name, got.issn) == ("a b", "")


def test_limiter_ignores_denied_events():
    lim = st.SlidingWindowLimiter(2, 10)
    assert [lim.allow(t)[0] for t in (0, 1, 2, 9, 10.5, 11.5)] == [True, True, False, False, True, True]


def test_key_pool_states():
    p = st.KeyPool(["a", "b"], 2, 60)
    assert [p.acquire(0), p.acquire(0)] == ["a", "b"]
    p.report("a", 429, 0)
    p.report("b", 403, 0)
    assert p.acquire(1) is None and p.acquire(61) == "a" and p.acquire(62) is None


def test_alerts():
    s = st.AlertState(60, 2)
    seen = [s.observe(x, t) for t, x in enumerate(["warning", "critical", None, "critical", "clean", "clean", "clean"])]
    assert seen == ["first", "escalation", None, None, None, "recovery", None]


def test_streaming_limiter(spark, tmp_path):
    import datetime as dt

    src = tmp_path / "in"
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("u", t0 + dt.timedelta(seconds=i)) for i in (0, 1, 2, 20)], "user string, ts timestamp").write.parquet(str(src))
    events = spark.readStream.schema("user string, ts timestamp").parquet(str(src))
    q = st.rate_limit_stream(events, key="user", ts="ts", limit=2, window=10.0).writeStream.format("memory").queryName("limited").outputMode("append").start()
    # Timeouts keep such a query busy, so it is stopped once the rows are there.
    for _ in range(120):
        if spark.sql("select * from limited").count() == 4 or not q.isActive:
            break
        time.sleep(0.5)
    q.stop()
    assert [r.allowed for r in spark.sql("select * from limited order by t").collect()] == [True, True, False, True]


def test_sign_bits(spark):
    v = spark.createDataFrame([(1, [1.0, -1.0, 0.5]), (2, [-1.0, -1.0, -0.5])], "id int, v array<float>")
    s = v.select("id", rt.sign_bits(v.v, 3).alias("s")).collect()
    assert [list(r.s) for r in s] == [[5], [0]]
