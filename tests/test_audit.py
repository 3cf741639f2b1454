import datetime as dt

import numpy as np
import pytest

from rankloom.functions import text as tf
from rankloom.operators import audit as au
from rankloom.operators import graph as gr
from rankloom.operators import metrics as mt
from rankloom.operators import quality as ql
from rankloom.operators import retrieval as rt


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*(by or df.columns)).collect()]


def one(spark, value, f, kind="string"):
    df = spark.createDataFrame([(value,)], f"s {kind}")
    return df.select(f(df.s).alias("x")).first().x


def test_stop_words_are_the_listed_ones():
    assert set(tf.STOP_WORDS) == set("a an and are as at be by for from in is it of on or our that the this to using we with".split())


def test_tokens_of_all_scripts(spark):
    assert one(spark, "Our C++ and ＰyＴhon-3. code: 图神经网络 x", tf.tokens) == ["c++", "python-3", "code", "图", "神", "经", "网", "络", "图神", "神经", "经网", "网络", "x"]
    assert one(spark, None, tf.tokens) == [] and one(spark, "", tf.tokens) == []
    assert one(spark, "C++ a 图神经", tf.counted_tokens) == ["c++", "图神经", "图神", "神经"]
    assert one(spark, "图神经网", tf.signal_terms) == ["图神经", "神经网", "图神经网"]


def test_names_of_all_scripts(spark):
    assert one(spark, "  Ｊournal & Straße：计算机学报 ", tf.normalize_name) == "journal and strasse 计算机学报"
    assert one(spark, "C++ / .NET", tf.normalize_search) == "c++ .net"
    assert one(spark, "<p>Abstract: A&amp;B</p>", tf.markup_text) == "A&B"
    assert one(spark, "see 2049-3630, ISSN 03785955", tf.issn_spellings) == ["2049-3630", "0378-5955"]
    assert one(spark, "2049–363x", tf.lookup_key) == "2049363X"
    assert one(spark, "http://a.journals.example/x", lambda c: tf.host_ends_with(c, ["journals.example"])) is True
    assert one(spark, "http://journals.example.evil/x", lambda c: tf.host_ends_with(c, ["journals.example"])) is False
    assert abs(one(spark, "ab cdab", lambda c: tf.covered_share(c, ["ab", "bc"])) - 5 / 6) < 1e-9


def test_intents_ignore_negated_mentions(spark):
    df = spark.createDataFrame([("This is not a review, it is original research.",), ("A systematic review",), (None,)], "s string")
    o, r = tf.article_intents(df.s)
    assert [tuple(x) for x in df.select(o, r).collect()] == [(True, False), (False, True), (False, False)]


def test_enrich_keeps_rows_and_marks_ambiguity(spark):
    records = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, k string")
    scopes = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z"), ("d", "w"), (None, "n")], "k string, scope string")
    got = {r.id: (r.status, r.scope) for r in au.enrich(records, scopes, ["k"], ["scope"]).collect()}
    assert got == {1: ("matched", "x"), 2: ("ambiguous", None), 3: ("unmatched", None), 4: ("unmatched", None)}
    assert rows(au.unmatched(scopes, records, ["k"]).select("k").filter("k is not null")) == [("d",)]


def test_translation_and_unsealing(spark):
    q = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 1)], "query_id string, doc_id string, gain int")
    m = spark.createDataFrame([("a", "A"), ("b", "A")], "old string, new string")
    assert {tuple(r) for r in au.translate(q, m).collect()} == {("q", "A", 2), ("q", None, 1)}
    left, right = spark.createDataFrame([("1",), ("2",)], "k string"), spark.createDataFrame([("2",), ("3",)], "k string")
    assert dict(rows(au.unseal(left, right, "k"))) == {"both": 1, "blind_only": 1, "labels_only": 1}


def test_remap_keeps_order_and_repeats(spark):
    r = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["z"])], "id int, ids array<string>")
    got = dict(rows(au.remap(r, key="id", ids="ids", crosswalk=spark.createDataFrame([("b", "B")], "old string, new string"))))
    assert got == {1: ["B", "a", "B"], 2: ["z"]}


def test_exclusions_and_blinding(spark):
    p = spark.createDataFrame([(1, ["x"]), (2, ["y"]), (3, [])], "id int, src array<string>")
    assert [r.id for r in au.exclude_citing(p, spark.createDataFrame([("x",)], "source string"), key="id", sources="src").orderBy("id").collect()] == [2, 3]
    run = spark.createDataFrame([("m", "q", "a", 1), ("n", "q", "a", 1), ("n", "q", "b", 2)], "method string, query_id string, doc_id string, rank int")
    pool = au.blinded_pool(run, k=2, seed="s").collect()
    assert {r.doc_id for r in pool} == {"a", "b"} and sorted(r.position for r in pool) == [1, 2]
    assert au.public_columns(au.blinded_pool(run, k=2, seed="s")) == [] and au.public_columns(run) == ["method", "rank"]
    assert {r.doc_id: r.agreement for r in au.agreement(run, 2).collect()} == {"a": 1.0, "b": 0.5}


def test_near_duplicates_collapse_copies(spark):
    words = [f"w{i}" for i in range(40)]
    sh = lambda ws: [" ".join(ws[i : i + 5]) for i in range(len(ws) - 4)]
    copies = [(f"t{i:03d}", "train", sh(words)) for i in range(150)]  # more than the audit's limit, yet one text
    data = [*copies, ("x", "test", sh(words[:-1] + ["z"])), ("y", "test", sh([f"u{i}" for i in range(40)])), ("n", "test", [])]
    df = spark.createDataFrame(data, "id string, split string, g array<string>")
    assert [(r.a, r.b) for r in au.near_duplicates(df, key="id", split="split", shingles="g").collect()] == [("t000", "x")]


def test_sequential_helpers():
    assert au.allocate_diagonal({("a", "1"): 5, ("a", "2"): 1, ("b", "1"): 5, ("b", "2"): 5}, 6) == {("a", "1"): 2, ("a", "2"): 1, ("b", "1"): 1, ("b", "2"): 2}
    assert au.pack_prompt([5, 9, 4, 1], 10) == [0, 2, 3]
    assert au.date_window(None, None, "2024-03-01", 10) == ("2024-02-20", "2024-03-01")
    with pytest.raises(ValueError):
        au.date_window("2024-03-02", "2024-03-01", "2024-04-01")
    assert au.call_bound(11, 5, 2, 2) == 18


def test_judged_fusion_needs_relevance(spark):
    local = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, doc_id string, rank int")
    api = spark.createDataFrame([("q", "b", 1, 90.0), ("q", "c", 2, 59.0), ("q", "d", 3, 60.0)], "query_id string, doc_id string, rank int, relevance double")
    assert [r.doc_id for r in au.rank_fusion(local, api).orderBy("rank").collect()] == ["b", "a", "d"]


def test_graph_is_checked_before_it_is_written(spark, tmp_path):
    nodes = spark.createDataFrame([("v1", "venue"), ("p1", "profile"), ("p1", "profile")], "id string, kind string")
    edges = spark.createDataFrame([("v1", "p1", "HAS"), ("v1", "p9", "HAS"), ("v1", "v1", "HAS")], "source string, target string, kind string")
    assert dict(rows(gr.integrity(nodes, edges))) == {"dangling_source": 0, "dangling_target": 1, "repeated_node": 1, "repeated_edge": 0, "loop": 1}
    with pytest.raises(ValueError):
        gr.write_snapshot(nodes, edges, str(tmp_path / "g"))
    assert not (tmp_path / "g").exists()
    gr.write_snapshot(nodes.distinct(), edges.limit(1), str(tmp_path / "g"))
    back, links = gr.read_snapshot(spark, str(tmp_path / "g"))
    assert back.count() == 2 and rows(gr.neighbours(back.filter("kind = 'venue'"), links)) == [("v1", "p1", "HAS", "out")]


def test_property_graph_run_weighs_evidence(spark):
    q = spark.createDataFrame([("q", "graph retrieval")], "query_id string, text string")
    p = spark.createDataFrame([("p1", "v1", "graph retrieval"), ("p2", "v2", "medicine")], "unit_id string, doc_id string, text string")
    e = spark.createDataFrame([("e1", "v1", "graph"), ("e2", "v1", "retrieval"), ("e3", "v2", "graph care")], "unit_id string, doc_id string, text string")
    got = gr.property_graph_run(q, p, e).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["v1", "v2"] and got[0].score > 1 / 61 + 1 / 62


def test_cosine_in_blocks_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(600, 16))
    data = [(i, m[i].tolist(), i % 5) for i in range(600)] + [(700, [0.0] * 16, 1), (701, None, 1)]
    df = spark.createDataFrame(data, "id bigint, v array<float>, label int")
    monkeypatch.setattr(rt, "BLOCK_ROWS", 64)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = unit[::20] @ unit.T
    s[np.arange(30), np.arange(0, 600, 20)] = -2
    want = {i * 20: set(np.argsort(-s[i])[:10].tolist()) for i in range(30)}
    asked = df.filter("id % 20 = 0")

    def found(run):
        out = {}
        for r in run.collect():
            out.setdefault(r.query_id, set()).add(r.doc_id)
        return out

    exact = found(rt.cosine(asked, df, key="id", vector="v", k=10))
    assert sum(len(exact[q] & want[q]) for q in want) >= 299 and set(exact) == set(want)
    near = found(rt.signbit_cosine(asked, df, key="id", vector="v", k=10))
    assert sum(len(near[q] & want[q]) for q in want) >= 0.9 * 300
    pooled = rt.cosine(asked, df, key="id", vector="v", k=None, pool="label").collect()
    assert len(pooled) == 150 and {r.doc_id for r in pooled} == {0, 1, 2, 3, 4}
    assert rt.cosine(asked.limit(0), df, key="id", vector="v").count() == 0


def test_statistics_without_collecting(spark):
    d = spark.createDataFrame([(f"q{i}", float(i % 5) - 1) for i in range(200)], "query_id string, difference double")
    r = mt.poisson_bootstrap(d).first()
    assert r.mean == 1.0 and 0.7 < r.low < 1.0 < r.high < 1.3 and r.above == 1.0
    assert tuple(mt.poisson_bootstrap(d.repartition(7)).first()) == tuple(r)
    s = spark.createDataFrame([(i, 1.0) for i in range(3)], "i int, d double")
    assert mt.exact_signs(s, key="i", value="d").first().p == mt.permutation_p([1.0, 1.0, 1.0]) == 0.25


def test_ranged_digest_depends_on_values_alone(spark):
    df = spark.createDataFrame([("g", i) for i in range(300)], "g string, v int")
    a, b = (ql.ranged_digest(x, ["g"], "v").first().digest for x in (df, df.repartition(9)))
    assert a == b != ql.ranged_digest(df.filter("v > 0"), ["g"], "v").first().digest


def test_contained_titles_expands_equal_titles(spark):
    items = spark.createDataFrame([("q1", "alpha beta gamma"), ("q2", "alpha beta gamma"), ("q3", "beta gamma delta")], "query_id string, title string")
    texts = spark.createDataFrame([("d", "x alpha beta gamma y"), ("e", "alpha beta gammas"), ("f", "")], "doc_id string, text string")
    assert rows(ql.contained_titles(items, texts)) == [("q1", "d"), ("q2", "d")]


def test_dates_in_the_past_only():
    assert au.date_window("2020-01-01", "2020-02-01", dt.date(2024, 1, 1).isoformat()) == ("2020-01-01", "2020-02-01")
