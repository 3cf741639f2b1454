import base64
import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from rankloom.llm import encode, langid, leakage, matching, packing, splits, subjects, topn
from rankloom.llm import text as tx

T0 = dt.datetime(2024, 1, 1)


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*(by or df.columns)).collect()]


# --- text

def test_normalisation():
    assert tx.fold(tx.clean("<p>Caf&eacute; ​Ａ&amp;B</p>")).split() == ["cafe", "a&b"]
    assert tx.words(tx.fold("关系x关")) == ["关系", "x", "关"]
    assert tx.dois(tx.fold(tx.clean("DOI：１０．９７０００／ＡＢＣ－１．v2."))) == ["10.97000/abc-1"]
    assert tx.dois("10.97000/pending") == []
    assert tx.alike("control", "conttrol") and tx.alike("measure", "meausre") and not tx.alike("1234", "1235") and not tx.alike("cat", "car")


LABELLED = tx.re.compile(r"(?:https?://[^\s/]+/|\bdoi\s*:?\s*)?" + tx._DOI.pattern)
ENTRY = tx.re.compile(r"[\r\n|;•*·]+|(?<=[.!?])\s+|(?<=[。！？])|\s{2,}")
SENTENCE_END = tx.re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*|(?<=[.!?]['\"”»)])\s+|[\r\n]+")


@settings(max_examples=500, deadline=None)
@given(hs.lists(hs.sampled_from([*"aB1_ .!?;|\n\r\t•*。！？\"”)'关系é/:,", "doi:", "xdoi ", "10.1234/ab-1", "https://", "http://x.org/", "10.97001/abc.07"]), max_size=40).map("".join))
def test_quick_patterns_break_where_the_plain_ones_do(s):
    folded = tx.fold(tx.clean(s))
    assert tx.strip_dois(folded) == LABELLED.sub("\n", folded)
    split = lambda p: [w for x in p if (w := tx.words(tx.fold(x)))]
    assert split(leakage._ENTRY.split(folded)) == split(ENTRY.split(folded))
    assert split(tx._SENTENCE_END.split(tx.clean(s))) == split(SENTENCE_END.split(tx.clean(s)))
    assert not folded.isascii() or tx.words(folded) == tx._TOKEN.findall(folded)


def test_words_of_other_letters_are_not_aligned(monkeypatch):
    monkeypatch.setattr(tx, "distance", lambda *_: pytest.fail("compared letter by letter"))
    assert not tx.alike("jurisprudence", "thermodynamics") and not tx.alike("computation", "management")
    item = ["jurisprudence", *(f"w{i}" for i in range(5))]
    assert not leakage.may_match(item, np.ones(6), ["thermodynamics", "management"], 0, 2, 0.8, 0.5)


def test_slices_of_documents_hash_different_words_once(spark, monkeypatch):
    weights, bits = leakage.Weights({"common": 0.5}), type("B", (), {"value": np.full(1 << 14, ~np.uint64(0))})
    texts = ["common a b c d | e f g h i common", "", "a b c d", "x | y z"]
    docs = spark.createDataFrame([(f"d{i}", t, []) for i, t in enumerate(texts)], "doc_id string, tokens string, dois array<string>").coalesce(1)
    want = set()
    for i, t in enumerate(texts):
        parts = [p.split(" ") for p in t.split(" | ")] if t else []
        words = [w for p in parts for w in p]
        signed = leakage.signed_bits(tx.hashes(words), weights.of(words))
        places = np.cumsum([0, *map(len, parts)]).tolist()
        want |= {(f"d{i}", k, 0, int(f)) for k, f in enumerate(leakage.window_fingerprints(signed, leakage.WIDTH).view(np.int64))}
        for k in range(len(parts)):
            for n in (1, 2):
                if k + n <= len(parts):
                    want.add((f"d{i}", places[k], n, int(leakage.packed(signed[places[k] : places[k + n]].sum(0, dtype=np.int32)[None]).view(np.int64)[0])))
    got = {(r.doc_id, r.at, r.span, r.fp) for r in leakage.document_hits(docs, weights, bits, 20).collect()}
    assert got == want
    counts = []

    class Once:
        def mapInArrow(self, run, _):
            self.run = run
            return self

    monkeypatch.setattr(tx, "hashes", lambda words, plain=tx.hashes: counts.append(len(words)) or plain(words))
    list(leakage.document_hits(Once(), weights, bits, 20).run(iter(docs.toArrow().to_batches())))
    assert sum(counts) == 15  # of 18: 13 different words, the break and the empty text


# --- problem 1

STUDY = "How dividend policy changes seasonal franchise contracts: evidence from Grofafleplo and Neskafena"
ABSTRACT = "Of 7855 items on retinal imaging, 11 were dropped for want of Ziricho controls. These findings bear on sleep apnoea as practised in Vanithe. A second survey in Spohefliwa confirms the trend."


@pytest.fixture(scope="module")
def held_out(spark):
    more = [(f"z{i}", f"Toward Name{i}lo: topic number {i * 7} without dairy herds in Place{i}ra", f"Records from Site{i} tie {i + 100} herds to barley. Nothing else was seen in Site{i} after {i + 3000} days.", None) for i in range(30)]
    data = [("q1", STUDY, ABSTRACT, "https://resolver.example/10.97001/abc-00000007.v2"), ("q2", "Book review", None, "10.97000/pending"), ("q3", None, "", "-"), ("q1", STUDY, ABSTRACT, "https://resolver.example/10.97001/abc-00000007.v2"),
            ("q4", "The Bepo approach to museum collections in Pitravide (Part II)", None, None), (None, STUDY, None, None), *more]
    return spark.createDataFrame(data, "query_id string, title string, abstract string, doi string").withColumn("doc_id", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))


def test_leaks(spark, held_out):
    docs = [
        ("title", "Recent papers\n- Other things\n- " + STUDY.upper() + "\nAll rights reserved."),
        ("typo", "History | How dividend policy cangs seasonal franchise contracts: evidence from Grofafleplo & Neskafena"),
        ("cut", "Published; dividend policy changes seasonal franchise contracts: evidence from Grofafleplo and Neskafena …"),
        ("other", "How dividend policy changes seasonal franchise contracts: evidence from Trebopi and Vagomira"),
        ("doi", "see doi : 10.97001%2FABC-00000007"), ("other doi", "10.97001/abc-00000008"),
        ("passage", "X. These findings bear on sleep apnoea as practissed in Vanithe. A second survey in Spohefliwa then confirms the trend. Y."),
        ("sentence", "These findings bear on sleep apnoea as practised in Vanithe."),
        ("part", "The Bepo approach to museum collections in Pitravide (Part I)"), ("generic", "Book review"),
        ("null", None), ("empty", ""), ("title", "Recent papers\n- " + STUDY), (None, STUDY), ("long", "word " * 60_000 + STUDY),
    ]
    df = spark.createDataFrame(docs, "doc_id string, text string").withColumnRenamed("extra", "query_id")
    assert rows(leakage.leaks(df, held_out)) == [(d, "q1") for d in ("cut", "doi", "long", "passage", "title", "typo")]
    assert leakage.leaks(df.limit(0), held_out).count() == 0
    assert leakage.leaks(df, held_out.limit(0)).count() == 0


@pytest.mark.parametrize(("batch", "parts"), [(1, 1), (7, 16), (10_000, 3)])
def test_leaks_do_not_depend_on_batches(spark, held_out, batch, parts):
    docs = [("p", "X. These findings bear on sleep apnoea as practissed in Vanithe. A second survey in Spohefliwa then confirms the trend. Y."), ("t", STUDY.upper()), ("o", "Nothing."), ("n", None)]
    df = spark.createDataFrame(docs, "doc_id string, text string").repartition(parts)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert rows(leakage.leaks(df, held_out.repartition(parts))) == [("p", "q1"), ("t", "q1")]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_span_sums_do_not_depend_on_the_slice(monkeypatch):
    words = [f"w{i % 37}" for i in range(500)]
    h, w, begin = tx.hashes(words), np.linspace(0.1, 1.0, 500), np.array([0, 3, 90, 91, 260, 499])
    fp, totals = leakage.token_fingerprints(h, w, begin)
    monkeypatch.setattr(leakage, "TOKENS_AT_ONCE", 17)
    again, sums = leakage.token_fingerprints(h, w, begin)
    assert (fp == again).all() and (totals == sums).all() and len(fp) == 500 - leakage.WIDTH + 1


def test_phrases_are_left_out_only_where_others_remain(spark):
    agree = [(f"d{i}", b"a", 0, 0, 1, 0, 2, -1, 1) for i in range(300)] + [(f"d{i}", b"b", -1, 0, 1, 0, 1, -1, -1) for i in range(300)] + [("d1", b"a", 1, 2, 9, 0, 1, 2, -1)]
    near = spark.createDataFrame(agree, "doc_id string, paper binary, item int, at int, fp bigint, shift int, own int, before int, after int")
    kept = {(bytes(r.paper), r.item) for r in leakage.searched(near).collect()}
    # Paper a's sentence has a second window; the title of paper b has this one alone.
    assert kept == {(b"b", -1), (b"a", 1)}


PHRASE = "Submissions reach at least two careful readers."
SYLLABLES = "bak cem dil fon gup haz jev kix lom nud pra quo rif sto tyw".split()


@pytest.fixture(scope="module")
def phrase_papers(spark):
    beside = [" ".join(f"{x}{w}{x}" for w in ("orchard", "tillage", "granite", "harvest", "mountain", "winter", "barley", "meadow")) for x in SYLLABLES]
    return beside, spark.createDataFrame([(f"q{i}", None, f"{PHRASE} {n.capitalize()}.", None) for i, n in enumerate(beside)], "query_id string, title string, abstract string, doi string")


def test_phrases_lead_to_edited_neighbours(spark, phrase_papers):
    # 15 papers times 22 documents agree on the phrase; no four words of the neighbour are left as they were.
    beside, papers = phrase_papers
    words = beside[7].split()
    words[2], words[5] = words[2][:-2] + words[2][-1], words[5][:3] + "x" + words[5][3:]
    docs = [(f"d{i}", f"{PHRASE} Nothing else was said in number {i}.") for i in range(20)] + [("after", f"{PHRASE} {' '.join(words)}."), ("before", f"{' '.join(words)}. {PHRASE}")]
    assert rows(leakage.leaks(spark.createDataFrame(docs, "doc_id string, text string"), papers)) == [("after", "q7")]


def test_no_agreement_is_left_out_of_the_query(spark, phrase_papers, monkeypatch):
    # 300 documents hold the phrase and the neighbour of q3, more than COMMON, and each of them is found.
    monkeypatch.setattr(leakage, "searched", lambda _: pytest.fail("no query calls this"))
    beside, papers = phrase_papers
    docs = spark.createDataFrame([(f"d{i:03d}", f"Number {i}. {PHRASE} {beside[3].capitalize()}.") for i in range(leakage.COMMON + 100)], "doc_id string, text string")
    assert rows(leakage.leaks(docs, papers)) == [(f"d{i:03d}", "q3") for i in range(leakage.COMMON + 100)]


def test_a_phrase_of_many_papers_is_searched_once(phrase_papers):
    papers = leakage.papers_of(leakage.with_paper(phrase_papers[1]))
    windows = leakage.item_windows(papers, leakage.Weights({})).filter("at >= 0").groupBy("fp").count()
    assert windows.filter("count > 1").count() == 0


def test_decisive_words_have_a_spelling_in_common_with_what_is_found():
    rng, letters = np.random.default_rng(2), list("abcdefgh")
    for _ in range(2000):
        a = "".join(rng.choice(letters, rng.integers(3, 14)))
        b = list(a)
        for _ in range(rng.integers(0, 3)):
            i = int(rng.integers(0, len(b)))
            b[i : i + rng.integers(0, 2)] = rng.choice(letters, rng.integers(0, 2))
            if len(b) > i + 1 and rng.random() < 0.3:
                b[i], b[i + 1] = b[i + 1], b[i]
        b = "".join(b)
        if b and tx.alike(a, b):
            assert np.intersect1d(leakage.spellings(a), leakage.spellings(b)).size
    assert leakage.decisive("a b c d".split(), np.array([1.0, 1.0, 0.4, 0.4])) == ["a"]
    assert leakage.bitmap_bits(600_000) == 26 and leakage.bitmap_bits(10**9) == 30 and leakage.bitmap_bits(0) == 20


def test_simhash_blocks_cover_the_radius():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, size=200, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, size=200, dtype=np.uint64))
    ka, kb = leakage.block_keys(a, 1), leakage.block_keys(b, 1)
    assert all((x == y) | (z == w) for x, y, z, w in zip(ka[0], kb[0], ka[1], kb[1], strict=True))


# --- problem 2

PROSE = {
    "en": "we examine how the number of cases has changed since that year and discuss what this means for those who work here. we see the results of this study and the effect was stronger for the first group than for the second.",
    "fr": "les travaux antérieurs reposaient sur de petits échantillons et restent mal compris. nous étudions comment le nombre de cas a changé depuis cette année et ce que cela signifie.",
    "de": "wir untersuchen, wie sich die zahl der fälle in dieser zeit verändert hat, und was dies heißt. der zusammenhang zwischen den beiden gruppen in dieser stadt ist kaum verstanden.",
    "zh": "这项研究考察了两组之间的联系，并讨论了其意义。我们采用问卷调查，比较了不同情形下的结果。",
}


@pytest.fixture(scope="module")
def reader():
    return langid.Classifier(*langid.train([], seeds=PROSE))


def test_rejects_what_no_dictionary_helps():
    rng = np.random.default_rng(3)
    topics = {k: v.rstrip(".。").replace("。", ". ").split(". ") for k, v in PROSE.items()}
    texts = [". ".join(rng.permutation(topics[k])) + f". {' '.join(rng.choice(PROSE[k].split(), 6))}." for k in PROSE for _ in range(60)]
    c = langid.Classifier(*langid.train(texts, seeds=PROSE))
    assert c.languages_of("We examine how the number of cases has changed since that year.")[0][0] == "en"
    for foreign in ("Результаты этого исследования показывают, что связь между двумя группами существует и была замечена раньше.", "I risultati mostrano che esiste un legame tra i due gruppi e che non era stato osservato prima.", "ok", "この研究の結果は、二つのグループの間に関係があることを示している。"):
        assert c.languages_of(foreign) == []
    assert set(langid.SEEDS) == {"en", "fr", "de", "es", "zh"}


def test_languages(reader):
    assert reader.languages_of("这项研究考察了两组之间的联系，并讨论了其意义。")[0][0] == "zh"
    assert [x[0] for x in reader.languages_of("Wir untersuchen den Zusammenhang zwischen den beiden Gruppen in dieser Stadt.")] == ["de"]
    both = reader.languages_of("We examine how the number of cases has changed since that year.\nLes travaux antérieurs reposaient sur de petits échantillons et restent mal compris.")
    assert [x[0] for x in both] == ["en", "fr"] and all(0 < x[1] <= 1 for x in both)
    assert [x[0] for x in reader.languages_of("We examine how the number of cases (les soins intensifs) has changed here.")] == ["en"]
    assert reader.languages_of(None) == reader.languages_of("") == reader.languages_of(" 12 ") == []
    assert reader.languages_of("We see the results of this study. " * 3000)[0][0] == "en"


def test_wrong_labels(spark):
    en, de = "We examine how the number of cases has changed since that year and discuss what this means.", "Wir untersuchen, wie sich die Zahl der Fälle in dieser Zeit verändert hat, und was dies heißt."
    q = spark.createDataFrame([("a", en), ("b", en), ("c", de), ("d", de), ("e", f"{en}\n{de}"), ("f", None), ("g", en), ("g", en), (None, en), ("h", f"{en}\n{de}")], "query_id string, text string")
    p = spark.createDataFrame([("a", " EN-gb", T0), ("b", "fr", T0), ("c", "other", T0), ("d", None, T0), ("e", "de", T0), ("f", None, T0), ("h", "Mixed ", T0), (None, "en", T0), ("a", "zz", dt.datetime(2020, 1, 1))], "query_id string, language string, profiled_at timestamp")
    got = [(r.query_id, r.language) for r in langid.wrong_labels(q, p, seeds=PROSE).orderBy("query_id", "language").collect()]
    assert got == [("b", "en"), ("d", "de"), ("e", "de"), ("e", "en"), ("g", "en")]
    assert langid.wrong_labels(q.limit(0), p, seeds=PROSE).count() == 0
    assert langid.wrong_labels(q, p.limit(0), seeds=PROSE).select("query_id").distinct().count() == 7
    assert {r.language for r in langid.text_segments(q.filter("query_id = 'e'"), seeds=PROSE).collect()} == {"en", "de"}


# --- problem 3

def test_overlaps(spark):
    a = "Of 7855 items on retinal imaging, 11 were dropped for want of Ziricho controls. These findings bear on sleep apnoea as practised in Vanithe. A second survey in Spohefliwa confirms 4321 cases. We release the Klopane material with 8080 notes."
    turned = "A second survey in Spohefliwa confirms 4321 cases. We release the Klopane material with 8080 notes. Of 7855 items on retinal imaging, 11 were droped for want of Ziricho controls. These findings bear on sleep apnoea as practised in Vanithe."
    data = [
        ("q1", "train", "s", STUDY, a, "10.9/none"), ("q2", "test", "s", "Another heading with Vanithe and Ziricho for seven words", turned, None),
        ("q3", "validation", "t", STUDY.lower(), None, "10.97001/x-11"), ("q4", "train", "t", None, None, "DOI 10.97001/X-11"),
        ("q5", "train", "s", "Book review", None, None), ("q6", "test", "s", "Book review", None, None),
        ("q7", "train", "s", "The Bepo approach to museum collections in Pitravide (Part I)", None, None), ("q8", "test", "s", "The Bepo approach to museum collections in Pitravide (Part II)", None, None),
        ("q9", "train", None, None, None, None), ("q10", "test", None, "", "", ""), ("q1", "train", "s", STUDY, a, "10.9/none"), (None, "test", "s", STUDY, a, None),
    ]
    q = spark.createDataFrame(data, "query_id string, split string, source string, title string, abstract string, doi string").withColumn("node", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    got = rows(splits.overlaps(q).select("query_id_a", "query_id_b"))
    assert got == [("q1", "q2"), ("q1", "q3"), ("q2", "q4"), ("q3", "q4")]
    assert sum(r.pairs for r in splits.overlap_counts(q).collect()) == 4
    assert splits.overlaps(q.limit(0)).count() == 0


def test_abstracts_without_rare_words_agree_by_their_shingles():
    names = [f"nam{chr(97 + i // 5)}{chr(97 + i % 5)}o" for i in range(50)]
    edited = [*names[:10], "x", *names[11:30], "y", *names[31:]]
    frequent = frozenset([*names, "x", "y"])
    assert splits.same_paper("", " ".join(names), "", " ".join(edited), frequent)
    assert not splits.same_paper("", " ".join(names), "", " ".join(names[::-1]), frequent)


def test_candidates_are_all_pairs_of_a_bucket(spark):
    members = {7: [f"c{i:03d}" for i in range(150)], 8: [f"c{i:03d}" for i in range(100, 112)], 9: ["alone"]}
    b = spark.createDataFrame([(k, n, n) for k, ns in members.items() for n in ns], "bucket bigint, node string, label string")
    assert rows(splits.candidates(b)) == [(x, y) for i, x in enumerate(members[7]) for y in members[7][i + 1 :]]


def test_stars_spare_pairs_but_lose_no_link(spark):
    nodes = [f"c{i:03d}" for i in range(200)]
    b = spark.createDataFrame([(7, n) for n in nodes], "bucket bigint, node string")
    stars = splits.star_pairs(b)
    assert stars.count() == 199
    confirmed = stars.filter("b < 'c150'")  # 150 classes are one paper, the other 50 are open
    left = splits.candidates(splits.labelled(b, confirmed.unionByName(confirmed.selectExpr("a", "a as b").distinct())))
    pairs = {tuple(r) for r in left.collect()}
    assert all((x, y) in pairs for i, x in enumerate(nodes) for y in nodes[max(i + 1, 150) :])
    assert not any(y < "c150" for _, y in pairs)
    whole = splits.labelled(b, stars.unionByName(stars.selectExpr("a", "a as b").distinct()))
    assert whole.count() == 0


# --- problem 4

def test_match(spark):
    e = spark.createDataFrame([
        (1, "Acta Mabeni: Computer Networks", ["0378-5955"], "Q1", "c", "computing"), (1, "Acta Mabeni: Computer Networks", ["0378-5955"], "Q1", "c", "computing"),
        (2, "Acta Mabeni: Computer Networks Part C", ["2434-561X"], "Q2", "c", "computing"), (3, "Bulletin of the Rawagro Society for Oncology", None, None, None, None),
        (4, "Studies in Law", ["2049-3630"], "Q1", "l", "law"), (5, "Studies in Law Open", ["2049-3630"], "Q1", "l", "law"), (None, "x", [], None, None, None),
    ], "entity_id bigint, name string, issns array<string>, quartile string, category string, broad_field string")
    c = spark.createDataFrame([
        ("exact", "ACTA MABENI  Computer Networks (Print)", None, "Q1", "computing"), ("sister", "Acta Mabeni: Computer Networks Letters", None, None, None),
        ("issn", "A quite different former name", ["ISSN 2434561x"], None, None), ("name wins", "Bulletin of the Rawagro Society for Oncology", ["0378-5955"], None, None),
        ("abbr", "Bull. Rawa. Soci. Onco.", [], None, None), ("typo", "Bulletin of the Rawagro Socity for Oncology", [""], None, None), ("shared", "Studies in Law Open", ["2049-3630"], None, None),
        ("nobody", "Zeitschrift für Nichts", None, None, None), ("null", None, None, None, None), ("empty", "", [], "", ""), ("exact", "ACTA MABENI  Computer Networks (Print)", None, "Q1", "computing"), (None, "Studies in Law", None, None, None),
    ], "case_id string, gold_journal_name string, gold_issns array<string>, gold_jcr_quartile string, primary_field string")
    got = {r.case_id: r.entity_id for r in matching.match(c, e).collect()}
    assert got == {"exact": 1, "issn": 2, "name wins": 3, "abbr": 3, "typo": 3, "shared": 5}
    assert matching.match(c.limit(0), e).count() == 0 and matching.match(c, e.limit(0)).count() == 0


def test_mixture_separates_and_shares():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0.95, 0.03, (50, 4)), rng.normal(0.3, 0.1, (500, 4))])
    group = np.concatenate([np.arange(50), rng.integers(0, 50, 500)])
    p = matching.shared_posteriors(matching.fit(x, x[:, 0] > 0.6, group).log_odds(x), group)
    assert p[:50].min() > 0.9 and p[50:].max() < 0.1
    assert np.bincount(group, weights=p).max() <= 1.0 + 1e-9
    # Two records that are one thing have one answer; two entities cannot both be a record.
    same = matching.shared_posteriors(np.array([4.0, -4.0, 1.0, 1.0]), np.array([0, 1, 2, 2]), np.array([0, 0, 1, 2]))
    assert same[0] == same[1] == 0.5 and same[2] == same[3] < 0.5


def test_the_mixture_decides(spark, monkeypatch):
    e = spark.createDataFrame([(i, f"Journal {w} Studies", None, None, None, None) for i, w in enumerate(("Alpha", "Beta", "Gamma", "Delta"))], "entity_id bigint, name string, issns array<string>, quartile string, category string, broad_field string")
    c = spark.createDataFrame([(f"c{i}", f"Journal {w} Studies", None, None, None) for i, w in enumerate(("Alpha", "Beta", "Gamma", "Delta"))], "case_id string, gold_journal_name string, gold_issns array<string>, gold_jcr_quartile string, primary_field string")
    assert matching.match(c, e).count() == 4
    monkeypatch.setattr(matching, "fit", lambda x, *_: matching.Mixture(1e-4, np.zeros((2, 4)), np.stack([np.eye(4)] * 2)))
    assert matching.match(c, e).count() == 0


ENTITIES = "entity_id bigint, name string, issns array<string>, quartile string, category string, broad_field string"
CASES = "case_id string, gold_journal_name string, gold_issns array<string>, gold_jcr_quartile string, primary_field string"


def test_common_keys_lose_no_similar_name(spark):
    # Every word and the initials of entity 0 are those of over 40 others; the misspelt word of the case is a rare key of another.
    fill = [f"{a} {b} {c}" for a in ("Applied", "Archives", "Acoustic") for b in ("Physics", "Plants", "Polymers") for c in ("Reviews", "Records", "Reports", "Results", "Readings")]
    names = ["Applied Physics Reviews", *fill[1:], *(f"{w} {x}" for w in ("Applied", "Physics", "Reviews") for x in [*SYLLABLES, *map(str.upper, SYLLABLES), *(x * 2 for x in SYLLABLES)]), "Phsics of Quartz"]
    e = spark.createDataFrame([(i, n, None, None, None, None) for i, n in enumerate(names)], ENTITIES)
    c = spark.createDataFrame([("typo", "Applied Phsics Reviews", None, None, None)], CASES)
    records, known = matching.record_keys(matching.distinct_records(c).dropDuplicates(["rec"])), matching.catalogue(e)
    assert 0 in {r.entity_id for r in matching.candidates(records, known)[0].collect()}
    assert rows(matching.match(c, e).select("case_id", "entity_id")) == [("typo", 0)]


def test_similar_names_are_all_pairs(spark):
    rng = np.random.default_rng(5)
    stock = "international journal of computational interdisciplinary physics and chemistry studies review the data".split() + ["材料科学与里安研究", "材料科学与里安学报"]
    entities = list(dict.fromkeys(" ".join(rng.choice(stock, rng.integers(1, 6))) for _ in range(150)))

    def respelt(w):
        n = int(rng.integers(0, 5))
        i = int(rng.integers(0, len(w)))
        return (w[: i + 1], w[:i] + w[i + 1 :] or w, w[:i] + "q" + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :], w)[n]

    cases = [" ".join(respelt(respelt(w)) if rng.random() < 0.4 else w for w in n.split()) for n in entities for _ in range(2)]
    cases += ["".join(w[0] for w in n.split()) for n in entities[:40]] + [n[: len(n) * 2 // 3] for n in entities]
    e = matching.catalogue(spark.createDataFrame([(i, n, None, None, None, None) for i, n in enumerate(entities)], ENTITIES))
    r = matching.record_keys(matching.distinct_records(spark.createDataFrame([(n, n, None, None, None) for n in dict.fromkeys(cases)], CASES)))
    got = {(x.name, x.entity_id) for x in matching.similar_names(r, e).join(r.select("nid", "name"), "nid").collect()}
    words = [matching.spellings(n) for n in entities]
    want = {(c, i) for c in cases for i, ws in enumerate(words) if max((matching.name_similarity(matching.spellings(c), w) for w in ws), default=0) > matching.SISTERS}
    assert got == want and len(want) > 300


def test_words_that_may_stand_have_a_sign_in_common():
    rng, letters = np.random.default_rng(4), list("abcd")
    for _ in range(20_000):
        y = "".join(rng.choice(letters, rng.integers(1, 15)))
        b = list(y[: rng.integers(1, 15)])
        for _ in range(rng.integers(0, 3)):
            i = int(rng.integers(0, len(b) + 1))
            b[i : i + rng.integers(0, 2)] = rng.choice(letters, rng.integers(0, 2))
            if len(b) > i + 1 and rng.random() < 0.3:
                b[i], b[i + 1] = b[i + 1], b[i]
        x = "".join(b)
        if x and matching.word_may_stand(x, y):
            assert matching.name_signs(x) & matching.entity_signs(y), (x, y)


# --- problem 5

def test_top_n(spark):
    data = [("r", "q", d, s) for d, s in [("b ", 2.0), ("b", 3.0), (" a", 3.0), ("c", float("nan")), ("d", None), ("e", float("inf")), (" ", 9.0), (None, 9.0), ("é", 1.0), ("z", 1.0), ("　y ", 0.5)]]
    data += [("r", None, "x", 1.0)] + [("r", "hot", f"d{i:05}", float(i % 7)) for i in range(5000)] + [("r", "hot", "d00006", 6.0)] * 50
    df = spark.createDataFrame(data, "run_id string, query_id string, doc_id string, score double").withColumn("item", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0)).repartition(5)
    got = rows(topn.top_n(df, groups=["run_id", "query_id"], item="doc_id", score="score", n=5), "query_id", "score", "doc_id")
    by = {q: {d for _, k, d, _ in got if k == q} for q in ("q", "hot", None)}
    assert by["q"] == {"a", "b", "z", "é", "y"} and by[None] == {"x"} and by["hot"] == {"d00006", "d00013", "d00020", "d00027", "d00034"}
    assert ("r", "q", "b", 3.0) in got
    assert topn.top_n(df.limit(0), groups=["run_id"], item="doc_id", score="score", n=3).count() == 0


# --- problem 6

@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    path = encode.tokenizer_path().replace(".json", ".tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=encode.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(hs.lists(hs.text(max_size=60), max_size=8))
def test_replay_equals_the_public_encoder(public, texts):
    enc = encode.encoder(encode.tokenizer_path())
    out = []
    for ids, per in enc.encode(texts):
        cuts = np.concatenate(([0], np.cumsum(per)))
        out += [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)]
    assert out == [public.encode_ordinary(t) for t in texts]


def test_encode_corpus(spark, public):
    texts = ["aaaa aaaaa", "", None, "  \n ", "<|endoftext|>", "啊" * 5000, "word " * 40_000, "it's Grofafleplo's"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, "again", "x")], "doc_id bigint, text string, ids string")
    got = rows(encode.encode_corpus(df))
    assert sorted((i, tuple(x)) for i, x in got) == sorted([*((i, tuple(public.encode_ordinary(t or ""))) for i, t in enumerate(texts)), (0, tuple(public.encode_ordinary("again")))])
    assert encode.encode_corpus(df.limit(0)).count() == 0


# --- problem 7

def naive_best_fit(sizes, capacity):
    rooms = []
    for n in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=100, deadline=None)
@given(hs.lists(hs.integers(1, 30), max_size=80))
def test_plan_equals_item_by_item_best_fit(sizes):
    h = {n: sizes.count(n) for n in set(sizes)}
    plan = packing.plan_containers(h, 30)
    assert sum(c for c, _ in plan) == naive_best_fit(sizes, 30)
    held = {}
    for c, pattern in plan:
        assert sum(n * k for n, k in pattern) <= 30
        for n, k in pattern:
            held[n] = held.get(n, 0) + c * k
    assert held == h


def test_pack_places_every_token_once(spark):
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([3, 3, 3, 5, 8, 10, 25, 0, None, 7, 7, 3] + [4] * 100)] + [(0, 3)], "doc_id bigint, n_tokens bigint")
    w = spark.createDataFrame([("a", 10, "t"), ("b", 64, "t"), ("a", 10, "t")], "window_name string, capacity_tokens int, tokenizer string")
    got = packing.pack(sizes, w).collect()
    for name, cap in (("a", 10), ("b", 64)):
        mine = [r for r in got if r.window_name == name]
        assert sum(r.piece_tokens for r in mine) == sum(n or 0 for _, n in map(tuple, sizes.collect()))
        assert sum(r.container_id is None for r in mine) == 2
        spans = {}
        for r in mine:
            if r.container_id is not None:
                spans.setdefault(r.container_id, []).append((r.container_offset, r.container_offset + r.piece_tokens))
        for s in spans.values():
            s.sort()
            assert s[-1][1] <= cap and all(a[1] <= b[0] for a, b in zip(s, s[1:], strict=False))
        assert max(r.piece for r in mine) == (2 if cap == 10 else 0)
    assert packing.pack(sizes.limit(0), w).count() == 0
    twice = spark.createDataFrame([("a", 10), ("a", 64)], "window_name string, capacity_tokens int")
    unique = sizes.filter("doc_id > 0")
    found = packing.pack(unique, twice)
    assert {r.n for r in packing.violations(found, unique).collect()} == {0}
    assert {r.capacity_tokens for r in packing.utilization(found).collect()} == {10, 64}
    with pytest.raises(ValueError):
        packing.pack(sizes, spark.createDataFrame([("x", 0)], "window_name string, capacity_tokens int"))


# --- problem 8

def test_subjects(spark):
    words = {"law": ["tort liability", "plea agreements", "custody rulings", "appellate review"], "sport": ["sprint starts", "jump landings", "altitude camps", "penalty kicks"], "physics": ["spin waves", "photon counting", "dark matter", "muon lifetimes"]}
    docs, labels = [], []
    for s, (name, topics) in enumerate(words.items()):
        for i in range(40):
            a, b = topics[i % 4], topics[(i + 1 + i // 4) % 4]
            docs.append((s * 100 + i, f"We examine {a} in {i} records. The link between {a} and {b} remains open. Submissions are reviewed by two readers.", s))
            if i < 30:
                labels.append((s * 100 + i, name, "x", T0))
    docs += [(900, None, None), (901, "", None), (902, " ", None), (903, "Submissions are reviewed by two readers.", None), (904, "We examine tort liability here. We examine sprint starts here.", 0), (0, docs[0][1], 0), (None, docs[0][1], 0), (905, "We examine muon lifetimes in 7 records. " * 4000, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, entity_id bigint").withColumn("subject", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    lab = spark.createDataFrame([*labels, (None, "law", "x", T0), (3, None, "x", T0)], "doc_id bigint, subject string, labeler string, labeled_at timestamp")
    sub = spark.createDataFrame([(s, "") for s in words], "subject string, description string")
    ent = spark.createDataFrame([(i, s.upper()) for i, s in enumerate(words)], "entity_id bigint, broad_field string")
    got = {}
    for r in subjects.subjects_of(d, lab, sub, ent).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert all(got.get(s * 100 + i) == {n} for s, n in enumerate(words) for i in range(40))
    assert not {900, 901, 902, 903, None} & set(got) and got[904] == {"law", "sport"} and got[905] == {"physics"}
    assert subjects.subjects_of(d.limit(0), lab, sub, ent).count() == 0
    assert subjects.subjects_of(d, lab.limit(0), sub, ent).count() >= 0
    comp = {r.subject: r.documents for r in subjects.composition(subjects.subjects_of(d, lab, sub, ent)).collect()}
    assert comp["law"] == 41
