"""Same or nearly same records across splits (problem 3).

Method: minwise hashing of word shingles with banded buckets, exact verification, closure, and counts per split
and source.

Records of equal normalised title and abstract form one class. Classes get minwise hashes
of their five-word abstract shingles and of the word pairs of their titles; shingles made of frequent words
alone are left out where others exist, so that set phrases fill no buckets. Bands give candidate pairs, which
are verified exactly: by Jaccard similarity and containment of abstract shingles, or, where an abstract is missing, by
aligning titles. Equal DOIs link as well. Links within a split are kept up to the closure,
as records that are the same by way of a third one count; only cross-split pairs come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import text as tx
from rankloom.llm.leakage import PARTS, align, names_study, query_dois
from rankloom.operators.components import connected_components
from rankloom.runtime import materialize, ship

SHINGLE = 5
RARE = 0.0005
LEAST_FREQUENT = 20
ABSTRACT_BANDS, ABSTRACT_ROWS = 16, 2
TITLE_BANDS = 8
LEAST_ABSTRACT = 12
CONTAINED = 0.45
TITLE_SHARE = 0.8
NAMES_SHARE = 0.75
RARE_SHARE = 0.65
FIGURES_SHARE = 0.6
BLOCK = 64


def records_of(queries: DataFrame) -> DataFrame:
    """(query_id, split, source, title, abstract): words of each record, joined by blanks; one row per id."""
    src = queries.select(*[F.col(c).cast("string").alias(c) for c in ("query_id", "split", "source", "title", "abstract")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            title = [" ".join(tx.words(tx.fold(tx.clean(t)))) for t in b.column(3).to_pylist()]
            abstract = [" | ".join(" ".join(s) for s in tx.sentences(a)) for a in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(title, pa.string()), pa.array(abstract, pa.string())], names=["query_id", "split", "source", "title", "abstract"])

    # Of deliveries that differ, one is taken whole.
    one = src.filter("query_id is not null").groupBy("query_id").agg(F.min(F.struct("split", "source", "title", "abstract")).alias("r")).select("query_id", "r.*")
    return one.mapInArrow(run, "query_id string, split string, source string, title string, abstract string")


def with_class(records: DataFrame) -> DataFrame:
    """Adds node: records of equal text share one; a record with nothing that names a study is alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = []
            for q, t, a in zip(*(b.column(c).to_pylist() for c in (0, 3, 4)), strict=True):
                own = a.count(" ") >= LEAST_ABSTRACT or names_study(t.split(" "))
                node.append("c" + tx.xxhash.xxh3_128_hexdigest(f"{t}\n{a}") if own else f"q{q}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node, pa.string())], names=[*b.schema.names, "node"])

    return records.mapInArrow(run, "query_id string, split string, source string, title string, abstract string, node string")


def frequent_words(classes: DataFrame) -> frozenset[str]:
    """Words that stand in more than ``RARE`` of all classes (and ``LEAST_FREQUENT`` of them); at most mean length / ``RARE``."""
    n = classes.count()
    least = max(LEAST_FREQUENT, int(RARE * n))
    df = classes.select(F.explode(F.array_distinct(F.split(F.concat_ws(" ", "title", "abstract"), " "))).alias("w")).groupBy("w").count()
    return frozenset(r[0] for r in df.filter(F.col("count") > least).select("w").collect())


def shingle_hashes(tokens: list[str], width: int, frequent: frozenset[str]) -> np.ndarray:
    """Hashes of the shingles that hold a rare word; of all shingles if none does."""
    n = len(tokens) - width + 1
    if n <= 0:
        return tx.hashes([" ".join(tokens)]) if tokens else np.zeros(0, dtype=np.uint64)
    h = tx.hashes(tokens)
    out = h[:n].copy()
    for j in range(1, width):
        out = tx.mix(out) + h[j : n + j]
    rare = np.fromiter((t not in frequent for t in tokens), dtype=bool, count=len(tokens))
    holds = np.zeros(n, dtype=bool)
    for j in range(width):
        holds |= rare[j : n + j]
    return np.unique(out[holds] if holds.any() else out)


_SALTS = tx.mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x51ED270B))


def minhashes(shingles: np.ndarray, count: int) -> np.ndarray:
    return tx.mix(shingles[:, None] ^ _SALTS[None, :count]).min(axis=0)


def bands(classes: DataFrame, frequent: frozenset[str]) -> DataFrame:
    """(bucket, node): the buckets of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buckets, row = [], []
            for r, (t, a) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                tokens = [w for w in a.split(" ") if w and w != "|"]
                keys = []
                if len(tokens) >= LEAST_ABSTRACT:
                    m = minhashes(shingle_hashes(tokens, SHINGLE, frequent), ABSTRACT_BANDS * ABSTRACT_ROWS)
                    key = m[:ABSTRACT_BANDS]
                    for i in range(1, ABSTRACT_ROWS):
                        key = tx.mix(key) + m[i * ABSTRACT_BANDS : (i + 1) * ABSTRACT_BANDS]
                    keys.append(key + np.arange(ABSTRACT_BANDS, dtype=np.uint64))
                title = t.split(" ")
                if names_study(title):
                    keys.append(minhashes(shingle_hashes(title, 2, frequent), TITLE_BANDS) ^ np.uint64(0x5DEECE66D))
                if keys:
                    key = np.unique(np.concatenate(keys))
                    buckets.append(key)
                    row += [r] * len(key)
            if row:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets).view(np.int64)), b.column(0).take(pa.array(row))], names=["bucket", "node"])

    return classes.select("node", "title", "abstract").mapInArrow(run, "bucket bigint, node string")


def star_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b), a < b: each class with the least class of each of its buckets, as many pairs as rows at most."""
    least = buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return buckets.join(least, "bucket").filter("node <> a").select("a", F.col("node").alias("b")).distinct()


def labelled(buckets: DataFrame, stars: DataFrame) -> DataFrame:
    """(bucket, node, label) of the buckets that hold more than one label: classes confirmed with one star have it as label.

    So a bucket filled by copies of one paper is done after its stars, however large it is.
    """
    label = stars.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
    known = buckets.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = known.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
    return known.join(open_, "bucket", "left_semi")


def candidates(buckets: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of classes that share a bucket and have different labels. ``buckets``: bucket, node, label.

    The members of a bucket are dealt to blocks of about ``BLOCK`` and each block meets each other one in a
    group of its own, so that no task holds a large bucket whole.
    """
    sizes = buckets.groupBy("bucket").count().filter("count > 1").select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    held = buckets.join(sizes, "bucket").withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    left = held.select("bucket", F.col("node").alias("x"), F.col("label").alias("lx"), F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    right = held.select("bucket", F.col("node").alias("y"), F.col("label").alias("ly"), F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"))
    met = left.join(right, ["bucket", "i", "j"]).filter("lx <> ly and (i < j and x <> y or x < y)")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def part_of(title: list[str]) -> str:
    """The number that a title gives itself within a series, or ''."""
    tail = [t for t in title[-3:] if t in PARTS]
    return tail[-1] if tail and title[-1] in PARTS else ""


def same_paper(ta: str, aa: str, tb: str, ab: str, frequent: frozenset[str]) -> bool:
    """Whether two records (title and abstract words) describe one paper."""
    title_a, title_b = ta.split(" ") if ta else [], tb.split(" ") if tb else []
    part_a, part_b = part_of(title_a), part_of(title_b)
    if part_a and part_b and part_a != part_b:
        return False
    x = [w for w in aa.split(" ") if w and w != "|"]
    y = [w for w in ab.split(" ") if w and w != "|"]
    if len(x) >= LEAST_ABSTRACT and len(y) >= LEAST_ABSTRACT:
        return _abstracts_agree(aa, ab, frequent)
    if not names_study(title_a) or not names_study(title_b) or (part_a or part_b) and part_a != part_b:
        return False
    short, long = sorted((title_a, title_b), key=len)
    pairs = align(short, long, 0, len(long))
    if len(pairs) < TITLE_SHARE * len(short) or len(pairs) < 0.55 * len(long):
        return False
    # Titles on one pattern differ in their names.
    rare = [i for i, t in enumerate(short) if t not in frequent]
    hit = {i for i, _ in pairs}
    return sum(i in hit for i in rare) >= NAMES_SHARE * len(rare)


def _shingle_set(a: str, width: int) -> set[tuple[str, ...]]:
    out = set()
    for s in a.split(" | "):
        t = s.split(" ")
        out.update(tuple(t[i : i + width]) for i in range(max(1, len(t) - width + 1)))
    return out


def _abstracts_agree(aa: str, ab: str, frequent: frozenset[str]) -> bool:
    """Jaccard similarity of five-word shingles of 0.8; or, with edits or cuts, enough of the shorter's three-word shingles and rare words."""
    p, q = _shingle_set(aa, SHINGLE), _shingle_set(ab, SHINGLE)
    common = len(p & q)
    if common >= 0.8 * (len(p) + len(q) - common):
        return True
    p, q = _shingle_set(aa, 3), _shingle_set(ab, 3)
    if len(p & q) < CONTAINED * min(len(p), len(q)):
        return False
    x, y = ({w for w in a.split(" ") if w not in frequent and w != "|"} for a in (aa, ab))
    if x and y and len(x & y) < RARE_SHARE * min(len(x), len(y)):
        return False
    # Abstracts on one pattern differ in their figures.
    x, y = ({w for w in a.split(" ") if len(w) > 1 and w.isdigit()} for a in (aa, ab))
    return min(len(x), len(y)) < 2 or len(x & y) >= FIGURES_SHARE * min(len(x), len(y))


def confirmed(pairs: DataFrame, classes: DataFrame, frequent: frozenset[str]) -> DataFrame:
    """The candidate pairs that hold."""
    words = pairs.sparkSession.sparkContext.broadcast(frequent)
    left = classes.select(F.col("node").alias("a"), F.col("title").alias("ta"), F.col("abstract").alias("aa"))
    right = classes.select(F.col("node").alias("b"), F.col("title").alias("tb"), F.col("abstract").alias("ab"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [same_paper(*r, words.value) for r in zip(*(b.column(c).to_pylist() for c in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "aa", "tb", "ab").mapInArrow(run, "a string, b string")


def same_records(queries: DataFrame) -> DataFrame:
    """(query_id, split, source, paper): every record with the paper it describes (an arbitrary but stable name).

    ``queries`` has query_id, split, source, title, abstract and doi. Repeated rows of an id count once; rows without an
    id are ignored. Records without title, abstract and DOI, or with a generic heading alone, are papers of
    their own. Other columns are ignored, whatever their names; an empty table gives an empty table.
    """
    ship(queries.sparkSession)
    records = materialize(with_class(records_of(queries)), "records")
    classes = materialize(records.filter("node like 'c%'").groupBy("node").agg(F.first("title").alias("title"), F.first("abstract").alias("abstract")), "classes")
    frequent = frequent_words(classes)
    buckets = materialize(bands(classes, frequent), "bands")
    tried = star_pairs(buckets)
    stars = materialize(confirmed(tried, classes, frequent), "stars")
    rest = candidates(labelled(buckets, stars)).join(tried, ["a", "b"], "left_anti")
    texts = stars.unionByName(confirmed(rest, classes, frequent))
    by_doi = query_dois(queries).join(records.select("query_id", "node"), "query_id").select(F.col("node").alias("a"), F.concat(F.lit("d"), "doi").alias("b"))
    groups = connected_components(texts.unionByName(by_doi))
    return records.join(groups, "node", "left").select("query_id", "split", "source", F.coalesce("component", "node").alias("paper"))


def _sides(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    papers = same_records(queries).withColumn("split", F.lower(F.trim("split")))
    train = papers.filter("split = 'train'").select("paper", F.col("query_id").alias("t"), F.col("source").alias("train_source"))
    return train, papers.filter("split in ('validation', 'test')").select("paper", F.col("query_id").alias("h"), "split", "source")


def overlaps(queries: DataFrame) -> DataFrame:
    """(query_id_a, query_id_b, split, train_source, source): train records and held-out ones of the same paper.

    query_id_a < query_id_b; split and source are those of the held-out record. See :func:`same_records`.
    """
    train, held = _sides(queries)
    return train.join(held, "paper").select(F.least("t", "h").alias("query_id_a"), F.greatest("t", "h").alias("query_id_b"), "split", "train_source", "source")


def overlap_counts(queries: DataFrame) -> DataFrame:
    """(split, source, train_source, pairs, held_out): pairs, and different held-out records, of each split and pair of sources.

    Records are counted per paper first and the counts multiplied, so that a paper with many records gives no pairs.
    """
    train, held = _sides(queries)
    t = train.groupBy("paper", "train_source").agg(F.count("*").alias("nt"))
    h = held.groupBy("paper", "split", "source").agg(F.count("*").alias("nh"))
    return t.join(h, "paper").groupBy("split", "source", "train_source").agg(F.sum(F.col("nt") * F.col("nh")).alias("pairs"), F.sum("nh").alias("held_out"))
