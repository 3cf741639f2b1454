"""Subjects of documents (problem 8).

Method: one-versus-rest linear classifiers on hashed word n-grams (words and neighbouring pairs), trained by logistic loss. The tables
have no address paths; the section metadata of a document is the field of the venue it belongs to (scope_entities.broad_field by
documents.entity_id), which is only often right, and annotations of a sample, which hold errors, add to it. These weak labels are of
documents, the classifiers judge sentences: log ratios of how often a feature stands under a label bring the labels down
to those sentences that speak clearly for one of the labels of their document, in a few rounds; the classifiers are trained on
these sentences, each subject against all others and against sentences that speak for none (notices).

A sentence speaks for the subject whose classifier gives the highest value, or, below a level, for none; a document has the subjects
whose share of its speaking sentences reaches the threshold of the subject. Level and thresholds are calibrated on annotated documents
that are left out of the fit.

The fit uses at most ``SAMPLE`` documents, annotated ones first, the others in order of a hash of their id; every document is classified, whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import text as tx
from rankloom.runtime import ship

SAMPLE = 12_000
BUCKETS = 1 << 18  # 2 ** BITS
LEAST_COUNT = 3
WEAK_WEIGHT = 0.25
SHRINK = 2.0
TELLING = 2.5
CERTAIN = 0.7
OWN = 0.4
ANCHORED = 12
ANCHOR = 1.4
ROUNDS = 3
LONGEST = 30
HELD_OUT = 4  # one annotated document of so many is kept for calibration
STEPS = 25
RATE = 0.3
RIDGE = 2e-6
SILENT = 0.5
LEAST_GOLD = 15
SPANS_AT_ONCE = 10_000
BITS = 18

_SEGMENT = re.compile(r"[\r\n|•]+|(?<=[.!?])\s+|(?<=[。！？])|(?<=[.!?][\"”»)])\s+")


def segments(s: str | None) -> list[list[str]]:
    """Words of each sentence or line; figures do not count."""
    out = []
    for part in _SEGMENT.split(tx.fold(tx.clean(s))):
        w = [t for t in tx.words(part) if not t[0].isdigit()]
        if w:
            out.append(w)
    return out


def spans(parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and neighbouring pairs of all parts in a row, each once per part, and where each part begins."""
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    h = tx.hashes([t for p in parts for t in p])
    part = np.repeat(np.arange(len(parts)), sizes)
    pairs = np.flatnonzero(part[:-1] == part[1:])
    both = np.concatenate((h, tx.mix(h[pairs]) + h[pairs + 1]))
    code = np.unique(np.concatenate((part, part[pairs])) << BITS | (tx.mix(both) >> np.uint64(64 - BITS)).astype(np.int64))
    return code & (BUCKETS - 1), np.searchsorted(code, np.arange(len(parts)) << BITS)


class Linear:
    """One weight vector and bias per subject; a part speaks for the subject of the highest value, if that reaches ``level``."""

    def __init__(self, subjects: list[str], weights: np.ndarray, bias: np.ndarray | None = None, level: float = 2.0):
        self.subjects, self.weights, self.level = subjects, np.ascontiguousarray(weights, dtype=np.float32), level
        self.bias = np.zeros(len(subjects)) if bias is None else bias
        self.thresholds = np.full(len(subjects), 1 / 3)

    def sums(self, index: np.ndarray, start: np.ndarray, at_once: int = 20_000) -> np.ndarray:
        """Value of each span of features (row) for each subject (column)."""
        out = np.zeros((len(start), len(self.subjects)))
        ends = np.append(start, len(index))
        for lo in range(0, len(start), at_once):
            hi = min(len(start), lo + at_once)
            out[lo:hi] = np.add.reduceat(self.weights[index[ends[lo] : ends[hi]]], start[lo:hi] - ends[lo], axis=0)
        return out + self.bias

    def shares(self, z: np.ndarray, owner: np.ndarray, documents: int) -> np.ndarray:
        """Share of the speaking parts (rows of values) of each document that each subject has; all 0 if none speaks."""
        k = len(self.subjects)
        if not len(z):
            return np.zeros((documents, k))
        best, speaks = z.argmax(1), z.max(1) >= self.level
        count = np.bincount(owner[speaks] * k + best[speaks], minlength=documents * k).reshape(documents, k).astype(float)
        return count / np.maximum(1.0, count.sum(1, keepdims=True))


def weigh(index: np.ndarray, row: np.ndarray, q: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Weights: log of how much likelier a subject is where a feature stands than at large, shrunk where it is rare.

    ``q`` holds the subjects of each span. Features in fewer than ``LEAST_COUNT`` documents, or without a subject that is
    ``TELLING`` times as likely as at large (or ``CERTAIN``) and has a share of ``OWN``, have no weight.
    """
    prior = (q.sum(0) + 1.0) / (q.sum() + q.shape[1])
    per = [np.bincount(index, weights=q[row, s], minlength=BUCKETS) for s in range(q.shape[1])]
    total = sum(per)
    out = np.zeros((BUCKETS, q.shape[1]), dtype=np.float32)
    known = np.flatnonzero((seen >= LEAST_COUNT) & (total > 0))
    chance = np.stack([(p[known] + SHRINK * prior[s]) / (total[known] + SHRINK) for s, p in enumerate(per)])
    # Set phrases stand with every subject: only a feature that has a subject of its own counts.
    telling = (chance >= np.minimum(TELLING * prior, CERTAIN)[:, None]).any(0)
    telling &= chance.max(0) >= OWN
    for s in range(q.shape[1]):
        out[known[telling], s] = np.log(chance[s][telling] / prior[s])
    return np.clip(out, -2.0, 3.0)


def logistic(index: np.ndarray, start: np.ndarray, q: np.ndarray, weight: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of one-versus-rest classifiers by logistic loss: full-batch steps with per-weight rates from a first guess.

    ``q`` holds the target of each span for each subject, ``weight`` what the span counts for. Features without a first guess stay at 0.
    """
    known = np.flatnonzero((first != 0).any(1))
    place = np.full(BUCKETS, -1)
    place[known] = np.arange(len(known))
    k = q.shape[1]
    w = first[known].astype(np.float64)
    bias = np.full(k, -2.0)
    seen_w, seen_b = np.full_like(w, 1e-8), np.full(k, 1e-8)
    total = max(weight.sum(), 1e-9)
    # Only spans that count are read, ``SPANS_AT_ONCE`` at a time, which bounds the memory of a step.
    ends = np.append(start, len(index))
    chunks = []
    counted = np.flatnonzero(weight > 0)
    for lo in range(0, len(counted), SPANS_AT_ONCE):
        spans_ = counted[lo : lo + SPANS_AT_ONCE]
        sizes = ends[spans_ + 1] - start[spans_]
        row = np.repeat(np.arange(len(spans_), dtype=np.int32), sizes)
        col = place[index[np.repeat(start[spans_] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]].astype(np.int32)
        row, col = row[col >= 0], col[col >= 0]
        chunks.append((spans_, row, col, np.flatnonzero(np.diff(row, prepend=-1))))
    for _ in range(STEPS):
        narrow = w.astype(np.float32)
        grad, g = RIDGE * w, np.zeros(k)
        for spans_, row, col, cuts in chunks:
            z = np.zeros((len(spans_), k))
            if len(row):
                z[row[cuts]] = np.add.reduceat(narrow[col], cuts, axis=0)
            error = (1.0 / (1.0 + np.exp(-np.clip(z + bias, -30, 30))) - q[spans_]) * weight[spans_, None] / total
            for s in range(k):
                grad[:, s] += np.bincount(col, weights=error[row, s], minlength=len(known))
            g += error.sum(0)
        seen_w += grad * grad
        w -= RATE * grad / np.sqrt(seen_w)
        seen_b += g * g
        bias -= RATE * g / np.sqrt(seen_b)
    out = np.zeros((BUCKETS, k), dtype=np.float32)
    out[known] = w
    return out, bias


def train(subjects: list[str], texts: list[str], annotated: list[set[str]], field: list[str | None], keys: list | None = None) -> Linear:
    """Classifiers from texts with annotations (a set, empty where there is none) and fields of their venues.

    Of the annotated texts, one of ``HELD_OUT`` (by a hash of its key, or of the text) takes part in the calibration alone.
    """
    at = {s: i for i, s in enumerate(subjects)}
    k = len(subjects)
    parts = [segments(t) for t in texts]
    docs = [i for i, p in enumerate(parts) if p]
    flat = [p for i in docs for p in parts[i]]
    if not flat or not k:
        return Linear(subjects, np.zeros((BUCKETS, k), dtype=np.float32))
    held = np.array([bool(annotated[i]) and tx.token_hash(str(keys[i] if keys else texts[i])) % HELD_OUT == 0 for i in docs])
    index, start = spans(flat)
    row = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(index))))
    owner = np.repeat(np.arange(len(docs)), [len(parts[i]) for i in docs])
    del parts, flat
    pairs = np.unique(owner[row].astype(np.int64) * BUCKETS + index)
    seen = np.bincount(pairs % BUCKETS, minlength=BUCKETS)
    del pairs
    y = np.zeros((len(docs), k))
    weight = np.zeros(len(docs))
    for r, i in enumerate(docs):
        own = [at[s] for s in (annotated[i] or {field[i]}) if s in at]
        if own and not held[r]:
            y[r, own] = 1.0 / len(own)
            weight[r] = 1.0 if annotated[i] else WEAK_WEIGHT
    allowed = np.where((weight == 1.0)[:, None], y > 0, True)
    # A very long text weighs no more than ``LONGEST`` sentences do.
    share = np.minimum(1.0, LONGEST / np.bincount(owner, minlength=len(docs)))[owner] * ~held[owner]
    first = (y * weight[:, None])[owner] * share[:, None]
    at_large = (first.sum(0) + 1.0) / (first.sum() + k)
    claims = np.stack([np.bincount(index, weights=first[row, s], minlength=BUCKETS) for s in range(k)]).astype(np.float32)
    # Where a feature is well known, later rounds may not give it to a subject that the labels do not.
    denied = ((seen >= ANCHORED) & (claims < ANCHOR * at_large[:, None] * claims.sum(0))).T
    model = Linear(subjects, weigh(index, row, first, seen))
    for _ in range(ROUNDS):
        z = np.where(allowed[owner], model.sums(index, start), -30.0)
        top = z.max(1)
        second = np.partition(z, -2, axis=1)[:, -2] if k > 1 else np.full(len(z), -30.0)
        q = np.zeros_like(z)
        sure = np.flatnonzero((top >= model.level) & (top - second >= 1.0))
        q[sure, z[sure].argmax(1)] = share[sure]
        weights = weigh(index, row, q, seen)
        weights[denied & (weights > 0)] = 0.0
        model = Linear(subjects, weights, level=model.level)
    z = model.sums(index, start)
    target = np.zeros_like(z)
    target[sure, np.where(allowed[owner], z, -30.0)[sure].argmax(1)] = 1.0
    silent = z.max(1) < model.level / 2
    counts = np.zeros(len(z))
    counts[sure] = share[sure]
    counts[silent] = SILENT * share[silent]
    model = Linear(subjects, *logistic(index, start, target, counts, model.weights * 0.5), level=0.0)
    judged = np.flatnonzero(held)
    if not len(judged):
        judged = np.array([r for r, i in enumerate(docs) if annotated[i]], dtype=np.int64)
    calibrate(model, model.sums(index, start), owner, {int(r): {at[s] for s in annotated[docs[r]] if s in at} for r in judged}, len(docs))
    return model


def calibrate(model: Linear, z: np.ndarray, owner: np.ndarray, gold: dict[int, set[int]], documents: int) -> None:
    """Sets the level from which on a sentence speaks, and for each subject the share from which on it counts, by F1 on ``gold``.

    A subject with fewer than ``LEAST_GOLD`` documents in ``gold`` has the threshold that is best for all.
    """
    if not gold:
        return
    rows = np.array(sorted(gold))
    truth = np.zeros((len(rows), len(model.subjects)), dtype=bool)
    for n, r in enumerate(rows.tolist()):
        truth[n, list(gold[r])] = True
    grid = (0.2, 0.23, 0.26, 0.3, 0.33, 0.36, 0.4)
    f1 = lambda got, true: 2 * (got & true).sum() / max(1, got.sum() + true.sum())
    best = -1.0
    for level in (-2.0, -1.5, -1.0, -0.5, 0.0, 0.5, 1.0):
        model.level = level
        shares = model.shares(z, owner, documents)[rows]
        for t in grid:
            value = f1(shares >= t, truth)
            if value > best + 1e-9:
                best, chosen, kept = value, (level, t), shares
    model.level = chosen[0]
    model.thresholds[:] = chosen[1]
    for s in np.flatnonzero(truth.sum(0) >= LEAST_GOLD):
        own = [(f1(kept[:, s] >= t, truth[:, s]), -abs(t - chosen[1]), t) for t in grid]
        model.thresholds[s] = max(own)[2]


def fitted(docs: DataFrame, labels: DataFrame, subjects: DataFrame, entities: DataFrame) -> Linear:
    """The classifiers of these tables; the sample that reaches the driver is bounded by ``SAMPLE``."""
    names = [r[0] for r in subjects.select(F.lower(F.trim("subject")).alias("s")).filter("s is not null and s <> ''").distinct().orderBy("s").collect()]
    gold = labels.filter("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set(F.lower(F.trim("subject"))).alias("gold"))
    field = entities.filter("entity_id is not null").groupBy("entity_id").agg(F.max(F.lower(F.trim("broad_field"))).alias("field"))
    known = docs.filter("doc_id is not null and length(trim(text)) > 0").select("doc_id", "text", "entity_id")
    keys = known.select("doc_id", "entity_id").join(gold, "doc_id", "left").orderBy(F.col("gold").isNull(), F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = known.select("doc_id", "text").join(F.broadcast(keys), "doc_id").join(field, "entity_id", "left").select("doc_id", "text", "gold", "field").orderBy("doc_id", "text").toArrow()
    return train(names, rows["text"].to_pylist(), [set(g or ()) for g in rows["gold"].to_pylist()], rows["field"].to_pylist(), rows["doc_id"].to_pylist())


def subjects_of(docs: DataFrame, labels: DataFrame, subjects: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, subject, share): the subjects of every document.

    Null, empty and blank texts, and texts of notices alone, have no row. Repeated rows of a document give the same subjects
    once; rows without doc_id are ignored; null columns elsewhere only mean less to learn from. Other columns are
    ignored, whatever their names; an empty table of documents gives an empty result, and so does one of subjects.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(fitted(docs, labels, subjects, entities))
    src = docs.filter("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array(m.subjects, dtype=object)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                b = whole.slice(first, 500)
                parts = [segments(s) for s in b.column(1).to_pylist()]
                flat = [p for ps in parts for p in ps]
                if not flat or not m.subjects:
                    continue
                owner = np.repeat(np.arange(len(parts)), [len(ps) for ps in parts])
                share = m.shares(m.sums(*spans(flat)), owner, len(parts))
                row, subject = np.nonzero(share >= m.thresholds)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(names[subject], pa.string()), pa.array(share[row, subject])], names=["doc_id", "subject", "share"])

    return src.mapInArrow(run, f"doc_id {kind}, subject string, share double").groupBy("doc_id", "subject").agg(F.max("share").alias("share"))


def composition(found: DataFrame) -> DataFrame:
    """(subject, documents, weight): how much of a corpus each subject makes up; a document of several subjects is divided by share."""
    total = found.groupBy("doc_id").agg(F.sum("share").alias("t"))
    return found.join(total, "doc_id").groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.sum(F.col("share") / F.col("t")), 4).alias("weight"))
