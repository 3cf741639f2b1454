"""The best N items of every group (problem 5).

Method: secondary sort. Rows are hash-partitioned by group and sorted within partitions by
group, score and identifier; Arrow batches stream through a Python pass that emits
the first N different items of each group and holds no more than N identifiers at a time.
Before the shuffle the same pass runs over each input partition, sorted in place, so a
group of any size sends at most N rows from each input partition: a hot group needs no salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.runtime import ship

# Fixed value: what counts as blank around an identifier.
BLANKS = " \t\r\n\x0b\x0c 　"


def _changed(column: pa.Array) -> np.ndarray:
    """True where a row differs from the row before it; nulls equal nulls."""
    if len(column) < 2:
        return np.zeros(0, dtype=bool)
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differs = pc.fill_null(pc.not_equal(a, b), False)
    if column.null_count:
        differs = pc.or_(differs, pc.xor(pc.is_null(a), pc.is_null(b)))
    return differs.to_numpy(zero_copy_only=False)


def _first_n(batches: Iterator[pa.RecordBatch], groups: int, n: int) -> Iterator[pa.RecordBatch]:
    """Pass through the first ``n`` different items of each group of sorted batches.

    Columns are the group keys, the item, then anything else. ``held`` are the items already emitted of the
    group that was last seen, at most ``n`` of them.
    """
    key: tuple | None = None
    held: set = set()
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        fresh = np.zeros(rows, dtype=bool)
        for c in range(groups):
            fresh[1:] |= _changed(batch.column(c))
        first = tuple(batch.column(c)[0].as_py() for c in range(groups))
        fresh[0] = first != key
        starts = [0, *(np.flatnonzero(fresh[1:]) + 1).tolist()]
        spans = zip(starts, [*starts[1:], rows], strict=True)
        same = np.concatenate(([False], ~_changed(batch.column(groups)))) & ~fresh
        keep = np.zeros(rows, dtype=bool)
        item = batch.column(groups)
        for i, (start, stop) in enumerate(spans):
            if i or fresh[0]:
                held = set()
            at = start
            while at < stop and len(held) < n:
                # A step of rows at a time: only as many as may still be needed are looked at.
                chunk = item.slice(at, min(stop - at, 4 * n)).to_pylist()
                for j, x in enumerate(chunk):
                    if same[at + j] or x in held:
                        continue
                    held.add(x)
                    keep[at + j] = True
                    if len(held) == n:
                        break
                at += len(chunk)
        key = tuple(batch.column(c)[rows - 1].as_py() for c in range(groups))
        if keep.any():
            yield batch.filter(pa.array(keep))


def top_n(rows: DataFrame, *, groups: list[str], item: str, score: str, n: int) -> DataFrame:
    """The ``n`` best items of each group: columns ``groups``, ``item``, ``score``.

    Order: score descending, then item ascending in byte order. Rows whose score is null or
    not finite, or whose item is null or blank, are dropped; an item is taken without
    surrounding blanks and counts once per group, with its highest score; -0.0 equals 0.0. A null group key is a group like any
    other. Groups with fewer items give them all, groups with none give no row. Other columns
    are ignored, whatever their names.
    """
    if n < 1:
        raise ValueError("n must be positive")
    ship(rows.sparkSession)
    cleaned: Column = F.expr(f"trim(BOTH {_sql_text(BLANKS)} FROM cast(`{item}` as string))")
    value = F.col(score).cast("double")
    picked = rows.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)], cleaned.alias("item"), (value + F.lit(0.0)).alias("score"))
    picked = picked.filter("item is not null and item <> '' and score is not null and not isnan(score) and abs(score) < double('Infinity')")
    keys = [f"g{i}" for i in range(len(groups))]
    order = [*[F.col(k) for k in keys], F.col("score").desc(), F.col("item")]
    schema = picked.schema
    count = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _first_n(batches, count, n)

    local = picked.sortWithinPartitions(*order).mapInArrow(run, schema)
    best = local.repartition(*keys).sortWithinPartitions(*order).mapInArrow(run, schema)
    return best.select(*[F.col(k).alias(g) for k, g in zip(keys, groups, strict=True)], F.col("item").alias(item), F.col("score").alias(score))


def _sql_text(s: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" for c in s) + "'"
