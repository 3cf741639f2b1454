"""Packing texts of varying length into containers of fixed capacity (problem 7).

Method: length-histogram planning. The plan is made over the counts of each length, not
over documents: best-fit decreasing on classes of equal containers, so its size depends
on the capacity alone (at most a few patterns per distinct length) and never on the
number of documents. Documents then take the planned slots by joining on their rank
within their length.

A text longer than the capacity is split: full pieces fill containers of their own, and the
remainder joins the histogram as an item. No other text is split. A text without tokens
needs no room: it has one row with no container.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm.encode import count_tokens
from rankloom.runtime import materialize, partitions

SLOTS = "window_name string, capacity_tokens bigint, n_tokens bigint, first_slot bigint, slots bigint, per_container bigint, first_container bigint, offset_tokens bigint"


def plan_containers(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing over counts.

    ``histogram``: number of items of each length, every length within 1..capacity.
    Returns patterns (number of containers, [(length, items of it in each container)]).
    The result equals item-by-item best fit, since equal containers are interchangeable:
    the tightest class that still takes a length is filled up, container by container.
    """
    if any(not 1 <= n <= capacity for n in histogram):
        raise ValueError("lengths must lie within 1..capacity")
    rooms: list[int] = []  # residual sizes that some open container has, ascending
    open_: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)
    closed: list[tuple[int, tuple[tuple[int, int], ...]]] = []

    def put(room: int, count: int, pattern: tuple[tuple[int, int], ...]) -> None:
        if not count:
            return
        if room == 0:
            closed.append((count, pattern))
            return
        if room not in open_:
            bisect.insort(rooms, room)
        open_[room].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                break
            room = rooms[at]
            count, pattern = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = room // length
            full = min(count, left // each)
            rest = left - full * each if full < count else 0
            put(room - each * length, full, (*pattern, (length, each)))
            if rest and full < count:
                put(room - rest * length, 1, (*pattern, (length, rest)))
                put(room, count - full - 1, pattern)
                left = 0
            else:
                put(room, count - full, pattern)
                left -= full * each
        if left:
            each = capacity // length
            put(capacity - each * length, left // each, ((length, each),))
            if left % each:
                put(capacity - (left % each) * length, 1, ((length, left % each),))
    return [(count, list(p)) for count, p in closed] + [(c, list(p)) for held in open_.values() for c, p in held]


def slot_rows(window_name: str, histogram: dict[int, int], capacity: int, first_container: int) -> list[tuple]:
    """The slots of each length in order of rank, as rows of ``SLOTS``."""
    taken: dict[int, int] = defaultdict(int)
    rows = []
    container = first_container
    for count, pattern in plan_containers(histogram, capacity):
        offset = 0
        for length, each in pattern:
            rows.append((window_name, capacity, length, taken[length], count * each, each, container, offset))
            taken[length] += count * each
            offset += length * each
        container += count
    return rows


def pack(sizes: DataFrame, windows: DataFrame) -> DataFrame:
    """Place items in containers.

    ``sizes`` has doc_id and n_tokens; ``windows`` has window_name and capacity_tokens (a few
    rows, a configuration). Result: one row per window and piece, with window_name,
    capacity_tokens, doc_id, piece, token_start, piece_tokens, container_id and container_offset
    (the place of the piece within its container, in tokens).

    Repeated doc_ids are items of their own and numbered apart only by their place;
    null or negative sizes count as 0. Sizes of 0 have one row with null container_id.
    A window with null or non-positive capacity is an error. Ties among items of one length
    are settled by doc_id.
    """
    spark = sizes.sparkSession
    config = [(r[0], int(r[1])) for r in windows.select("window_name", "capacity_tokens").distinct().orderBy("window_name", "capacity_tokens").collect() if r[0] is not None and r[1] is not None and r[1] > 0]
    if windows.filter("window_name is null or capacity_tokens is null or capacity_tokens <= 0").limit(1).count():
        raise ValueError("every window needs a name and a positive capacity")
    sizes = sizes.select("doc_id", F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_tokens"))
    window = ["window_name", "capacity_tokens"]
    capacity = spark.createDataFrame(config, "window_name string, capacity_tokens bigint")
    items = sizes.crossJoin(F.broadcast(capacity))  # a few windows: every item goes into every window
    items = items.withColumn("full", F.expr("n_tokens div capacity_tokens")).withColumn("rest", F.col("n_tokens") % F.col("capacity_tokens"))
    # Two-step ranks: within (length, salt), then shifted by the salts before; no task holds a whole length. Salts grow with the session's partitions.
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(4 * partitions(spark))))
    by_salt = items.filter("rest > 0").groupBy(*window, "rest", "salt").count()
    before = Window.partitionBy(*window, "rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = by_salt.withColumn("shift", F.coalesce(F.sum("count").over(before), F.lit(0))).select(*window, "rest", "salt", "shift")
    # At most one row per window and length below its capacity: a bounded histogram.
    histogram: dict[tuple[str, int], dict[int, int]] = {w: {} for w in config}
    for name, cap, rest, n in by_salt.groupBy(*window, "rest").agg(F.sum("count")).collect():
        histogram[name, int(cap)][int(rest)] = int(n)
    rows = [r for name, cap in config for r in slot_rows(name, histogram[name, cap], cap, 0)]
    used = {w: max((r[6] + -(-r[4] // r[5]) for r in rows if r[:2] == w), default=0) for w in config}
    slots = spark.createDataFrame(pd.DataFrame(rows, columns=[f.split()[0] for f in SLOTS.split(", ")]), SLOTS) if rows else spark.createDataFrame([], SLOTS)
    slot = F.struct("first_slot", "slots", "per_container", "first_container", "offset_tokens")
    lists = slots.groupBy(*window, F.col("n_tokens").alias("rest")).agg(F.sort_array(F.collect_list(slot)).alias("slots"), F.sort_array(F.collect_list("first_slot")).alias("firsts"))

    ranked = items.filter("rest > 0").withColumn("r", F.row_number().over(Window.partitionBy(*window, "rest", "salt").orderBy("doc_id")) - 1)
    ranked = ranked.join(shift, [*window, "rest", "salt"]).withColumn("r", F.col("r") + F.col("shift"))
    # The slot of a rank: the last one that begins at or before it.
    placed = ranked.join(F.broadcast(lists), [*window, "rest"]).withColumn("s", F.expr("slots[cast(size(filter(firsts, x -> x <= r)) - 1 as int)]"))
    rests = placed.select(
        *window, "doc_id", F.col("full").alias("piece"), (F.col("full") * F.col("capacity_tokens")).alias("token_start"), F.col("rest").alias("piece_tokens"),
        F.expr("s.first_container + (r - s.first_slot) div s.per_container").alias("container_id"),
        F.expr("s.offset_tokens + ((r - s.first_slot) % s.per_container) * rest").alias("container_offset"),
    )
    # Full pieces have containers of their own, numbered after the planned ones.
    own_first = spark.createDataFrame([(n, c, used[n, c]) for n, c in config], "window_name string, capacity_tokens bigint, own_first bigint")
    long = items.filter("full > 0")
    per_salt = long.groupBy(*window, "salt").agg(F.sum("full").alias("n"))
    own_shift = per_salt.withColumn("shift", F.coalesce(F.sum("n").over(Window.partitionBy(*window).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(*window, "salt", "shift")
    running = Window.partitionBy(*window, "salt").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("own", F.coalesce(F.sum("full").over(running), F.lit(0))).join(F.broadcast(own_shift.join(own_first, window)), [*window, "salt"])
    fulls = long.withColumn("piece", F.explode(F.expr("sequence(0L, full - 1)"))).select(
        *window, "doc_id", "piece", (F.col("piece") * F.col("capacity_tokens")).alias("token_start"), F.col("capacity_tokens").alias("piece_tokens"),
        (F.col("own_first") + F.col("shift") + F.col("own") + F.col("piece")).cast("bigint").alias("container_id"), F.lit(0).cast("bigint").alias("container_offset"),
    )
    empty = items.filter("n_tokens = 0").select(
        *window, "doc_id", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("token_start"), F.lit(0).cast("bigint").alias("piece_tokens"),
        F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("bigint").alias("container_offset"),
    )
    return rests.unionByName(fulls).unionByName(empty)


def pack_documents(docs: DataFrame, windows: DataFrame, *, folder: str | None = None) -> DataFrame:
    """Pack ``docs`` (doc_id, text), measured in tokens of byte_bpe_50k, into every window."""
    sizes = materialize(count_tokens(docs, folder=folder), "token-counts")
    return pack(sizes, windows)


def utilization(packed: DataFrame) -> DataFrame:
    """Per window: containers, tokens placed, and the share of their room that is used."""
    return packed.filter("container_id is not null").groupBy("window_name", "capacity_tokens").agg(
        F.countDistinct("container_id").alias("containers"), F.sum("piece_tokens").alias("tokens"),
    ).withColumn("used", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def violations(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(window_name, rule, n): how often a packing breaks its rules; every rule is listed, 0 where it holds.

    ``unplaced``: documents whose pieces do not add up to their size; ``overfull``: containers with more tokens than their capacity; ``overlap``: pieces
    that begin before the piece ahead of them in their container ends; ``split``: documents in several pieces that would fit one container.
    """
    window = ["window_name", "capacity_tokens"]
    placed = packed.filter("container_id is not null")
    per_doc = packed.groupBy(*window, "doc_id").agg(F.sum("piece_tokens").alias("got"), F.count("*").alias("pieces")).join(sizes.select("doc_id", "n_tokens"), "doc_id")
    per_box = placed.groupBy(*window, "container_id").agg(F.sum("piece_tokens").alias("got"))
    ahead = Window.partitionBy(*window, "container_id").orderBy("container_offset")
    after = placed.withColumn("end", F.lag(F.col("container_offset") + F.col("piece_tokens")).over(ahead))
    parts = {
        "unplaced": per_doc.filter("got <> coalesce(n_tokens, 0)"), "split": per_doc.filter("pieces > 1 and n_tokens <= capacity_tokens"),
        "overfull": per_box.filter("got > capacity_tokens"), "overlap": after.filter("container_offset < end"),
    }
    names = packed.select("window_name").distinct()
    out = None
    for rule, bad in parts.items():
        one = names.join(bad.groupBy("window_name").agg(F.count("*").alias("n")), "window_name", "left").select("window_name", F.lit(rule).alias("rule"), F.coalesce("n", F.lit(0)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
