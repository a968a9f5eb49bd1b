"""Filling containers of fixed capacity with texts.

1. The global histogram of lengths (at most one row for each length up to the capacity) goes to the driver.
2. Dynamic programming over it chooses the length buckets: a text counts as its bucket's upper bound, and the boundaries make the sum of this
   padding, and of a price for each bucket that is a small share of all tokens, as small as possible.
3. Batches form inside each bucket, as many texts as the token budget holds; buckets are taken from the longest down, and room that the
   batches of longer buckets leave is given to the shorter ones first. This is planned for whole runs of equal containers at once, so the plan is
   small however many texts there are.
4. Texts are numbered within their bucket, and the number tells the container.

A text over the capacity is cut into parts of the capacity, and only its last part shares a container.
"""

from __future__ import annotations

from bisect import insort
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsearch.operators.ordinals import running
from foldsearch.runtime import ship_package, small_table

#: Price of a bucket as a share of all tokens: without it every length would be a bucket, and with a fixed price nearly every one of much data.
BUCKET_SHARE = 1e-6
#: Texts of one bucket numbered in one task.
CHUNK_ROWS = 100_000

PACKED = "pack_id int, container_no bigint, doc_id bigint, part_no int, first_token bigint, n_tokens bigint"


def length_buckets(lengths: np.ndarray, counts: np.ndarray, bucket_cost: float) -> np.ndarray:
    """Upper bounds (ascending, among ``lengths``) with the least padding plus ``bucket_cost`` for each bucket.

    Best cost of the lengths up to j = least over i of best(i) + padding of the lengths in (i, j] to lengths[j] + bucket_cost. For each i this is a line
    over lengths[j], falling by the number of texts up to i: the lower hull of the lines is kept, in whole numbers, so that nothing is rounded.
    """
    m = len(lengths)
    if m == 0:
        return np.zeros(0, np.int64)
    price, unit = float(bucket_cost).as_integer_ratio()
    hull: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # texts up to i, best(i) + tokens up to i in units, i
    n = tokens = 0
    cut = [0] * (m + 1)
    for j, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist()), 1):
        n, tokens = n + int(count), tokens + int(count) * length
        x = length * unit
        while len(hull) > 1 and hull[1][1] - x * hull[1][0] < hull[0][1] - x * hull[0][0]:
            hull.popleft()
        cut[j] = hull[0][2]
        line = n, hull[0][1] + x * (n - hull[0][0]) + price, j
        while len(hull) > 1 and (line[1] - hull[-2][1]) * (hull[-1][0] - hull[-2][0]) <= (hull[-1][1] - hull[-2][1]) * (line[0] - hull[-2][0]):
            hull.pop()
        hull.append(line)
    bounds, j = [], m
    while j:
        bounds.append(int(lengths[j - 1]))
        j = cut[j]
    return np.array(bounds[::-1], np.int64)


@dataclass(frozen=True)
class Plan:
    """``bounds`` of the buckets, and for each run of numbers in a bucket: where it starts, its first container, texts in a container."""

    bounds: np.ndarray
    base: np.ndarray
    start: np.ndarray
    first: np.ndarray
    per: np.ndarray
    containers: int


def plan_containers(lengths: np.ndarray, counts: np.ndarray, capacity: int, bucket_cost: float | None = None) -> Plan:
    """Plan for ``counts`` texts of each of ``lengths`` (1..capacity, ascending). A bucket costs BUCKET_SHARE of all tokens, if not given."""
    if bucket_cost is None:
        bucket_cost = BUCKET_SHARE * float((lengths.astype(float) * counts).sum())
    bounds = length_buckets(lengths, counts, bucket_cost)
    of = np.searchsorted(bounds, lengths)
    sizes = np.bincount(of, weights=counts, minlength=len(bounds)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    runs: list[tuple[int, int, int]] = []  # start, first container, per container
    rooms: list[tuple[int, int, int]] = []  # room, first container, number of containers; ascending by room
    made = 0
    for b in range(len(bounds) - 1, -1, -1):
        length, left, at = int(bounds[b]), int(sizes[b]), int(base[b])
        kept: list[tuple[int, int, int]] = []
        fits = [r for r in rooms if r[0] >= length]
        kept = [r for r in rooms if r[0] < length]
        for room, first, many in fits:  # least room first
            per = room // length
            whole = min(many, left // per)
            if whole:
                runs.append((at, first, per))
                at, left = at + whole * per, left - whole * per
                insort(kept, (room - per * length, first, whole))
            if whole < many and 0 < left < per:
                runs.append((at, first + whole, left))
                insort(kept, (room - left * length, first + whole, 1))
                at, left, whole = at + left, 0, whole + 1
            if whole < many:
                insort(kept, (room, first + whole, many - whole))
        per = capacity // length
        whole, rest = divmod(left, per)
        if whole:
            runs.append((at, made, per))
            insort(kept, (capacity - per * length, made, whole))
            at, made = at + whole * per, made + whole
        if rest:
            runs.append((at, made, rest))
            insort(kept, (capacity - rest * length, made, 1))
            made += 1
        rooms = [r for r in kept if r[0] > 0]
    runs.sort()
    s, f, p = (np.array(x, np.int64) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 3
    return Plan(bounds, base, s, f, p, made)


def parts(counts: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """(pack_id, doc_id, part_no, first_token, n_tokens, counted): every text cut at each capacity. ``counted`` is at least 1."""
    cap = F.col("capacity_tokens")
    kinds = F.array(*[F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("long").alias("capacity_tokens")) for p, c in sorted(capacities.items())])
    met = counts.select("doc_id", "n_tokens", F.inline(kinds))
    cut = met.withColumn("part_no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / cap).cast("int") - 1))))
    first = F.col("part_no") * cap
    n = F.least(cap, F.col("n_tokens") - first)
    return cut.select("pack_id", "doc_id", "part_no", first.alias("first_token"), n.alias("n_tokens"), F.greatest(F.lit(1), n).cast("long").alias("counted"))


def pack(counts: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """(pack_id, container_no, doc_id, part_no, first_token, n_tokens) for containers of each capacity.

    ``counts`` has doc_id (unique) and n_tokens. Every text appears for each pack_id; texts without tokens take part with no tokens (and count as one token when
    containers are planned). A capacity below 1 is refused; no capacities or no texts give no rows. The capacities are a parameter held by
    the driver, as is the histogram: at most one row for each length up to a capacity.
    """
    spark = counts.sparkSession
    if any(c is None or c < 1 for c in capacities.values()):
        raise ValueError("a container must hold at least one token")
    ship_package(spark)
    packs = sorted(capacities)
    if not packs:
        return spark.createDataFrame([], PACKED)
    pieces = parts(counts, capacities)
    seen = pieces.groupBy("pack_id", "counted").agg(F.count(F.lit(1)).alias("n")).toPandas()
    plans: dict[int, Plan] = {}
    most = 1
    for p in packs:
        own = seen[seen["pack_id"] == p].sort_values("counted")
        plans[p] = plan_containers(own["counted"].to_numpy(np.int64), own["n"].to_numpy(np.int64), capacities[p])
        most = max(most, int(own["n"].sum()))
    rows = [(p, int(a), b) for p in packs for a, b in zip(seen.loc[seen["pack_id"] == p, "counted"], np.searchsorted(plans[p].bounds, seen.loc[seen["pack_id"] == p, "counted"]))]
    of_length = small_table(
        spark, {"pack_id": pa.array([r[0] for r in rows], pa.int32()), "counted": pa.array([r[1] for r in rows], pa.int64()), "bucket": pa.array([int(r[2]) for r in rows], pa.int32())}
    )
    chunk = F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(-(-most // CHUNK_ROWS))).cast("int")
    put = pieces.join(F.broadcast(of_length), ["pack_id", "counted"]).drop("counted").withColumn("chunk", chunk)
    order = [F.col("n_tokens").desc(), F.col("doc_id"), F.col("part_no")]
    numbered = running(put, ["pack_id", "bucket"], ["chunk"], order, F.lit(1).cast("long"), "number")
    return numbered.select("pack_id", "bucket", "number", "doc_id", "part_no", "first_token", "n_tokens").mapInArrow(
        _placer(plans), PACKED
    )


def _placer(plans: dict[int, Plan]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pack_id, bucket, number = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            out = np.empty(len(pack_id), np.int64)
            for p in np.unique(pack_id):
                plan, mine = plans[int(p)], pack_id == p
                at = plan.base[bucket[mine]] + number[mine]
                run_of = np.searchsorted(plan.start, at, side="right") - 1
                out[mine] = plan.first[run_of] + (at - plan.start[run_of]) // plan.per[run_of]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out), *b.columns[3:]], names=["pack_id", "container_no", "doc_id", "part_no", "first_token", "n_tokens"])

    return run


def fill_report(packed: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """Containers, tokens and share of unused room for each kind of container."""
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in capacities.items() for x in kv]), F.col("pack_id"))
    got = packed.groupBy("pack_id", "container_no").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    return got.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"), F.sum("k").alias("n_parts"), F.max("t").alias("fullest"), (1 - F.sum("t") / F.sum(cap)).alias("unused_share")
    )


def check_report(packed: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """(pack_id, n_docs, n_over, n_gaps): documents packed, containers over the capacity, documents whose parts don't follow one another from the first token."""
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in capacities.items() for x in kv]), F.col("pack_id"))
    over = packed.groupBy("pack_id", "container_no").agg(F.sum("n_tokens").alias("t")).groupBy("pack_id").agg(F.sum(F.when(F.col("t") > cap, 1).otherwise(0)).alias("n_over"))
    own = packed.groupBy("pack_id", "doc_id").agg(F.sum("n_tokens").alias("t"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.count(F.lit(1)).alias("k"), F.max("part_no").alias("last"))
    gaps = own.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.when((F.col("t") != F.col("end")) | (F.col("k") != F.col("last") + 1), 1).otherwise(0)).alias("n_gaps"))
    return gaps.join(over, "pack_id").select("pack_id", "n_docs", "n_over", "n_gaps")
