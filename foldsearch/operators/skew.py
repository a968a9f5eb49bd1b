"""Per-key work without stragglers: fragment-replicate by estimated load.

Three steps, each over all rows:

1. *Estimate*: the load per key, combined map-side, so the estimate shuffles one row per key and map task.
2. *Place*: a key whose load exceeds an even task's share is split into proportionate shards; all other
   keys are gathered in hash buckets. Shards and buckets are packed onto tasks, heaviest first, always
   onto the least loaded task. What reaches the driver is bounded by the number of tasks, not of keys:
   at most ``tasks`` keys can exceed the share, and there are ``BUCKETS_PER_TASK * tasks`` buckets.
3. *Run*: rows go to exactly their planned task (``repartitionById``). A matching side is replicated, and only
   to the shards of its own key. Partial results of a split key are merged afterwards, one row per shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsearch.runtime import ensure_checkpoint_dir, shuffle_tasks, small_table

#: Hash buckets of small keys for each task; more buckets even out better.
BUCKETS_PER_TASK = 16

TASK, SHARD = "__fs_task", "__fs_shard"
_HASH, _SHARDS, _LOAD, _BUCKET = "__fs_hash", "__fs_shards", "__fs_load", "__fs_bucket"


@dataclass(frozen=True)
class Placement:
    """Where rows go. ``shards`` maps the hash of a large key to the tasks of its shards."""

    tasks: int
    bucket_task: tuple[int, ...]
    shards: dict[int, tuple[int, ...]]
    task_load: tuple[float, ...]

    @property
    def imbalance(self) -> float:
        """Largest planned task load over the mean."""
        total = sum(self.task_load)
        return max(self.task_load) * self.tasks / total if total else 1.0


def _key_hash(keys: Sequence[str]) -> Column:
    # nulls hash to the seed, so a leading marker tells null from absent columns
    parts: list[Column] = []
    for k in keys:
        parts += [F.col(k).isNull(), F.col(k)]
    return F.xxhash64(*parts)


def pack(loads: dict[object, float], tasks: int) -> tuple[dict[object, int], list[float]]:
    """Heaviest first onto the least loaded task. Ties go to the lower task number."""
    heap = [(0.0, t) for t in range(tasks)]
    where, total = {}, [0.0] * tasks
    for item, load in sorted(loads.items(), key=lambda x: (-x[1], str(x[0]))):
        have, t = heapq.heappop(heap)
        where[item] = t
        total[t] = have + load
        heapq.heappush(heap, (total[t], t))
    return where, total


def plan_placement(df: DataFrame, keys: Sequence[str], tasks: int | None = None, weight: Column | None = None) -> Placement:
    """Estimate the load per key and plan. ``weight`` is the cost of a row of ``df`` (1 by default)."""
    tasks = tasks or shuffle_tasks(df.sparkSession)
    buckets = BUCKETS_PER_TASK * tasks
    narrow = df.select(_key_hash(keys).alias(_HASH), (weight if weight is not None else F.lit(1)).cast("double").alias(_LOAD))
    loads = narrow.groupBy(_HASH).agg(F.sum(_LOAD).alias(_LOAD))
    # the total is taken from the same loads, in the same job, so that the rows are read once
    large = F.col(_LOAD) > F.greatest(loads.agg(F.sum(_LOAD)).scalar() / F.lit(tasks), F.lit(1.0))
    rows = (
        loads.groupBy(
            F.when(large, F.col(_HASH)).alias(_HASH),
            F.when(~large, F.pmod(F.col(_HASH), F.lit(buckets))).alias(_BUCKET),
        )
        .agg(F.sum(_LOAD).alias(_LOAD))
        .collect()  # at most tasks + buckets rows
    )
    share = max(sum(r[_LOAD] for r in rows) / tasks, 1.0)
    items: dict[object, float] = {}
    count: dict[int, int] = {}
    for r in rows:
        if r[_HASH] is None:
            items["bucket", int(r[_BUCKET])] = r[_LOAD]
        else:
            count[r[_HASH]] = n = min(tasks, int(-(-r[_LOAD] // share)))
            for s in range(n):
                items["shard", r[_HASH], s] = r[_LOAD] / n
    where, task_load = pack(items, tasks)
    return Placement(
        tasks,
        tuple(where.get(("bucket", b), b % tasks) for b in range(buckets)),
        {h: tuple(where["shard", h, s] for s in range(n)) for h, n in count.items()},
        tuple(task_load),
    )


def _with_plan(df: DataFrame, keys: Sequence[str], plan: Placement) -> DataFrame:
    spark = df.sparkSession
    hashed = df.withColumn(_HASH, _key_hash(keys))
    if plan.shards:  # at most `tasks` rows, so the broadcast is bounded by the cluster, not the data
        shards = small_table(
            spark,
            {_HASH: pa.array(list(plan.shards), pa.int64()), _SHARDS: pa.array([list(x) for x in plan.shards.values()], pa.list_(pa.int32()))},
        )
        return hashed.join(F.broadcast(shards), _HASH, "left")
    return hashed.withColumn(_SHARDS, F.lit(None).cast("array<int>"))


def _bucket_task(plan: Placement) -> Column:
    # one text literal with a few digits for each bucket, rather than an array of BUCKETS_PER_TASK * tasks numbers
    width = max(1, len(f"{plan.tasks - 1:x}"))
    lookup = F.lit("".join(f"{t:0{width}x}" for t in plan.bucket_task))
    at = (F.pmod(F.col(_HASH), F.lit(len(plan.bucket_task))) * width + 1).cast("int")
    return F.conv(F.substring(lookup, at, F.lit(width)), 16, 10).cast("int")


def place(df: DataFrame, keys: Sequence[str], plan: Placement, spread: Sequence[str]) -> DataFrame:
    """Rows on their planned tasks, with the task and shard columns added.

    ``spread`` are the columns whose hash chooses the shard of a split key: equal values stay together, so
    per-shard distinct counts over them add up. No single value of them should hold most rows of a key.
    """
    shard = F.when(F.col(_SHARDS).isNotNull(), F.pmod(F.xxhash64(F.lit("shard"), *spread), F.size(_SHARDS)).cast("int")).otherwise(F.lit(0))
    routed = _with_plan(df, keys, plan).withColumn(SHARD, shard)
    task = F.when(F.col(_SHARDS).isNotNull(), F.element_at(_SHARDS, F.col(SHARD) + 1)).otherwise(_bucket_task(plan))
    return routed.withColumn(TASK, task).drop(_HASH, _SHARDS).repartitionById(plan.tasks, F.col(TASK))


def replicate(df: DataFrame, keys: Sequence[str], plan: Placement) -> DataFrame:
    """The matching side: a row of a split key goes to each of its shards, any other row to one task."""
    routed = _with_plan(df, keys, plan)
    targets = F.when(F.col(_SHARDS).isNotNull(), F.col(_SHARDS)).otherwise(F.array(_bucket_task(plan)))
    names = df.columns
    return (
        routed.select(*[F.col(f"`{c}`") for c in names], F.posexplode(targets).alias(SHARD, TASK))
        .repartitionById(plan.tasks, F.col(TASK))
    )


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner", tasks: int | None = None, plan: Placement | None = None) -> DataFrame:
    """Equi-join of ``left`` and ``right`` on ``keys`` with hot keys of ``left`` split over tasks.

    ``how`` is inner, left, left_semi or left_anti. Null keys match nothing. Columns besides the keys must
    differ between the sides. Empty sides give what the plain join gives. Equal rows are kept as often as the plain join keeps them.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a split left side can't be joined as {how}")
    plan = plan or plan_placement(left, keys, tasks)
    on = [TASK, SHARD, *keys]
    return place(left, keys, plan, spread).join(replicate(right, keys, plan), on, how).drop(TASK, SHARD)


def key_items(df: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """(keys, __fs_item, __fs_n): distinct (key, item) pairs with their rows, combined map-side and kept in the shared folder.

    Rows of one key are spread over all tasks by their items, so this needs no plan, and it is what is then placed.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.select(*keys, F.col(item).alias("__fs_item")).groupBy(*keys, "__fs_item").agg(F.count(F.lit(1)).alias("__fs_n")).checkpoint()


def per_key_results(df: DataFrame, keys: Sequence[str], item: str, matching: DataFrame | Callable[[DataFrame], DataFrame] | None = None, tasks: int | None = None) -> DataFrame:
    """Rows and distinct non-null items per key: keys, columns of ``matching``, ``n_rows``, ``n_items``.

    ``df`` is read once: repeated (key, item) rows are combined map-side first, so even a key made of copies shuffles little, and the load is planned on the
    pairs that are placed. ``matching`` has one row for each key (keys it lacks get nulls), or makes such rows from the pairs (keys, __fs_n rows). A null key
    is a group of its own. An empty table gives no rows.
    """
    names = list(keys)
    pairs = key_items(df, names, item)
    plan = plan_placement(pairs, names, tasks)
    placed = place(pairs, names, plan, ["__fs_item"])
    partial = placed.groupBy(TASK, SHARD, *names).agg(F.sum("__fs_n").alias("__fs_rows"), F.count("__fs_item").alias("__fs_items"))
    extra: list[str] = []
    if matching is not None:
        matching = matching(pairs) if callable(matching) else matching
        extra = [c for c in matching.columns if c not in names]
        other = replicate(matching.select(*names, *extra), names, plan)
        cond = F.lit(True)
        for c in (TASK, SHARD):
            cond = cond & (partial[c] == other[c])
        for c in names:
            cond = cond & partial[c].eqNullSafe(other[c])
        partial = partial.join(other, cond, "left").select(*[partial[c] for c in names], *[other[c] for c in extra], "__fs_rows", "__fs_items")
    return partial.groupBy(*names).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in extra],
        F.sum("__fs_rows").alias("n_rows"),
        F.sum("__fs_items").alias("n_items"),
    )
