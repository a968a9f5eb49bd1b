"""Mixing sources to target shares of tokens.

A low-discrepancy schedule says whose turn it is: slot i gets the van der Corput point of i, and the source whose part of the cumulated weights
the point falls into. The slots of a source are ranked; its texts, shuffled anew for each repetition, are laid end to end and cut into blocks of
equal tokens; the k-th slot takes the k-th block. Any prefix of the schedule is mixed to within a few blocks of the targets.

The mix is as long as the scarcest source allows at its number of repetitions.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsearch.operators.ordinals import running
from foldsearch.runtime import small_table

#: Tokens of a block, unless the caller says otherwise: the mix is even down to a few blocks, and has as many slots as it has blocks.
BLOCK_TOKENS = 512
#: Texts of a source laid out in one task, on average.
CHUNK_ROWS = 100_000
#: Bits of a van der Corput point.
BITS = 40


@dataclass(frozen=True)
class Target:
    share: float
    max_repeats: int


def van_der_corput(i: int) -> int:
    """The bits of ``i`` mirrored, as an integer below 2**BITS."""
    return int(format(i, f"0{BITS}b")[::-1], 2)


def points_below(n: int, x: int) -> int:
    """How many of the first ``n`` points lie below ``x`` (in units of 2**-BITS), without listing them.

    The first n are split into aligned runs of 2**k; such a run is a grid of step 2**-k, offset by the mirrored run number.
    """
    found = start = 0
    for k in range(BITS, -1, -1):
        if n >> k & 1:
            step = 1 << (BITS - k)
            offset = van_der_corput(start)
            found += min(1 << k, max(0, -(-(x - offset) // step)))
            start += 1 << k
    return found


@dataclass(frozen=True)
class Schedule:
    slots: int
    block: int
    edges: tuple[int, ...]  # cumulated weights of the sources in units of 2**-BITS
    sources: tuple[str, ...]
    blocks: tuple[int, ...]  # slots of each source


def plan_schedule(available: Mapping[str, int], targets: Mapping[str, Target], block: int = BLOCK_TOKENS) -> Schedule:
    """The longest schedule no source of which needs more than its tokens times its repetitions.

    Sources without tokens, a positive share or a repetition take no part; the others' shares are taken in proportion.
    """
    names = sorted(s for s, t in targets.items() if available.get(s, 0) > 0 and t.share > 0 and t.max_repeats >= 1)
    total = sum(targets[s].share for s in names)
    if not names:
        return Schedule(0, block, (), (), ())
    most = min(available[s] * targets[s].max_repeats * total / targets[s].share for s in names)
    edges, run = [0], 0.0
    for s in names:
        run += targets[s].share / total
        edges.append(round(run * (1 << BITS)))
    edges[-1] = 1 << BITS
    limit = {s: available[s] * targets[s].max_repeats // block for s in names}

    def counts(n: int) -> list[int]:
        below = [points_below(n, e) for e in edges]
        return [b - a for a, b in zip(below, below[1:])]

    low, high = 0, int(most // block) + 1
    while low < high:  # counts only rise with n
        mid = (low + high + 1) // 2
        low, high = (mid, high) if all(c <= limit[s] for c, s in zip(counts(mid), names)) else (low, mid - 1)
    return Schedule(low, block, tuple(edges), tuple(names), tuple(counts(low)))


def slots(spark, plan: Schedule) -> DataFrame:
    """(slot_no, source, block_no): the schedule with the rank of each slot among its source's."""
    if not plan.slots:
        return spark.createDataFrame([], "slot_no bigint, source string, block_no bigint")
    mirrored = F.conv(F.reverse(F.lpad(F.conv(F.col("id").cast("string"), 10, 2), BITS, "0")), 2, 10).cast("long")
    source: Column = F.lit(plan.sources[-1])
    for edge, name in list(zip(plan.edges[1:], plan.sources))[-2::-1]:
        source = F.when(F.col("point") < edge, F.lit(name)).otherwise(source)
    listed = spark.range(plan.slots).withColumn("point", mirrored).select(F.col("id").alias("slot_no"), source.alias("source"), F.expr("id div 65536").alias("chunk"))
    return running(listed, ["source"], ["chunk"], [F.col("slot_no")], F.lit(1).cast("long"), "block_no").select("slot_no", "source", "block_no")


def blocks(counts: DataFrame, plan: Schedule, available: Mapping[str, int], seed: int) -> DataFrame:
    """(source, doc_id, n_tokens, repeat_no, block_no): texts laid end to end, anew for each repetition needed.

    A text belongs to the block its middle falls into, so that a source's end is as often a bit early as late. Texts without tokens take no
    room and are left out.
    """
    need = {s: -(-b * plan.block // available[s]) for s, b in zip(plan.sources, plan.blocks)}
    names = list(plan.sources)
    per_source = small_table(
        counts.sparkSession,
        {"source": pa.array(names, pa.string()), "__fs_have": pa.array([available[s] for s in names], pa.int64()), "__fs_need": pa.array([need[s] for s in names], pa.int32())},
    )
    # at most a row for each source of the target table, which the driver holds anyway
    laid = counts.where("n_tokens > 0").join(F.broadcast(per_source), "source").where("__fs_need > 0").withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.col("__fs_need") - 1)))
    drawn = F.xxhash64(F.lit(seed), "repeat_no", "doc_id")
    chunks = max(1, -(-max(available.values(), default=1) // (CHUNK_ROWS * 100)))
    # the leading part of the draw is the chunk, so that chunks follow one another in drawn order
    shuffled = laid.withColumn("__fs_draw", drawn).withColumn("chunk", F.floor((F.shiftrightunsigned("__fs_draw", 33) / F.lit(float(1 << 31))) * chunks).cast("int"))
    order = [F.shiftrightunsigned("__fs_draw", 33), F.col("__fs_draw"), F.col("doc_id")]
    at = running(shuffled, ["source", "repeat_no"], ["chunk"], order, F.col("n_tokens"), "__fs_at")
    position = F.col("repeat_no") * F.col("__fs_have") + F.col("__fs_at") + F.col("n_tokens") / 2
    return at.select("source", "doc_id", "n_tokens", "repeat_no", F.floor(position / plan.block).cast("long").alias("block_no"))


def mix(counts: DataFrame, targets: Mapping[str, Target], seed: int = 11, block: int = BLOCK_TOKENS) -> tuple[DataFrame, Schedule]:
    """((slot_no, source, doc_id, n_tokens, repeat_no), schedule): the mixed texts in the order of their slots.

    ``counts`` has doc_id (unique), source, n_tokens. Null and unlisted sources are not drawn. The targets are held by the driver.
    ``block`` is the tokens of a slot, whatever the size of the data; a source with fewer in all its repetitions ends the mix before it begins.
    """
    have = counts.where(F.col("source").isin(list(targets))).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect() if targets else []
    available = {r["source"]: int(r["n"] or 0) for r in have}
    plan = plan_schedule(available, targets, block)
    turns = slots(counts.sparkSession, plan)
    if not plan.slots:
        empty = counts.select(F.lit(0).cast("long").alias("slot_no"), "source", "doc_id", "n_tokens", F.lit(0).alias("repeat_no")).where("false")
        return empty, plan
    got = blocks(counts, plan, available, seed).join(turns, ["source", "block_no"])
    return got.select("slot_no", "source", "doc_id", "n_tokens", "repeat_no"), plan


def uses(mixed: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, n_uses) of the texts drawn."""
    return mixed.groupBy("doc_id").agg(F.first("source").alias("source"), F.first("n_tokens").alias("n_tokens"), F.count(F.lit(1)).cast("int").alias("n_uses"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_tokens, most_uses, actual_share) for every listed source, also those not drawn from."""
    got = uses(mixed).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("n_uses")).alias("n_tokens"), F.max("n_uses").alias("most_uses")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    total = F.sum("n_tokens").over(Window.partitionBy())  # over the listed sources, a handful of rows
    return (
        targets.select("source", "target_share", "max_repeats")
        .join(got, "source", "left")
        .select("source", "target_share", "max_repeats", zero("n_docs"), zero("n_tokens"), zero("most_uses"), F.coalesce(F.col("n_tokens") / total, F.lit(0.0)).alias("actual_share"))
    )


def check_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, n_over): for every listed source the documents used more often than it allows."""
    limits = targets.groupBy("source").agg(F.max("max_repeats").alias("most"))  # a handful of rows
    over = uses(mixed).join(limits, "source", "left").groupBy("source").agg(F.sum(F.when(F.col("n_uses") <= F.col("most"), 0).otherwise(1)).alias("n_over"))
    return limits.select("source").join(over, "source", "full").select("source", F.coalesce("n_over", F.lit(0)).cast("long").alias("n_over"))
