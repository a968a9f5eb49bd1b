"""What changed between full snapshots: Merkle trees over hash ranges of the keys.

A key's hash puts it into a leaf, a range of hashes. For each pair of neighbouring snapshots a leaf has two digests, the exclusive or of the 64-bit hashes of
its rows (which are unique by key); an inner node's digests are made of its children's. The pairs of digests are compared from the root down, and only
children of differing nodes are looked at. Rows are then compared only in leaves that differ.

The rows are brought to their leaf once, and nothing else of their size is shuffled: rows overtaken within a snapshot are told, digests made and rows compared on
that one partitioning. Where a hash bucket holds more than a task's share of the rows (a key delivered over and over), its rows are first
combined map-side. How many keys a leaf holds follows from the share of keys that change, observed in one of OBSERVED hash ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsearch.runtime import shuffle_tasks

#: Children of an inner node, as bits of the hash.
FANOUT_BITS = 8
#: Hash buckets whose rows are counted to find keys with very many of them.
BUCKETS = 4096
#: The change rate is observed in one hash range of so many.
OBSERVED = 256
#: What a leaf's digest (shuffled) costs, in compared rows (not shuffled).
DIGEST_COST = 4.0


def leaf_bits(keys: int, keys_per_leaf: int) -> int:
    """Depth of the tree in bits so that a leaf holds about ``keys_per_leaf`` keys."""
    return min(30, max(1, (max(1, keys) // max(1, keys_per_leaf)).bit_length()))


def keys_for_rate(rate: float) -> int:
    """Keys in a leaf so that compared rows and digests cost least: a leaf of k keys differs in about k * rate of the pairs and costs a digest for every k keys."""
    return max(1, min(64, round(math.sqrt(DIGEST_COST / max(rate, 1e-6)))))


def leaf_of(key: Column, bits: int) -> Column:
    """The leaf's number: the leading ``bits`` of the key's hash, so that leaves are ranges of hashes."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits).cast("int")


def row_digest(key: Column, values: list[Column]) -> Column:
    """Hash of a row; nulls are values of their own."""
    parts: list[Column] = [key]
    for v in values:
        parts += [v.isNull(), v]
    return F.xxhash64(*parts)


def _narrow(snapshots: DataFrame, snapshot: str, key: str, order: list[str], values: list[str]) -> DataFrame:
    """(snap, key, o0.., v0..) without null snapshots and keys."""
    cols = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)] + [F.col(c).alias(f"v{i}") for i, c in enumerate(values)]
    return snapshots.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull()).select(F.col(snapshot).alias("snap"), F.col(key).alias("key"), *cols)


def _counting(rows: DataFrame, by: list[str], outs: list[str]) -> DataFrame:
    """The row that counts of each group of ``by``: highest order, nulls lowest, equal orders by the larger values. Keeps the partitioning of ``rows``."""
    first = Window.partitionBy(*by).orderBy(*[F.col(c).desc_nulls_last() for c in outs])
    return rows.withColumn("__fs_n", F.row_number().over(first)).where("__fs_n = 1").drop("__fs_n")


def _combined(rows: DataFrame, outs: list[str]) -> DataFrame:
    """The same, combined map-side: for keys with very many rows."""
    best = rows.groupBy("snap", "key").agg(F.max(F.struct(*outs)).alias("r"))
    return best.select("snap", "key", *[F.col(f"r.{c}").alias(c) for c in outs])


def effective_rows(snapshots: DataFrame, snapshot: str, key: str, order: list[str], values: list[str]) -> DataFrame:
    """(snap, key, v): the row that counts for each snapshot and key, v a struct of the values.

    The highest ``order`` counts, nulls lowest; equal orders go to the larger values. Null keys and null snapshots are left out.
    """
    outs = [f"o{i}" for i in range(len(order))] + [f"v{i}" for i in range(len(values))]
    rows = _combined(_narrow(snapshots, snapshot, key, order, values), outs)
    return rows.select("snap", "key", F.struct(*[F.col(f"v{i}").alias(c) for i, c in enumerate(values)]).alias("v"))


def leaf_digests(rows: DataFrame) -> DataFrame:
    """(leaf, idx, digest) from rows with leaf, idx, digest: each snapshot's digest of a leaf, which can be kept for the next delivery."""
    return rows.groupBy("leaf", "idx").agg(F.bit_xor("digest").alias("digest"))


def differing_leaves(leaves: DataFrame, bits: int, last_idx: int, tasks: int) -> DataFrame:
    """(leaf, pairs): the pairs of neighbouring snapshots, named by the later one's order, for which the leaf differs.

    ``leaves`` as of :func:`leaf_digests`; a leaf without rows in a snapshot has digest 0. Goes from the root down: level by level, a node's pair is looked
    at only where the parent differs in it.
    """
    # a digest is the later one of its own pair and the earlier one of the next
    none = F.lit(0).cast("long")
    as_later = F.struct(F.col("idx").alias("pair"), F.col("digest").alias("later"), none.alias("earlier"))
    as_earlier = F.struct((F.col("idx") + 1).alias("pair"), none.alias("later"), F.col("digest").alias("earlier"))
    both = leaves.select(F.col("leaf").alias("node"), F.inline(F.array(as_later, as_earlier))).where((F.col("pair") > 0) & (F.col("pair") <= last_idx))
    level = both.groupBy("node", "pair").agg(F.bit_xor("later").alias("later"), F.bit_xor("earlier").alias("earlier"))
    steps = [min(FANOUT_BITS, bits - at) for at in range(0, bits, FANOUT_BITS)]
    levels = []
    for step in steps:
        # brought to the parent once, both to make the parents' digests and to be looked at under differing parents
        level = level.withColumn("up", F.shiftright("node", step)).repartition(tasks, "up")
        levels.append(level)
        # a child's digest with its number, so that equal digests of two children don't cancel
        mixed = lambda c: F.when(F.col(c) == 0, none).otherwise(F.xxhash64("node", c)).alias(c)
        up = level.select("up", "pair", mixed("later"), mixed("earlier")).groupBy("up", "pair").agg(F.bit_xor("later").alias("later"), F.bit_xor("earlier").alias("earlier"))
        level = up.withColumnRenamed("up", "node")
    differ = F.col("later") != F.col("earlier")
    pairs_of = lambda nodes: nodes.groupBy("node").agg(F.collect_set("pair").alias("pairs"))
    found = pairs_of(level.where(differ))
    for child in reversed(levels):
        under = child.where(differ).join(found.select(F.col("node").alias("up"), "pairs"), "up").where(F.array_contains("pairs", F.col("pair")))
        found = pairs_of(under.select("node", "pair"))
    return found.select(F.col("node").alias("leaf"), "pairs")


def _told(rows: DataFrame, by: list[str], n_values: int, last: int) -> DataFrame:
    """(key, idx, came, left, and ``pairs`` if there) from the counting rows of each key in snapshot order: what its snapshot and the next one report."""
    vs = [f"v{i}" for i in range(n_values)]
    of_key = Window.partitionBy(*by).orderBy("idx")
    now = F.struct(*vs)
    extra = [c for c in ("pairs",) if c in rows.columns]
    near = rows.select("key", "idx", *extra, now.alias("now"), F.lag("idx").over(of_key).alias("p_idx"), F.lag(now).over(of_key).alias("was"), F.lead("idx").over(of_key).alias("n_idx"))
    before = F.coalesce(F.col("p_idx") == F.col("idx") - 1, F.lit(False))
    after = F.coalesce(F.col("n_idx") == F.col("idx") + 1, F.lit(False))
    same = F.lit(True)
    for v in vs:
        same = same & F.col(f"now.{v}").eqNullSafe(F.col(f"was.{v}"))
    came = F.when((F.col("idx") > 0) & ~before, "added").when(before & ~same, "changed")
    left = F.when((F.col("idx") < last) & ~after, "removed")
    return near.select("key", "idx", *extra, came.alias("came"), left.alias("left"))


def observed_rate(rows: DataFrame, outs: list[str], n_values: int, last: int) -> float:
    """Share of the keys of a snapshot that change from one to the next, in one hash range of OBSERVED; only sizes the leaves."""
    part = rows.where(F.shiftrightunsigned(F.xxhash64("key"), 64 - (OBSERVED - 1).bit_length()) == 0)
    part = _combined(part.withColumnRenamed("idx", "snap"), outs).withColumnRenamed("snap", "idx")
    one = lambda c: F.when(F.col(c).isNotNull(), 1).otherwise(0)
    got = _told(part, ["key"], n_values, last).agg(F.count(F.lit(1)).alias("n"), F.sum(one("came") + one("left")).alias("e")).first()
    return got["e"] / got["n"] if got["n"] else 0.05


def snapshot_changes(snapshots: DataFrame, snapshot: str, key: str, order: list[str], values: list[str], keep: Column | None = None, keys_per_leaf: int | None = None) -> DataFrame:
    """(snap, key, change_kind): added, removed or changed keys of each snapshot against its predecessor.

    Predecessors are taken among all snapshot numbers that occur, also in rows that ``keep`` leaves out. Nothing is reported for the first
    snapshot; one snapshot or an empty table gives no rows. A null in a value is a value of its own. Repeated and overtaken rows count
    once, see :func:`effective_rows`. The list of snapshot numbers and the counts of BUCKETS hash buckets (not of keys) are brought to the driver.
    """
    spark = snapshots.sparkSession
    tasks = shuffle_tasks(spark)
    kept = keep if keep is not None else F.lit(True)
    of_bucket = F.pmod(F.xxhash64(F.col(key), F.lit("bucket")), F.lit(BUCKETS)).cast("int")
    counts = (
        snapshots.where(F.col(snapshot).isNotNull())
        .groupBy(F.col(snapshot).alias("s"), F.when(F.coalesce(kept, F.lit(False)) & F.col(key).isNotNull(), of_bucket).alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_bucket = counts.groupBy("b").agg(F.sum("n").alias("n"), F.collect_set("s").alias("s"), F.max("n").alias("most")).collect()  # at most BUCKETS + 1 rows
    numbers = sorted({s for r in by_bucket for s in r["s"]})
    if len(numbers) < 2:
        return snapshots.select(F.col(snapshot).alias("snap"), F.col(key).alias("key"), F.lit("").alias("change_kind")).where("false")
    last = len(numbers) - 1
    sizes = {r["b"]: r["n"] for r in by_bucket if r["b"] is not None}
    crowded = sorted(b for b, n in sizes.items() if n > max(sum(sizes.values()) / tasks, 4 * sum(sizes.values()) / BUCKETS))
    outs = [f"o{i}" for i in range(len(order))] + [f"v{i}" for i in range(len(values))]
    idx = (F.array_position(F.lit(numbers), F.col("snap")) - 1).cast("int").alias("idx")
    narrow = _narrow(snapshots if keep is None else snapshots.where(keep), snapshot, key, order, values)
    if crowded:  # at most as many buckets as tasks
        at = F.pmod(F.xxhash64(F.col("key"), F.lit("bucket")), F.lit(BUCKETS)).cast("int").isin(crowded)
        narrow = narrow.where(~at).unionAll(_combined(narrow.where(at), outs))
    narrow = narrow.select(idx, "key", *outs)
    if keys_per_leaf is None:
        keys_per_leaf = keys_for_rate(observed_rate(narrow, outs, len(values), last))
    bits = leaf_bits(sum(r["most"] for r in by_bucket if r["b"] is not None), keys_per_leaf)
    # both uses read the same columns, so that Spark makes this exchange once
    rows = narrow.withColumn("leaf", leaf_of(F.col("key"), bits)).repartition(tasks, "leaf")
    by = ["leaf", "key", "idx"]
    digest = row_digest(F.col("key"), [F.col(f"v{i}") for i in range(len(values))])
    found = differing_leaves(leaf_digests(_counting(rows, by, outs).select("leaf", "idx", digest.alias("digest"))), bits, last, tasks)
    needed = F.array_contains("pairs", F.col("idx")) | F.array_contains("pairs", F.col("idx") + 1)
    seen = _counting(rows.join(found.hint("shuffle_hash"), "leaf").where(needed), by, outs)
    told = _told(seen, ["leaf", "key"], len(values), last)
    both = F.array(F.struct(F.col("idx").alias("at"), F.col("came").alias("change_kind")), F.struct((F.col("idx") + 1).alias("at"), F.col("left").alias("change_kind")))
    events = told.select("key", "pairs", F.inline(both)).where(F.col("change_kind").isNotNull() & F.array_contains("pairs", F.col("at")))
    return events.select(F.element_at(F.lit(numbers), F.col("at") + 1).alias("snap"), "key", "change_kind")
