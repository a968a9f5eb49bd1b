"""The N highest-scoring items of every group.

A histogram of scores per group, on bins that keep the order of scores, gives each group a bin such that at least N of its
rows lie in it or above (all rows, if the group has fewer). Rows below are dropped before anything is sorted; what survives is ranked
exactly. Ranking keeps at most N rows of a group in each task before the shuffle, so a bin full of ties is no hot spot either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsearch.operators.skew import skew_join
from foldsearch.runtime import bounded_broadcast, ensure_checkpoint_dir

#: Thresholds of at most so many groups are broadcast (three numbers each); of more, they are joined by load.
BROADCAST_GROUPS = 200_000
#: Bins for each doubling of the score.
BINS_PER_DOUBLING = 8


def score_bin(score: Column) -> Column:
    """A bin number that never falls as the score rises; at most a few thousand bins over all numbers."""
    s = score.cast("double")
    size = F.floor(F.log2(F.greatest(F.abs(s), F.lit(5e-324))) * BINS_PER_DOUBLING).cast("int") + 20_000
    return F.when(s == 0, 0).when(s > 0, F.when(F.isnan(s) | (s == float("inf")), 1_000_000).otherwise(size)).otherwise(-F.when(s == float("-inf"), 1_000_000).otherwise(size))


def group_thresholds(rows: DataFrame, groups: list[str], score: str, n: int) -> DataFrame:
    """(groups, floor_bin): the highest bin with at least ``n`` rows of the group in it and above, else the lowest bin."""
    bins = rows.groupBy(*groups, score_bin(F.col(score)).alias("__fs_bin")).agg(F.count(F.lit(1)).alias("__fs_n"))
    above = F.sum("__fs_n").over(Window.partitionBy(*groups).orderBy(F.col("__fs_bin").desc()).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__fs_n")
    return bins.withColumn("__fs_above", above).where(F.col("__fs_above") < n).groupBy(*groups).agg(F.min("__fs_bin").alias("__fs_floor"))


def top_n(df: DataFrame, groups: list[str], score: str, ties: list[str], n: int) -> DataFrame:
    """Groups, score, ties and ``rank_no`` (1..n) of the ``n`` highest scores of each group, lower ties first among equals.

    Null groups and null scores are left out. Equal rows are items of their own, in any order among themselves. ``n`` below 1 or an empty table give no
    rows; other columns are not carried along.
    """
    rows = df.select(*dict.fromkeys([*groups, score, *ties])).where(F.col(score).isNotNull())
    for g in groups:
        rows = rows.where(F.col(g).isNotNull())
    if n < 1:
        return rows.withColumn("rank_no", F.lit(0)).where("false")
    ensure_checkpoint_dir(df.sparkSession)
    floors = group_thresholds(rows, groups, score, n).checkpoint()  # one narrow row for each group
    small, _ = bounded_broadcast(floors, BROADCAST_GROUPS)
    if small:
        met = rows.join(F.broadcast(floors), groups)
    else:
        # equal rows become one with as many copies as can count, so that no value of the columns holds most rows of a group
        few = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__fs_copies"))
        met = skew_join(few, floors, groups, [c for c in rows.columns if c not in groups]).where(score_bin(F.col(score)) >= F.col("__fs_floor"))
        met = met.withColumn("__fs_copy", F.explode(F.sequence(F.lit(1), F.least(F.col("__fs_copies"), F.lit(n)).cast("int")))).drop("__fs_copies", "__fs_copy")
    kept = met.where(score_bin(F.col(score)) >= F.col("__fs_floor")).drop("__fs_floor")
    order = Window.partitionBy(*groups).orderBy(F.col(score).desc(), *[F.col(t).asc() for t in ties])
    return kept.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= n)
