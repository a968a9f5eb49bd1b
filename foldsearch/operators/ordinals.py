"""Running sums, running numbers and positions over tables of any size, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsearch.runtime import shuffle_tasks

#: Rows of one position in the order that are numbered in one task.
TIE_BLOCK = 100_000


def running(df: DataFrame, groups: list[str], chunk: list[str], order: list[Column], amount: Column, out: str) -> DataFrame:
    """``out``: sum of ``amount`` over the rows of the group before this one, in order of ``chunk``, then ``order``.

    Chunks cut a group into parts small enough for a task. Their sums (one row for each group and chunk) are run through first; a row then adds its
    chunk's start to the sum within its chunk. The order must be total for the result to be unique.
    """
    keys = [*groups, *chunk]
    marked = df.withColumn("__fs_a", amount)
    sums = marked.groupBy(*keys).agg(F.sum("__fs_a").alias("__fs_s"))
    before = Window.partitionBy(*groups).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("__fs_s").over(before), F.lit(0)).alias("__fs_start"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        marked.withColumn("__fs_w", F.coalesce(F.sum("__fs_a").over(within), F.lit(0)))
        .join(starts, keys)
        .withColumn(out, F.col("__fs_start") + F.col("__fs_w"))
        .drop("__fs_a", "__fs_w", "__fs_start")
    )


def positions(df: DataFrame, value: str, line: str, out: str = "pos", tasks: int | None = None) -> DataFrame:
    """``out``: 0, 1, 2, ... by ``value`` descending (nulls last), ties by ``line`` ascending; what a global row_number gives, in many tasks.

    Approximate quantiles cut the values into ranges; a value that is itself a cut, so perhaps a frequent one, is a range of its own and
    cut further by ``line``. Bad cuts cost time, not exactness. ``line`` is a unique integer, null lines come first.
    """
    n = tasks or shuffle_tasks(df.sparkSession)
    low = -(2**62)
    v = F.coalesce(F.col(value).cast("long"), F.lit(low))
    shares = [i / n for i in range(1, n)] or [0.5]
    cuts = df.select(F.percentile_approx(v, shares, 20 * max(50, n))).first()[0] or []
    cuts = sorted(set(cuts))
    marks = F.lit(cuts).cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    higher = F.size(F.filter(marks, lambda c: c > F.col("__fs_v")))
    is_cut = F.array_contains(marks, F.col("__fs_v"))
    with_chunk = (
        df.withColumn("__fs_v", v)
        .withColumn("__fs_range", higher * 2 + F.when(is_cut, 1).otherwise(0))
        .withColumn("__fs_block", F.when(is_cut, F.floor(F.coalesce(F.col(line), F.lit(low)) / TIE_BLOCK)).otherwise(F.lit(0)).cast("long"))
        .withColumn("__fs_all", F.lit(0))
    )
    order = [F.col("__fs_v").desc(), F.col(line).asc_nulls_first()]
    return running(with_chunk, ["__fs_all"], ["__fs_range", "__fs_block"], order, F.lit(1).cast("long"), out).drop("__fs_v", "__fs_range", "__fs_block", "__fs_all")
