"""Many-to-one lookups, positional semi-joins and comparisons of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsearch.runtime import bounded_broadcast


def lookup(rows: DataFrame, names: DataFrame, key: str, broadcast_rows: int) -> DataFrame:
    """Left join on ``key``, unique in ``names``; broadcast only if ``names`` is counted to be small, else by key."""
    small, _ = bounded_broadcast(names, broadcast_rows)
    return rows.join(F.broadcast(names) if small else names, key, "left")


def at_positions(rows: DataFrame, positions: DataFrame, pos: str = "pos") -> DataFrame:
    """The rows whose position is among ``positions``."""
    return rows.join(positions.select(pos), pos, "left_semi")


def only_in_first(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks."""
    return a.select(key).join(b.select(key), key, "left_anti")


def differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys in one result only; side is missing (only in ``a``) or extra."""
    return only_in_first(a, b, key).withColumn("side", F.lit("missing")).unionAll(only_in_first(b, a, key).withColumn("side", F.lit("extra")))
