"""Filters and projections of the place table, as plain column expressions so that they reach the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_id(rows: DataFrame, key: str, value) -> DataFrame:
    """The first row (by position, if there is one) with that id."""
    got = rows.where(F.col(key) == F.lit(value))
    return (got.orderBy("pos") if "pos" in rows.columns else got).limit(1)


def in_box(lat: str, lon: str, south: float, north: float, west: float, east: float) -> Column:
    return F.col(lat).between(south, north) & F.col(lon).between(west, east)


def top(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows; negative: all."""
    return rows.orderBy(*order) if n < 0 else rows.orderBy(*order).limit(n)


def any_row(rows: DataFrame, condition: Column) -> DataFrame:
    """(found): whether any row meets the condition; false for an empty table."""
    return rows.agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("found"))


def flag_bits(conditions: list[Column]) -> Column:
    """Conditions as the bits of an integer, the first as 1; null conditions count as not met."""
    out = F.lit(0)
    for i, c in enumerate(conditions):
        out = out.bitwiseOR(F.when(c, F.lit(1 << i)).otherwise(F.lit(0)))
    return out


def joined(column: str, separator: str = "\t") -> Column:
    return F.coalesce(F.array_join(column, separator), F.lit(""))
