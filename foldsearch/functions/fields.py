"""Parsing of text fields: tolerant numbers and dates, lists, keys, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks other than line ends.
_SPACES = r"[\t\p{Zs}]+"


def trim_spaces(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_SPACES}|{_SPACES}$", "")


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def list_of(c: Column) -> Column:
    """Comma-separated items, trimmed, without empty ones. Null and empty give an empty list."""
    items = F.transform(F.split(F.coalesce(c, F.lit("")), ",", -1), trim_spaces)
    return F.filter(items, lambda x: x != "")


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def ascii_items(c: Column) -> Column:
    return F.filter(c, is_ascii)


def other_items(c: Column) -> Column:
    return F.filter(c, lambda x: ~is_ascii(x))


def int_or_null(c: Column) -> Column:
    """A sign and digits, nothing else (no blanks); null if it isn't that or doesn't fit."""
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint"))


def int_or_zero(c: Column) -> Column:
    return F.coalesce(int_or_null(c), F.lit(0).cast("long"))


def double_or_zero(c: Column) -> Column:
    """A decimal number, perhaps with an exponent, a hexadecimal whole number, nan or infinity; anything else is 0 (blanks around it, letters of a type after it, words)."""
    plain = F.when(c.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("double"))
    hexadecimal = F.when(c.rlike(r"^0[xX][0-9a-fA-F]{1,12}$"), F.conv(F.substring(c, 3, 12), 16, 10).cast("double"))
    named = F.when(c.rlike(r"^(?i)[+-]?(nan|inf|infinity)$"), c.try_cast("double"))
    return F.coalesce(plain, hexadecimal, named, F.lit(0.0))


def date_or_null(c: Column) -> Column:
    """yyyy-MM-dd, anything else is null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def dotted_key(*parts: Column) -> Column:
    """Parts joined by dots; null if any part is null."""
    given = F.lit(True)
    for p in parts:
        given = given & p.isNotNull()
    return F.when(given, F.concat_ws(".", *parts))


def crc_hex(c: Column) -> Column:
    """CRC-32 of a text or binary as eight small hexadecimal digits."""
    return F.lpad(F.lower(F.hex(F.crc32(c.cast("binary")))), 8, "0")


def fingerprint_columns(df: DataFrame) -> list[Column]:
    """Aggregates a fingerprint is made of: rows and the sums of the halves of their hashes. They can be observed while rows are written."""
    parts: list[Column] = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        c = F.col(f"`{f.name}`")
        nested = f.dataType.typeName() in ("array", "map", "struct", "variant")
        parts += [c.isNull(), F.to_json(F.struct(c)) if nested else c]  # a null adds nothing to a hash, so it is said
    row = F.xxhash64(*parts)
    return [F.count(F.lit(1)).alias("n"), F.sum(row.bitwiseAND(0xFFFFFFFF)).alias("lo"), F.sum(F.shiftrightunsigned(row, 32)).alias("hi")]


def fingerprint_text(got) -> str:
    return f"{got['n']:x}-{(got['lo'] or 0):x}-{(got['hi'] or 0):x}"


def fingerprint(df: DataFrame) -> str:
    """A checksum of all rows, whatever their order, as hexadecimal digits. One pass, one row to the driver."""
    return fingerprint_text(df.agg(*fingerprint_columns(df)).first())


def last_wins(df: DataFrame, key: str, value: str, line: str) -> DataFrame:
    """(key, value): of repeated keys the value of the last line. Null keys are left out."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, line).alias(value))
