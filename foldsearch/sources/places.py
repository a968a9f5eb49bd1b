"""Tab-separated place and administrative-code files, read into the typed place table."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsearch.functions import fields as X
from foldsearch.operators.lookup import lookup
from foldsearch.operators.ordinals import running
from foldsearch.schema import PLACE

PLACE_FIELDS = 19
#: Lookup tables up to this many rows are broadcast; larger ones are joined by key.
BROADCAST_ROWS = 500_000


def unzip_member(archive: str, member: str, out_dir: str) -> str:
    """Stage one member of a zip file; the path written. Fails if the archive lacks it."""
    with zipfile.ZipFile(archive) as z:
        if member not in z.namelist():
            raise FileNotFoundError(f"{archive} has no {member}")
        return z.extract(member, out_dir)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): lines with a number that rises through each file. Quotes mean nothing here."""
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    return spark.read.text(path).select("value", order.alias("line"))


def _columns(lines: DataFrame, least: int) -> DataFrame:
    return lines.select(F.split("value", "\t", -1).alias("f"), "line").where(F.size("f") >= least)


def read_admin_names(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """(key, value): code and plain-letter name of an administrative-code file; short lines are skipped, of repeated codes the last wins."""
    rows = _columns(read_lines(spark, path), 3).select(F.col("f")[0].alias(key), F.col("f")[2].alias(value), "line")
    return X.last_wins(rows, key, value, "line")


def parse_places(lines: DataFrame) -> DataFrame:
    """The place table without administrative names from (value, line); lines of fewer than 19 fields are skipped.

    Unreadable ids, coordinates and populations become 0, unreadable heights and dates null, empty optional fields null. Alternate names are split
    into those of ASCII characters only and the others. ``line`` is kept as it is.
    """

    def f(i: int) -> Column:
        return F.col("f")[i]

    names = X.list_of(f(3))
    opt = lambda i: X.empty_to_null(f(i))
    return _columns(lines, PLACE_FIELDS).select(
        X.int_or_zero(f(0)).alias("geoname_id"),
        f(1).alias("name"),
        f(2).alias("ascii_name"),
        X.other_items(names).alias("alternate_names"),
        X.ascii_items(names).alias("alternate_ascii_names"),
        X.double_or_zero(f(4)).alias("latitude"),
        X.double_or_zero(f(5)).alias("longitude"),
        opt(6).alias("feature_class"),
        opt(7).alias("feature_code"),
        f(8).alias("country_code"),
        X.list_of(f(9)).alias("cc2"),
        opt(10).alias("admin1_code"),
        opt(11).alias("admin2_code"),
        opt(12).alias("admin3_code"),
        opt(13).alias("admin4_code"),
        X.int_or_zero(f(14)).alias("population"),
        X.int_or_null(f(15)).alias("elevation"),
        X.int_or_null(f(16)).alias("dem"),
        opt(17).alias("timezone"),
        X.date_or_null(f(18)).alias("modification_date"),
        "line",
    )


def with_admin_names(places: DataFrame, admin1: DataFrame, admin2: DataFrame) -> DataFrame:
    """admin1_name and admin2_name by the codes; null where a code is missing or unknown."""
    one = X.dotted_key(F.col("country_code"), F.col("admin1_code"))
    two = X.dotted_key(F.col("country_code"), F.col("admin1_code"), F.col("admin2_code"))
    named = lookup(places.withColumn("__fs_k1", one), admin1.toDF("__fs_k1", "admin1_name"), "__fs_k1", BROADCAST_ROWS)
    named = lookup(named.withColumn("__fs_k2", two), admin2.toDF("__fs_k2", "admin2_name"), "__fs_k2", BROADCAST_ROWS)
    return named.drop("__fs_k1", "__fs_k2")


def read_places(spark: SparkSession, places: str, admin1: str, admin2: str) -> DataFrame:
    """Place file and both administrative-code files -> the place table: named places with a population other than 0, ``source_line`` in order of lines."""
    rows = parse_places(read_lines(spark, places)).where("population <> 0")
    named = with_admin_names(rows, read_admin_names(spark, admin1, "code", "name"), read_admin_names(spark, admin2, "code", "name"))
    return numbered(named).select(*PLACE.fieldNames())


def numbered(rows: DataFrame) -> DataFrame:
    """``line`` replaced by ``source_line`` = 0, 1, 2, ... in its order; numbered within each split of a file, so no task gets them all."""
    split = rows.withColumn("__fs_file", F.col("line.file_path")).withColumn("__fs_at", F.col("line.file_block_start")).withColumn("__fs_all", F.lit(0))
    return running(split, ["__fs_all"], ["__fs_file", "__fs_at"], [F.col("line.n")], F.lit(1).cast("long"), "source_line").drop("__fs_file", "__fs_at", "__fs_all", "line")


def printed(rows: DataFrame, columns: list[str] | None = None, indent: str = "  ") -> DataFrame:
    """``rows`` with ``printed``: all (or the given) columns as lines of ``name: value``, null as none, lists in brackets."""

    def one(c: str) -> Column:
        is_list = rows.schema[c].dataType.typeName() == "array"
        value = F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]")) if is_list else F.col(c).cast("string")
        return F.concat(F.lit(f"{indent}{c}: "), F.coalesce(value, F.lit("none")))

    return rows.withColumn("printed", F.concat_ws("\n", *[one(c) for c in (columns or rows.columns)]))


def write_report(path: str, title: str, rows: list[dict]) -> None:
    """A Markdown table, replaced at once."""
    head = list(rows[0]) if rows else []
    cell = lambda x: str(x).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(cell(r[h]) for h in head) + " |" for r in rows)]
    with open(path + ".part", "w") as out:
        out.write("\n".join(lines) + "\n")
    os.replace(path + ".part", path)
