"""References to records that do not exist.

Parents and children are put into one long table of tagged keys. Children are first reduced to counts per
(table, key, day); parents become +1 on the day they come into force and -1 on the day they end. One
pass over each key in day order then tells, for each child day, whether any parent line is in force. Keys without
parents are groups lacking the parent flag; what is left is summed per table and period.

Rows of a hot key never meet in one task: what a key brings to its group is at most a row for each day that occurs, and where the references
themselves are asked for, they meet their orphaned keys through the split join of problem 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsearch.operators.skew import skew_join

#: Day numbers beyond any date, for lines without a beginning or an end.
_FIRST_DAY, _LAST_DAY = -10_000_000, 10_000_000

REFERENCES = "ref_table string, ref_key string, ref_day int"


def parent_events(parents: DataFrame, ref_table: str, key: Column, starts: Column, ends: Column) -> DataFrame:
    """Tagged parent keys: a row each for the begin and the end of a line.

    A null begin counts as always, a null end as never. Lines with a null key are left out. A line that ends on or before its
    begin is never in force but still is a line with that code.
    """
    first = F.coalesce(F.unix_date(starts), F.lit(_FIRST_DAY))
    last = F.greatest(first, F.coalesce(F.unix_date(ends), F.lit(_LAST_DAY)))
    lines = parents.select(F.lit(ref_table).alias("ref_table"), key.alias("ref_key"), first.alias("a"), last.alias("b")).where("ref_key is not null")
    return lines.select(
        "ref_table", "ref_key", F.inline(F.array(F.struct(F.col("a").alias("ref_day"), F.lit(1).alias("delta")), F.struct(F.col("b").alias("ref_day"), F.lit(-1).alias("delta"))))
    ).select("ref_table", "ref_key", "ref_day", F.col("delta").cast("long"), F.lit(1).alias("is_parent"), F.lit(0).cast("long").alias("n_refs"))


def child_counts(references: DataFrame) -> DataFrame:
    """Tagged child keys: references per table, key and day, combined before the shuffle."""
    return references.groupBy("ref_table", "ref_key", "ref_day").agg(F.count(F.lit(1)).alias("n_refs")).select(
        "ref_table", "ref_key", "ref_day", F.lit(0).cast("long").alias("delta"), F.lit(0).alias("is_parent"), "n_refs"
    )


def orphan_keys(parents: DataFrame, references: DataFrame) -> DataFrame:
    """(ref_table, ref_key, ref_day, n_refs) of the references no parent line covers.

    ``parents`` as made by :func:`parent_events`; ``references`` has ref_table, ref_key and ref_day (days since the epoch, null: any day
    will do). Null keys refer to nothing and are left out. Repeated references count each time.
    """
    days = references.where("ref_key is not null and ref_table is not null")
    long_form = parents.groupBy("ref_table", "ref_key", "ref_day").agg(
        F.sum("delta").alias("delta"), F.max("is_parent").alias("is_parent"), F.sum("n_refs").alias("n_refs")
    ).unionByName(child_counts(days))
    by_key = Window.partitionBy("ref_table", "ref_key")
    in_order = by_key.orderBy(F.col("ref_day").asc_nulls_first(), F.col("is_parent").desc())
    marked = long_form.withColumn("in_force", F.sum("delta").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "has_parent", F.max("is_parent").over(by_key)
    )
    orphan = F.when(F.col("ref_day").isNull(), F.col("has_parent") == 0).otherwise(F.col("in_force") <= 0)
    return marked.where((F.col("n_refs") > 0) & orphan).select("ref_table", "ref_key", "ref_day", "n_refs")


def period_of(day: Column) -> Column:
    return F.coalesce(F.date_format(F.date_from_unix_date(day), "yyyy-MM"), F.lit("none"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references and distinct missing keys per table and month."""
    return orphans.groupBy("ref_table", period_of(F.col("ref_day")).alias("ref_period")).agg(
        F.sum("n_refs").alias("n_orphans"), F.count_distinct("ref_key").alias("n_keys")
    )


def orphan_rows(references: DataFrame, orphans: DataFrame, spread: list[str], tasks: int | None = None) -> DataFrame:
    """The references themselves (all their columns) whose table, key and day are orphaned. ``spread`` are columns that tell the references of a key apart.

    A key and day with more references than a task's share (the null day above all) is split over tasks.
    """
    day = F.coalesce("ref_day", F.lit(_LAST_DAY + 1)).alias("__fs_day")
    miss = orphans.select("ref_table", "ref_key", day)
    return skew_join(references.select("*", day), miss, ["ref_table", "ref_key", "__fs_day"], spread, "left_semi", tasks).drop("__fs_day")


def current_rows(cities: DataFrame, columns: list[str]) -> DataFrame:
    """Of the rows with one geoname_id the one with the highest source_line; ids 0 and null are left out.

    Reduced map-side, so an id repeated by a third of all rows is no hot group. A null source_line counts as lowest;
    rows that tie on it are settled by the largest values, so the result doesn't depend on row order.
    """
    cols = [c for c in columns if c != "geoname_id"]
    best = F.max(F.struct(F.coalesce("source_line", F.lit(-(2**62))).alias("__fs_line"), *cols)).alias("r")
    return cities.where("geoname_id <> 0").groupBy("geoname_id").agg(best).select("geoname_id", *[F.col(f"r.{c}").alias(c) for c in cols])


def city_references(cities: DataFrame) -> DataFrame:
    """(geoname_id, ref_table, ref_key, ref_day) of the admin codes of all current rows. A null country counts as empty."""
    rows = current_rows(cities, ["country_code", "admin1_code", "admin2_code", "modification_date"])
    country = F.coalesce("country_code", F.lit(""))
    one = F.when(F.col("admin1_code") != "", F.struct(F.lit("admin1_codes").alias("ref_table"), F.concat_ws(".", country, "admin1_code").alias("ref_key")))
    two = F.when((F.col("admin1_code") != "") & (F.col("admin2_code") != ""), F.struct(F.lit("admin2_codes").alias("ref_table"), F.concat_ws(".", country, "admin1_code", "admin2_code").alias("ref_key")))
    return rows.select("geoname_id", F.unix_date("modification_date").alias("ref_day"), F.explode(F.filter(F.array(one, two), lambda x: x.isNotNull())).alias("x")).select(
        "geoname_id", "x.ref_table", "x.ref_key", "ref_day"
    )
