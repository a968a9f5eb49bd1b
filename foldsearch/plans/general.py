"""Queries of the general data problems over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsearch.operators import orphans, skew, snapshots, spatial
from foldsearch.runtime import ensure_checkpoint_dir, table

#: A country code is frequent when it holds more than this share of a table's rows.
FREQUENT_SHARE = 0.03
NEAR_METRES = 500.0


def _places(spark: SparkSession, d: str) -> DataFrame:
    cols = ["country_code", "geoname_id"]
    one = table(spark, d, "cities").select(F.lit("cities").alias("table_name"), *cols)
    return one.unionAll(table(spark, d, "city_snapshots").select(F.lit("city_snapshots").alias("table_name"), *cols))


def p1_countries(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct places and the table's rows for each table and country code."""

    def matching(pairs: DataFrame) -> DataFrame:
        """One row for each key: what a shard needs to know of its table."""
        keys = pairs.groupBy("table_name", "country_code").agg(F.sum("__fs_n").alias("n"))
        totals = keys.groupBy("table_name").agg(F.sum("n").alias("table_rows"))
        return keys.join(totals, "table_name").select("table_name", "country_code", "table_rows")

    return skew.per_key_results(_places(spark, d), ["table_name", "country_code"], "geoname_id", matching).select(
        "table_name", "country_code", "n_rows", F.col("n_items").alias("n_places"), "table_rows"
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    got = p1_countries(spark, d)
    return got.where((F.col("country_code") != "") & (F.col("n_rows") > F.lit(FREQUENT_SHARE) * F.col("table_rows"))).select("table_name", "country_code")


def p1_snapshot_places(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot rows joined with the country's number of current places, split by load, summed per country."""
    snap = table(spark, d, "city_snapshots").select("country_code", "snapshot_no", "line_no", "geoname_id")
    known = orphans.current_rows(table(spark, d, "cities"), ["country_code"]).groupBy("country_code").agg(F.count(F.lit(1)).alias("n_known"))
    joined = skew.skew_join(snap, known, ["country_code"], ["snapshot_no", "line_no"])
    return joined.groupBy("country_code").agg(F.count(F.lit(1)).alias("n_rows"), F.max("n_known").alias("n_known"))


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ensure_checkpoint_dir(spark)
    # read several times, and a few short columns each
    refs = orphans.city_references(table(spark, d, "cities")).checkpoint()
    parents = None
    for name in ("admin1_codes", "admin2_codes"):
        lines = table(spark, d, name)
        part = orphans.parent_events(lines, name, F.col("code"), F.col("added_on"), F.col("deleted_on"))
        parents = part if parents is None else parents.unionByName(part)
    return refs, orphans.orphan_keys(parents, refs)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    refs, missing = _references(spark, d)
    return orphans.orphan_rows(refs, missing, ["geoname_id"]).select("ref_table", orphans.period_of(F.col("ref_day")).alias("ref_period"), "geoname_id")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references and missing keys per referenced table and month."""
    return orphans.orphan_report(_references(spark, d)[1])


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(
        table(spark, d, "city_snapshots"), "snapshot_no", "geoname_id", ["received_at", "line_no"], ["population", "modification_date"], keep=F.col("geoname_id") != 0
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).select(F.col("snap").alias("snapshot_no"), F.col("key").alias("geoname_id"), "change_kind")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Number of changes of each kind for each snapshot."""
    return _changes(spark, d).groupBy(F.col("snap").alias("snapshot_no"), "change_kind").agg(F.count(F.lit(1)).alias("n_ids"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    rows = orphans.current_rows(table(spark, d, "cities"), ["latitude", "longitude"])
    return rows.where("latitude <> 0 and longitude <> 0 and abs(latitude) <= 90 and abs(longitude) <= 180").select(
        F.col("geoname_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")
    )


def _kept_points(spark: SparkSession, d: str) -> DataFrame:
    """The points, written once to the shared folder: they are read several times, and are three numbers each."""
    ensure_checkpoint_dir(spark)
    return _points(spark, d).checkpoint()


def _inside(points: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    areas = table(spark, d, "areas").select(F.col("area_id").alias("area"), F.col("ring_lat").alias("ys"), F.col("ring_lon").alias("xs"))
    return spatial.containing_areas(points, areas).select(F.col("id").alias("geoname_id"), F.col("area").alias("area_id"))


def p6_near(spark: SparkSession, d: str) -> DataFrame:
    return spatial.near_pairs(_kept_points(spark, d), NEAR_METRES)


def p6_inside(spark: SparkSession, d: str) -> DataFrame:
    return _inside(_kept_points(spark, d), spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    points = _kept_points(spark, d)
    near = spatial.near_pairs(points, NEAR_METRES).select(F.lit("near").alias("match_kind"), "id_a", "id_b")
    inside = _inside(points, spark, d).select(F.lit("inside").alias("match_kind"), F.col("geoname_id").alias("id_a"), F.col("area_id").alias("id_b"))
    return near.unionAll(inside)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_countries, p1_snapshot_places, p3_found, p3_report, p5_found, p5_report, p6_found, p6_near, p6_inside)
}

_CURRENT = "(select * from cities where geoname_id <> 0 qualify row_number() over (partition by geoname_id order by source_line desc) = 1)"

_REFS = f"""refs as (
  select geoname_id, 'admin1_codes' as ref_table, country_code || '.' || admin1_code as ref_key, modification_date as on_day
  from {_CURRENT} where admin1_code <> ''
  union all
  select geoname_id, 'admin2_codes', country_code || '.' || admin1_code || '.' || admin2_code, modification_date
  from {_CURRENT} where admin1_code <> '' and admin2_code <> ''
), parents as (
  select 'admin1_codes' as ref_table, code, added_on, deleted_on from admin1_codes
  union all select 'admin2_codes', code, added_on, deleted_on from admin2_codes
), missing as (
  select r.* from refs r where not exists (
    select 1 from parents p where p.ref_table = r.ref_table and p.code = r.ref_key
      and (r.on_day is null or (p.added_on <= r.on_day and (p.deleted_on is null or p.deleted_on > r.on_day))))
)"""

_STEPS = """eff as (
  select snapshot_no, geoname_id, population, modification_date from city_snapshots where geoname_id <> 0
  qualify row_number() over (partition by snapshot_no, geoname_id order by received_at desc, line_no desc) = 1
), nos as (select snapshot_no, lag(snapshot_no) over (order by snapshot_no) as before from (select distinct snapshot_no from city_snapshots)
), changes as (
  select n.snapshot_no, coalesce(b.geoname_id, a.geoname_id) as geoname_id,
    case when a.geoname_id is null then 'added' when b.geoname_id is null then 'removed' else 'changed' end as change_kind
  from (select n.snapshot_no, e.* exclude (snapshot_no) from nos n join eff e on e.snapshot_no = n.snapshot_no where n.before is not null) b
  full join (select n.snapshot_no, e.* exclude (snapshot_no) from nos n join eff e on e.snapshot_no = n.before) a
    on a.snapshot_no = b.snapshot_no and a.geoname_id = b.geoname_id
  join nos n on n.snapshot_no = coalesce(a.snapshot_no, b.snapshot_no)
  where a.geoname_id is null or b.geoname_id is null
    or a.population is distinct from b.population or a.modification_date is distinct from b.modification_date
)"""

_POINTS = f"pts as (select geoname_id, latitude, longitude from {_CURRENT} where latitude <> 0 and longitude <> 0 and abs(latitude) <= 90 and abs(longitude) <= 180)"

_NEAR = """near as (
  with strips as (select *, floor((latitude + 90) / 0.0045) as s from pts),
  both_ as (select geoname_id, latitude, longitude, unnest([s - 1, s, s + 1]) as s from strips)
  select least(a.geoname_id, b.geoname_id) as id_a, greatest(a.geoname_id, b.geoname_id) as id_b
  from both_ a join strips b on a.s = b.s and a.geoname_id < b.geoname_id
  where pow(sin(radians(b.latitude - a.latitude) / 2), 2)
    + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2) <= pow(sin(500.0 / 6371008.8 / 2), 2)
)"""

_INSIDE = """edges as (
  select area_id, list_min(ring_lon) as west, list_max(ring_lon) as east, unnest(range(len(ring_lat))) as i, ring_lat, ring_lon from areas
), sides as (
  select area_id, west, east, ring_lat[i + 1] as y1, ring_lon[i + 1] as x1, ring_lat[(i + 1) % len(ring_lat) + 1] as y2, ring_lon[(i + 1) % len(ring_lat) + 1] as x2 from edges
), met as (
  select geoname_id, area_id, x1, x2, y1, y2, latitude as y, longitude + 360 * ceil((west - longitude) / 360) as x
  from pts join sides on latitude between least(y1, y2) and greatest(y1, y2) and longitude + 360 * ceil((west - longitude) / 360) <= east
), inside as (
  select geoname_id, area_id from met group by all
  having sum(case when (y1 > y) <> (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (case when y1 = y2 then 1 else y2 - y1 end) then 1 else 0 end) % 2 = 1
    or max(case when (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1) = 0 and x between least(x1, x2) and greatest(x1, x2) then 1 else 0 end) = 1
)"""

_COUNTS = """places as (
  select 'cities' as table_name, country_code, geoname_id from cities
  union all select 'city_snapshots', country_code, geoname_id from city_snapshots
), counts as (
  select table_name, country_code, count(*) as n_rows, count(distinct geoname_id) as n_places,
    cast(sum(count(*)) over (partition by table_name) as bigint) as table_rows
  from places group by table_name, country_code
)"""

SQL: dict[str, str] = {
    "p1_found": f"with {_COUNTS} select table_name, country_code from counts where country_code <> '' and n_rows > 0.03 * table_rows",
    "p1_countries": f"with {_COUNTS} select * from counts",
    "p1_snapshot_places": f"""select s.country_code, count(*) as n_rows, max(k.n_known) as n_known from city_snapshots s
        join (select country_code, count(*) as n_known from {_CURRENT} group by 1) k using (country_code) group by 1""",
    "p3_found": f"with {_REFS} select ref_table, coalesce(strftime(on_day, '%Y-%m'), 'none') as ref_period, geoname_id from missing",
    "p3_report": f"with {_REFS} select ref_table, coalesce(strftime(on_day, '%Y-%m'), 'none') as ref_period, count(*) as n_orphans, count(distinct ref_key) as n_keys from missing group by all",
    "p5_found": f"with {_STEPS} select snapshot_no, geoname_id, change_kind from changes",
    "p5_report": f"with {_STEPS} select snapshot_no, change_kind, count(*) as n_ids from changes group by all",
    "p6_found": f"with {_POINTS}, {_NEAR}, {_INSIDE} select 'near' as match_kind, id_a, id_b from near union all select 'inside', geoname_id, area_id from inside",
    "p6_near": f"with {_POINTS}, {_NEAR} select id_a, id_b from near",
    "p6_inside": f"with {_POINTS}, {_INSIDE} select geoname_id, area_id from inside",
}
