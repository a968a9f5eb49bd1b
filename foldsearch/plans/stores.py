"""Queries that write files and read them back: ingest, the store, its four ways of searching, the binary container. With their SQL.

What they write goes to a folder of its own under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsearch import workload
from foldsearch.functions import fields as X
from foldsearch.operators import artifacts as A
from foldsearch.operators.search import Mode, SearchTables, batch, intersect_bitmaps, search
from foldsearch.plans.reference import _FIELDS, _PLACED, _POSTS, _oracle_needle, _quoted, _search_sql, placed, tables
from foldsearch.runtime import ensure_checkpoint_dir, table
from foldsearch.schema import PLACES
from foldsearch.sources import container, places, store

MAGIC = "FOLD"


def scratch(spark: SparkSession) -> str:
    """A new folder on the storage all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def _write_lines(df: DataFrame, columns: list, path: str) -> None:
    """Tab-separated lines in order of ``source_line``, a file for each task."""
    text = F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    df.orderBy("source_line").select(text.alias("value")).write.text(path)


def _as_files(spark: SparkSession, d: str) -> tuple[str, str, str]:
    """The test tables as the text files they stand for; names with tabs, commas or line ends can't be written so and are left empty."""
    at = scratch(spark)
    plain = lambda c: F.when(F.col(c).rlike(r"[\t\n\r]"), "").otherwise(F.col(c))
    rows = table(spark, d, "cities").where("source_line is not null")
    listed = lambda c: F.array_join(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & ~x.rlike(r"[\t\n\r,]")), ",")
    names = listed(F.concat(F.coalesce("alternate_names", F.array().cast("array<string>")), F.coalesce("alternate_ascii_names", F.array().cast("array<string>"))))
    optional = ["admin1_code", "admin2_code", "admin3_code", "admin4_code"]
    _write_lines(
        rows,
        [F.col("geoname_id"), plain("name"), plain("ascii_name"), names, F.col("latitude"), F.col("longitude"), F.col("feature_class"), F.col("feature_code"), F.col("country_code"), listed(F.col("cc2")), *[plain(c) for c in optional]]
        + [F.col(c) for c in ("population", "elevation", "dem", "timezone")]
        + [F.date_format("modification_date", "yyyy-MM-dd")],
        f"{at}/places",
    )
    for name in ("admin1_codes", "admin2_codes"):
        _write_lines(table(spark, d, name).where("code is not null"), [F.col("code"), F.col("name"), F.col("ascii_name"), F.col("geoname_id")], f"{at}/{name}")
    return f"{at}/places", f"{at}/admin1_codes", f"{at}/admin2_codes"


def ingest_places(spark: SparkSession, d: str) -> DataFrame:
    """The test tables written as text files and read by the ingest."""
    got = places.read_places(spark, *_as_files(spark, d))
    return got.select("geoname_id", "name", "latitude", "country_code", "admin1_code", "admin1_name", "admin2_name", "population", "elevation", "modification_date", F.size("alternate_names").alias("n_other"), F.size("alternate_ascii_names").alias("n_plain"))


def ingest_admin_names(spark: SparkSession, d: str) -> DataFrame:
    """Codes and names of both administrative-code files; of repeated codes the last line counts."""
    _, one, two = _as_files(spark, d)
    read = lambda path, name: places.read_admin_names(spark, path, "code", "name").select(F.lit(name).alias("file"), "code", "name")
    return read(one, "admin1_codes").unionAll(read(two, "admin2_codes"))


def _stored(spark: SparkSession, d: str) -> tuple[str, SearchTables]:
    path = scratch(spark)
    store.write_store(table(spark, d, "cities").where("population <> 0"), path)
    return path, store.read_store(spark, path)


def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A store written, checked on opening, and read: rows in ranking order with their search texts."""
    t = _stored(spark, d)[1]
    return t.rows.select("pos", "source_line", "geoname_id", "name").join(t.fields, "pos")


def store_index(spark: SparkSession, d: str) -> DataFrame:
    """The stored index of characters with its frequencies."""
    t = _stored(spark, d)[1]
    return t.postings.groupBy("scalar").agg(F.count(F.lit(1)).alias("n")).join(t.freq.withColumnRenamed("n", "stored"), "scalar")


def store_modes(spark: SparkSession, d: str) -> DataFrame:
    """One search in the four ways over a stored store, the index in use."""
    t = _stored(spark, d)[1]
    t.index_least_rows = 0
    out = None
    for mode in Mode:
        got = search(t, "石ナ", 50, mode).select(F.lit(mode.value).alias("mode"), "geoname_id", "pos", "rank", "rank_no")
        out = got if out is None else out.unionAll(got)
    return out


def modes_agree(spark: SparkSession, d: str) -> DataFrame:
    """The published workload: for each query and limit the results, and how many different ones the four ways give (ids and order)."""
    t = _stored(spark, d)[1]
    out = None
    for mode in Mode:
        every = batch(t, workload.QUERIES, -1, mode).join(t.rows.select("pos", "geoname_id"), "pos")
        got = every.select(F.lit(mode.value).alias("mode"), "query_no", "geoname_id", "rank_no")
        out = got if out is None else out.unionAll(got)
    limits = F.array(*[F.lit(n) for n in workload.LIMITS])
    cut = out.withColumn("limit_rows", F.explode(limits)).where((F.col("limit_rows") < 0) | (F.col("rank_no") <= F.col("limit_rows")))
    of_mode = cut.groupBy("query_no", "limit_rows", "mode").agg(F.count(F.lit(1)).alias("results"), F.bit_xor(F.xxhash64("geoname_id", "rank_no")).alias("checksum"))
    asked = spark.createDataFrame([(i, q, n) for i, q in enumerate(workload.QUERIES) for n in workload.LIMITS], "query_no int, query string, limit_rows int")
    seen = of_mode.groupBy("query_no", "limit_rows").agg(F.max("results").alias("results"), F.count(F.lit(1)).alias("modes"), F.count_distinct("results", "checksum").alias("different"))
    # a query without results has none in all four ways
    found = asked.join(seen, ["query_no", "limit_rows"], "left")
    return found.select("query", "limit_rows", F.coalesce("results", F.lit(0)).alias("results"), F.when(F.col("modes").isNull(), 1).when(F.col("modes") == len(Mode), F.col("different")).otherwise(len(Mode)).cast("long").alias("different"))


def artifact_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Rows other than those a store's artifacts were made from: the artifacts are left aside, the search sees the changed names."""
    t = _stored(spark, d)[1]
    others = t.rows.withColumn("name", F.concat(F.lit("Zzyx "), F.coalesce("name", F.lit(""))))
    mixed = store.with_artifacts(others, PLACES, t)
    kept = store.with_artifacts(t.rows, PLACES, t)
    found = search(mixed, "zzyx", -1).select("geoname_id", "pos", "rank")
    return found.select("geoname_id", "pos", "rank", F.lit(mixed.postings is None).alias("rebuilt"), F.lit(kept.postings is not None).alias("kept"))


def store_refused(spark: SparkSession, d: str) -> DataFrame:
    """Stores that aren't what their manifest says: what is changed, and whether opening is refused."""
    path, _ = _stored(spark, d)
    manifest = store.read_manifest(spark, path)
    out = []
    for what, change in (("nothing", {}), ("rows", {"data_fingerprint": "0-0-0"}), ("search texts", {"search_fingerprint": "1-1-1"}), ("schema", {"schema_version": 99}), ("fold", {"fold_version": 99})):
        store._write_manifest(spark, path, type(manifest)(**(vars(manifest) | change)))
        try:
            store.read_store(spark, path)
            out.append((what, False))
        except store.StoreError:
            out.append((what, True))
    return spark.createDataFrame(out, "changed string, refused boolean")


def container_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The places in ranking order through binary containers and back."""
    at = scratch(spark)
    container.write_containers(placed(spark, d), at, {"generatedAt": "2024-01-01T00:00:00Z", "sourceName": "test tables"}, MAGIC)
    got = container.read_container(spark, at, MAGIC)
    return got.select("pos", "geoname_id", "name", "country_code", "population", "elevation", "modification_date", "admin1_name", F.size("alternate_names").alias("n_other"))


def posting_bitmaps_and(spark: SparkSession, d: str) -> DataFrame:
    """Positions that hold k, r and u, by intersecting bitmaps."""
    maps = A.posting_bitmaps(A.postings(tables(spark, d).fields))
    both = intersect_bitmaps(maps, [ord(c) for c in "kru"])
    return both.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n_places"), F.count(F.lit(1)).alias("n_maps"))


def population_range(spark: SparkSession, d: str) -> DataFrame:
    """Least and greatest values and the range of positions of the places."""
    return placed(spark, d).agg(F.min("population").alias("least"), F.max("population").alias("most"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count_distinct("country_code").alias("n_countries"))


def row_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Order-free checksums: the same rows in another order, and with one value changed."""
    rows = table(spark, d, "cities")
    same = X.fingerprint(rows.repartition(5)) == X.fingerprint(rows)
    other = X.fingerprint(rows.withColumn("population", F.when(F.col("source_line") == 7, -12345).otherwise(F.col("population")))) != X.fingerprint(rows)
    return spark.createDataFrame([("same rows", same), ("one value changed", other)], "what string, as_expected boolean")


def printed_rows(spark: SparkSession, d: str) -> DataFrame:
    """The fields of each place of a country as text, as a result is shown."""
    rows = table(spark, d, "cities").where("country_code = 'XG'")
    return places.printed(rows, ["geoname_id", "name", "cc2", "elevation", "modification_date"]).select("source_line", "printed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (ingest_places, ingest_admin_names, store_roundtrip, store_index, store_modes, modes_agree, artifact_fallback, store_refused, container_roundtrip, posting_bitmaps_and, population_range, row_fingerprints, printed_rows)
}

_LISTED = "list_filter(coalesce({0}, []), lambda x: x is not null and not regexp_matches(x, '[\\t\\n\\r,]') and trim(x, ' \\t\\u00a0\\u2002\\u2003\\u2007\\u2009\\u202f\\u3000') <> '')"
_NAMES = "list_concat(" + _LISTED.format("alternate_names") + ", " + _LISTED.format("alternate_ascii_names") + ")"
_ADMIN_NAME = "(select code, arg_max(coalesce(ascii_name, ''), source_line) as name from {0} where code is not null group by code)"
#: An empty code is no code.
_CODE = "nullif({0}, '')"

SQL: dict[str, str] = {
    "ingest_places": f"""with c as (select *, coalesce(country_code, '') as cc, {_CODE.format('admin1_code')} as a1, {_CODE.format('admin2_code')} as a2, {_NAMES} as names from cities where population <> 0)
      select geoname_id, case when regexp_matches(coalesce(c.name, ''), '[\\t\\n\\r]') then '' else coalesce(c.name, '') end as name, latitude, cc as country_code, a1 as admin1_code, one.name as admin1_name, two.name as admin2_name, population, elevation, modification_date,
        cast(len(list_filter(names, lambda x: strlen(x) <> length(x))) as integer) as n_other, cast(len(list_filter(names, lambda x: strlen(x) = length(x))) as integer) as n_plain
      from c left join {_ADMIN_NAME.format('admin1_codes')} one on one.code = cc || '.' || a1 left join {_ADMIN_NAME.format('admin2_codes')} two on two.code = cc || '.' || a1 || '.' || a2""",
    "ingest_admin_names": " union all ".join(f"select '{t}' as file, code, coalesce(arg_max(coalesce(ascii_name, ''), source_line), '') as name from {t} where code is not null group by code" for t in ("admin1_codes", "admin2_codes")),
    "store_roundtrip": f"with {_FIELDS} select pos, source_line, geoname_id, name, primary_text, alternate_text from fields join placed using (pos, geoname_id)",
    "store_index": f"with {_POSTS} select scalar, count(*) as n, count(*) as stored from index_ group by scalar",
    "store_modes": f"select m as mode, s.* from (select unnest(['scan', 'stored', 'index', 'index_stored']) as m) cross join ({_search_sql('石ナ', 50)}) s",
    "modes_agree": f"""with {_FIELDS}, needles as (select * from (values {", ".join(f"({i}, {_quoted(q)}, {_oracle_needle(q)})" for i, q in enumerate(workload.QUERIES))}) n(query_no, query, needle)),
      counts as (select query, count(pos) as n from needles left join fields on contains(primary_text, needle) or contains(alternate_text, needle) group by query)
      select query, limit_rows, cast(case when limit_rows < 0 then n else least(n, limit_rows) end as bigint) as results, 1::bigint as different from counts cross join (select unnest([{", ".join(map(str, workload.LIMITS))}]) as limit_rows)""",
    "artifact_fallback": f"with {_PLACED} select geoname_id, pos, 0 as rank, true as rebuilt, true as kept from placed",
    "store_refused": "select * from (values ('nothing', false), ('rows', true), ('search texts', true), ('schema', true), ('fold', true)) t(changed, refused)",
    "container_roundtrip": f"with {_PLACED} select pos, geoname_id, coalesce(name, '') as name, coalesce(country_code, '') as country_code, population, elevation, modification_date, admin1_name, cast(len(coalesce(alternate_names, [])) as integer) as n_other from placed",
    "posting_bitmaps_and": f"""with {_POSTS}, met as (select pos from index_ where scalar in (ascii('k'), ascii('r'), ascii('u')) group by pos having count(distinct scalar) = 3)
      select count(*) as n_places, count(distinct pos // 32768) as n_maps from met""",
    "population_range": f"with {_PLACED} select min(population) as least, max(population) as most, min(pos) as first_pos, max(pos) as last_pos, count(distinct country_code) as n_countries from placed",
    "row_fingerprints": "select * from (values ('same rows', true), ('one value changed', true)) t(what, as_expected)",
    "printed_rows": """select source_line, '  geoname_id: ' || coalesce(geoname_id::varchar, 'none') || chr(10) || '  name: ' || coalesce(name, 'none') || chr(10) || '  cc2: ' || coalesce('[' || array_to_string(cc2, ', ') || ']', 'none')
        || chr(10) || '  elevation: ' || coalesce(elevation::varchar, 'none') || chr(10) || '  modification_date: ' || coalesce(strftime(modification_date, '%Y-%m-%d'), 'none') as printed from cities where country_code = 'XG'""",
}
