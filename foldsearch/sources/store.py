"""A store: the place table in ranking order with its search artifacts and a checked manifest, as Parquet folders.

Files: ``rows`` (by position), ``fields``, ``postings`` and ``freq`` (by character), ``fold`` and the manifest as one JSON line.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from foldsearch.functions.fields import fingerprint, fingerprint_columns, fingerprint_text
from foldsearch.functions.fold import fold_table
from foldsearch.operators import artifacts as A
from foldsearch.operators.ordinals import positions
from foldsearch.operators.search import SearchTables
from foldsearch.runtime import shuffle_tasks
from foldsearch.schema import FOLD_VERSION, PLACES, SCHEMA_VERSION, Manifest, SearchSpec


class StoreError(ValueError):
    """A store that isn't what its manifest says."""


def write_store(df: DataFrame, path: str, spec: SearchSpec = PLACES, source_name: str = "", source_urls: list[str] | None = None) -> Manifest:
    """Number the rows by the spec's order and write everything, replacing what was at ``path``."""
    spark = df.sparkSession
    n = shuffle_tasks(spark)
    ordered = positions(df, spec.order_value, spec.order_line).repartitionByRange(n, "pos").sortWithinPartitions("pos")
    of_rows = _written(ordered, f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    present = A.corpus_chars(rows, spec)
    of_fields = _written(A.search_fields(rows, spec, present=present), f"{path}/fields")
    fields = spark.read.parquet(f"{path}/fields")
    A.postings(fields).repartitionByRange(n, "scalar", "pos").sortWithinPartitions("scalar", "pos").write.mode("overwrite").parquet(f"{path}/postings")
    A.scalar_freq(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/freq")
    fold_table(spark, present).coalesce(1).write.mode("overwrite").parquet(f"{path}/fold")
    manifest = Manifest(
        SCHEMA_VERSION,
        FOLD_VERSION,
        datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
        source_name,
        f"{spec.order_value} descending",
        of_rows["n"],
        fingerprint_text(of_rows),
        fingerprint_text(of_fields),
        {"id": spec.id, "primary": list(spec.primary), "alternate": list(spec.alternate), "order_value": spec.order_value, "order_line": spec.order_line},
        source_urls or [],
        "admin1_name" in df.columns,
        "admin2_name" in df.columns,
    )
    _write_manifest(spark, path, manifest)
    return manifest


def _written(df: DataFrame, path: str) -> dict:
    """Write ``df``; what its fingerprint is made of is observed on the way."""
    seen = Observation()
    df.observe(seen, *fingerprint_columns(df)).write.mode("overwrite").parquet(path)
    return seen.get


def _write_manifest(spark: SparkSession, path: str, manifest: Manifest) -> None:
    spark.range(1).select(F.lit(manifest.to_json()).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    try:
        lines = spark.read.text(f"{path}/manifest").collect()
    except Exception as e:
        raise StoreError(f"no store at {path}") from e
    try:
        manifest = Manifest.from_json(lines[0]["value"])
    except (IndexError, TypeError, ValueError) as e:
        raise StoreError("the manifest can't be read") from e
    if manifest.schema_version != SCHEMA_VERSION or manifest.fold_version != FOLD_VERSION:
        raise StoreError(f"made for schema {manifest.schema_version} and fold {manifest.fold_version}")
    return manifest


def read_store(spark: SparkSession, path: str, columns: list[str] | None = None, verify: bool = True) -> SearchTables:
    """The tables of a store; ``columns`` of the rows only, if given. ``verify`` reads everything once and compares checksums.

    The fold table's characters (bounded by Unicode, not by the data) are held by the driver.
    """
    manifest = read_manifest(spark, path)
    spec = SearchSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in manifest.search_spec.items()})
    rows, fields = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/fields")
    if verify:
        if fingerprint(rows) != manifest.data_fingerprint:
            raise StoreError("the rows don't match the manifest")
        if fingerprint(fields) != manifest.search_fingerprint:
            raise StoreError("the search texts don't match the manifest")
    if columns is not None:
        rows = rows.select("pos", *[c for c in columns if c != "pos"])
    return SearchTables(rows, spec, fields, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/freq"), manifest.row_count, frozenset(chr(r["scalar"]) for r in spark.read.parquet(f"{path}/fold").select("scalar").collect()))


def with_artifacts(rows: DataFrame, spec: SearchSpec, stored: SearchTables) -> SearchTables:
    """``rows`` searched with another store's artifacts, if they were made from the same texts; else with texts made anew and no index."""
    fields = A.search_fields(rows, spec)
    if stored.fields is not None and fingerprint(fields) == fingerprint(stored.fields.select(*fields.columns)):
        return SearchTables(rows, spec, stored.fields, stored.postings, stored.freq, stored.n_rows, stored.present)
    return SearchTables(rows, spec, fields)
