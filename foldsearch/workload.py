"""The published workload: 20 queries, four limits, four modes; latencies, a check that the modes agree, and a report."""

from __future__ import annotations

import platform
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsearch.operators.search import Mode, SearchTables, search
from foldsearch.sources.places import write_report

# The published workload's queries and limits
QUERIES = ["a", "an", "new", "san", "city", "to", "tok", "tokyo", "mün", "mun", "são", "rio", "los", "paris", "york", "京", "東京", "北京", "ß", "ffi"]
LIMITS = (-1, 100, 50, 20)


def run(tables: SearchTables, queries: list[str] = QUERIES, limits: tuple[int, ...] = LIMITS, modes: tuple[Mode, ...] = tuple(Mode)) -> DataFrame:
    """(query, limit, mode, ms, results, checksum): each query once for each limit and mode. The checksum covers ids and ranks."""
    out = []
    for limit in limits:
        for mode in modes:
            for q in queries:
                start = time.perf_counter()
                got = search(tables, q, limit, mode).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(tables.spec.id, "rank_no")), F.lit(0)).alias("h")).first()
                out.append((q, limit, mode.value, (time.perf_counter() - start) * 1000, got["n"], got["h"]))
    return tables.rows.sparkSession.createDataFrame(out, "query string, limit int, mode string, ms double, results long, checksum long")


def mismatches(measured: DataFrame) -> DataFrame:
    """Queries whose modes differ in ids or order."""
    return measured.groupBy("query", "limit").agg(F.count_distinct("results", "checksum").alias("n")).where("n > 1")


def summary(measured: DataFrame) -> DataFrame:
    return measured.groupBy("limit", "mode").agg(F.avg("ms").alias("avg_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))


def by_mode(measured: DataFrame) -> DataFrame:
    """One row for each query and limit, a column for each mode."""
    return measured.groupBy("query", "limit").pivot("mode", [m.value for m in Mode]).agg(F.round(F.first("ms"), 1))


def report(measured: DataFrame, path: str) -> None:
    rows = [r.asDict() for r in summary(measured).orderBy("limit", "mode").collect()]
    write_report(path, f"Search latency on {platform.processor() or platform.machine()}, Python {platform.python_version()}", [{k: round(v, 1) if isinstance(v, float) else v for k, v in r.items()} for r in rows])
