"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("foldsearch")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_tasks(spark: SparkSession) -> int:
    """Number of reduce tasks the session is set up for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where the setting is absent and all runs on one machine (tests).

    The setting is read from the session; a cluster must name a folder all executors share, and without one this fails.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not (sc.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "foldsearch-checkpoint"))
    return sc._jsc.sc().getCheckpointDir().get()


def small_table(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """Driver-made rows of proven size as a local relation (no Python workers)."""
    return spark.createDataFrame(pa.table(columns))


def bounded_broadcast(df: DataFrame, max_rows: int) -> tuple[bool, int]:
    """Whether ``df`` has at most ``max_rows`` rows, looking at no more than one row beyond them."""
    n = df.limit(max_rows + 1).count()
    return n <= max_rows, n


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for an application; Spark serves the archive to them."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="foldsearch-")) / "foldsearch_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
