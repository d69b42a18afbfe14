"""A folder for intermediate tables that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; below an own temporary folder only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _made.setdefault("", tempfile.mkdtemp(prefix="gleaner-"))
    path = f"{base.rstrip('/')}/gleaner-{spark.sparkContext.applicationId}"
    if path not in _made:
        _made[path] = path
        atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    """At the driver's end; a session that is already gone leaves the folder to the cluster's cleaner."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the application is ending
        pass


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than are needed to tell."""
    return df.limit(rows + 1).count() <= rows


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` there, with the writer's ``options``, and read it back: lineage ends, and lost executors cost a reread."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
