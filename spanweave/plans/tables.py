"""Intermediate tables: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a new local folder only where it is unset and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cuts df's lineage: a Parquet table that outlives lost executors and has true sizes for the planner. Shuffle files of the
    write go with its end, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanweave/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    try:
        spark.conf.set(_CLEAN, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may have ended
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
