"""Session-level helpers: required settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on; safe to call repeatedly.

    A transcript row may repeat a key; the last value wins, as it does for the
    programs that write and read these files.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    java_context = spark.sparkContext._jsc.sc()
    chosen = java_context.getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sessionlake-"))
    return java_context.getCheckpointDir().get()


def materialize(frame: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``frame`` as Parquet in the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors, and makes a
    result that several later jobs read cost one computation.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = frame.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


_COSTLY = ("Join", "Aggregate", "Window", "Generate", "MapIn", "Union")


def shared(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` for use in several places: materialized unless it is a plain
    scan, so that what lies below it is computed once, not once per use."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return materialize(frame, name) if any(node in plan for node in _COSTLY) else frame


def estimated_bytes(frame: DataFrame) -> int:
    """Catalyst's size estimate of a frame; driver-side, starts no job."""
    stats = frame._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))
