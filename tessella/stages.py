"""Tables between the stages of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder instead.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.TemporaryDirectory(prefix="tessella-"))
        atexit.register(_own_dir[0].cleanup)
    return f"file://{_own_dir[0].name}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, max_records: int = 0) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts the lineage,
    and a lost executor costs no more than the stage it was in."""
    spark = df.sparkSession
    path = fresh(spark, name)
    out = df.write.option("compression", "zstd")
    if max_records:
        out = out.option("maxRecordsPerFile", max_records)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def planned_bytes(df: DataFrame) -> int:
    """What the optimiser expects df to have, from the sizes of its files; nothing is read.  0 if it does not know."""
    told = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return told if told < 1 << 55 else 0
