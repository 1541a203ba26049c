"""Intermediate tables computed once: written to a folder that driver and executors share, so that later plans begin at a scan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` or the context names it; a temporary one in local mode only."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="callgauge-"))
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` computed once and written as a table in ``folder`` (the shared one), until it is discarded.

    Later jobs read the table, so a lost executor costs a reread and not the work before it.
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._settled_at = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Removes settled tables that no later plan reads."""
    for found in tables:
        if path := getattr(found, "_settled_at", None):
            place = found.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(found.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
