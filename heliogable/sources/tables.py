"""Written intermediate tables below the shared folder ``spark.checkpoint.dir``, for operators that read a result more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local session without one gets a temporary folder, a cluster without one an error."""
    base = spark.conf.get(KEY, None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {KEY} to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="heliogable-")
        spark.conf.set(KEY, base)
    return base.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and go on from the copy, which has no lineage but its scan."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
