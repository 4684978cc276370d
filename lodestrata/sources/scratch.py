"""Tables that are written once and read several times: in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session may leave it unset; then it gets a folder of its own."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        have = f"file://{tempfile.mkdtemp(prefix='lodestrata-')}"
        spark.sparkContext.setCheckpointDir(have)
        spark.conf.set("spark.checkpoint.dir", have)
    return have.rstrip("/")


def place(spark: SparkSession, what: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """df, computed once and read from where it was written from then on."""
    at = place(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
