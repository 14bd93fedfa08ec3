"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def place(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir.

    Where that is unset a local session, whose tasks run in the driver, gets a temporary folder; on a cluster it is refused.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tideline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to a new place and read back."""
    spark = df.sparkSession
    to = place(spark, label)
    df.write.option("compression", "zstd").parquet(to)
    return spark.read.schema(df.schema).parquet(to)
