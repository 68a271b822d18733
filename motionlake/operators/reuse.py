"""Frames that several branches of a plan read: made once, as a written table."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder of ``spark.checkpoint.dir``, so that a lost executor costs
    no work anew; without that setting, as in a session of one machine, kept in memory and on disk."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{base.rstrip('/')}/motionlake/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
