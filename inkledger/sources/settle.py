"""Settled stages: a stage's rows written once to the shared folder, so that nothing after it computes them again.

Stages whose rows cost money or time (asking a provider) must not run twice because a later step, a lost executor or a
second action asks for them. ``settled`` writes them as a table in the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stages/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
