"""Work tables: written to the folder that driver and executors share, to cut a lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a local one serves a local session only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (path or "/tmp/skysift-checkpoints").rstrip("/")


def materialize(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
