"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"


_chosen: list[str] = []


def use_folder(path: str) -> None:
    """The folder for sessions that name none."""
    _chosen[:] = [path]


def shared_folder(spark: SparkSession) -> str:
    """The name of a new folder below ``spark.checkpoint.dir``, which all executors must share.

    There is no default: a local folder would be another one on each machine.
    """
    base = spark.conf.get(FOLDER, None) or next(iter(_chosen), None)
    if not base:
        raise ValueError(f"set {FOLDER} to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/expirylens-{uuid.uuid4().hex}"


def materialise(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write a table once and read it back: cuts lineage, survives lost executors, prunes columns."""
    path = shared_folder(df.sparkSession)
    writer = df.write.option("compression", compression) if compression else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
