"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from expirylens.plans.storage import materialise, shared_folder

__all__ = ["arrow_rows", "extended", "materialise", "shared_folder", "table", "text_column", "with_part_index"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_column(name: str = "text"):
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def with_part_index(df: DataFrame, part: str = "part", row: str = "row") -> DataFrame:
    """The input task and the row's place in it; store the result before using it twice."""
    local = F.monotonically_increasing_id()
    return df.withColumns({part: F.shiftright(local, 33).cast("int"),
                           row: local.bitwiseAND(F.lit((1 << 33) - 1))})


def extended(schema: StructType, ddl: str) -> StructType:
    """The schema with more columns behind it."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def arrow_rows(batch: pa.RecordBatch, rows: int = 256):
    """Slices of an Arrow batch, so that what is made from very long texts stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
