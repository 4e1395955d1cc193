"""Folders of Parquet tables, with their schemas remembered as a metastore would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a read-only folder. The footers are read once for each session and path, not for each query."""
    path = f"{folder}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        found = spark.read.parquet(path)
        _SCHEMAS[key] = found.schema
        return found
    return spark.read.schema(_SCHEMAS[key]).parquet(path)
