"""Nested field documents as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def save(documents: DataFrame, path: str, form: str = "parquet") -> None:
    """One nested row an image, as Parquet or JSON lines."""
    if form not in ("parquet", "json"):
        raise ValueError("parquet or json")
    documents.write.mode("errorifexists").format(form).save(path)


def load(spark: SparkSession, path: str, schema: StructType, form: str = "parquet") -> DataFrame:
    """The same rows; the schema is given, never guessed."""
    return spark.read.schema(schema).format(form).load(path)
