"""Table access, shared scratch storage and small helpers of the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark only, so that any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a local session (tests) gets one of its own; on a cluster a folder of one machine would lose
    or hide rows, so that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        if context.isDefined():
            found = context.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, chosen by the hash of ``key``: the same rows however the table is laid out."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key)).limit(limit)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by place, so that extra columns of a caller's table can't clash with ours, be it in
    another case."""
    places = [df.columns.index(n) for n in names]
    numbered = df.toDF(*[f"_own_{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"_own_{i}").alias(n) for i, n in zip(places, names)])


def sealed(df: DataFrame, *names: str) -> DataFrame:
    """The same rows with every column but the named ones under a name that no operator uses; see ``unsealed``."""
    return df.toDF(*[c if c in names else f"_own_{i}" for i, c in enumerate(df.columns)])


def unsealed(df: DataFrame, like: DataFrame, *names: str) -> DataFrame:
    """The columns of ``like`` again, under their own names and in their order."""
    return df.select(*[c if c in names else f"_own_{i}" for i, c in enumerate(like.columns)]).toDF(*like.columns)
