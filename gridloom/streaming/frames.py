"""Structured Streaming forms of the frame series and of event windows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.sources.shared import shared_dir


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of files, one file a trigger."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    folder = _is_folder(spark, sf_dir)
    found = reader.parquet(f"{sf_dir}/events.parquet") if folder else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, sf_dir: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all input there is, into a Parquet sink in the shared folder, and return what it wrote."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/gridloom/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", base + "/out").option("checkpointLocation", base + "/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(base + "/out")
    kept: list[int] = []

    def save(batch: DataFrame, epoch: int) -> None:  # each epoch holds the whole result so far; a repeat overwrites itself
        batch.write.mode("overwrite").parquet(f"{base}/out/{epoch}")
        kept.append(epoch)

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", base + "/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/{max(kept)}") if kept else spark.createDataFrame([], stream.schema)


def window_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "40 days") -> DataFrame:
    """start, event_type, n, total of tumbling or sliding windows; with a watermark for late rows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum(F.floor("value")).cast("bigint").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "40 days") -> DataFrame:
    """user_id, start, n of sessions parted by gaps."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def frame_means(events: DataFrame, pixels: int = 1000) -> DataFrame:
    """frame_idx, n, above: pixels of each frame and how many exceed 110, as running aggregates."""
    frame = F.expr(f"event_id div {pixels}")
    return events.groupBy(frame.alias("frame_idx")).agg(F.count("*").alias("n"), F.sum((F.least(F.lit(255.0), F.floor("value")) > 110).cast("bigint")).alias("above"))


def running_maximum(events: DataFrame) -> DataFrame:
    """user_id, ts, highest: each user's highest value so far, kept in state; rows of a batch are taken in time order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        before = state.get[0] if state.exists else float("-inf")
        highest = rows["value"].cummax().clip(lower=before)
        state.update((float(highest.iloc[-1]),))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "highest": highest})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, highest double", "highest double", "append", GroupStateTimeout.NoTimeout)
