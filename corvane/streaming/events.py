"""Windows, sessions, as-of joins and streams over an event table. Extensions: the batch forms are the reference for the streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..tables import running, shared_folder


def _start(w: str = "w"):
    return F.unix_timestamp(F.col(f"{w}.start")).alias("start")


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total): the same over a batch and, with a watermark, over a stream."""
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(_start(), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(_start(), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, n): events of a user less than the gap apart are one session."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", _start(), "n")


def as_of(left: DataFrame, right: DataFrame, by: str = "user_id", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """(key, before): for each left row the latest right row of the same user no later than it; of equal times the largest key. One sort by user and time, no range join, and users of any size."""
    rows = left.select(by, ts, key, F.lit(1).alias("side")).unionByName(right.select(by, ts, key, F.lit(0).alias("side")))
    rows = rows.withColumn("before", F.when(F.col("side") == 0, F.col(key)))
    return running(rows, [by], [ts, "side", key], lasts=("before",)).filter("side = 1").select(key, F.col("last_before").alias("before"))


def watermarked(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    return stream.withWatermark("ts", late)


def once(stream: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Events without redeliveries within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_totals(stream: DataFrame) -> DataFrame:
    """(user_id, n, total): totals of each user so far, kept as state between batches."""

    def step(key, frames, state):
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout")


def run_stream(spark: SparkSession, path: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Reads the files as a stream, counts tumbling windows, and returns what the sink holds at the end.

    Each batch writes the windows it changed, and the last state of a window counts. Windows that end before the
    watermark, `late` behind the latest event of earlier batches, leave the state, and rows for them are dropped.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(at):  # a stream watches folders
        reader, path = reader.option("pathGlobFilter", at.getName()), str(at.getParent())
    source = reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = tumbling(watermarked(source, late), width)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    q = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(StructType([*counts.schema.fields, StructField("epoch", LongType())])).parquet(f"{folder}/out")
    return out.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "epoch").alias("s")).select("start", "event_type", "s.*")
