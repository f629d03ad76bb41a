"""Streams of events and readings: hourly volumes, sessions, idempotent storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def reading_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """New files of a folder as a stream; the rate is bounded by files a batch, nothing is dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def hourly_stream(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Volume by circuit and hour of the start; rows later than the watermark are dropped."""
    own = events.withColumn("start_ts", F.col("start_ts").cast("timestamp")).withWatermark("start_ts", late)
    return own.groupBy("circuit", F.window("start_ts", "1 hour")).agg(F.sum("volume_litres").alias("volume")).select("circuit", F.col("window.start").alias("hour_ts"), "volume")


def session_stream(readings: DataFrame, gap: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """Sessions of readings with flow: those at most the gap apart are one."""
    own = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).where("value >= 0.05")
    return own.groupBy("circuit", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("ts").alias("end_ts")).select("circuit", F.col("session_window.start").alias("start_ts"), "end_ts", "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (circuit, start_ts) once within the watermark."""
    own = events.withColumn("start_ts", F.col("start_ts").cast("timestamp")).withWatermark("start_ts", late)
    return own.dropDuplicatesWithinWatermark(["circuit", "start_ts"])


def store(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs write(batch, number) for each batch; with once, over what is there now."""
    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def append_new(path: str, keys: list[str], prune: str | None = None) -> Callable[[DataFrame, int], None]:
    """A writer that keeps what is stored: a batch that is run again adds nothing. Each batch is a folder of its own.

    With prune, a column among the keys (as the start of an event), only stored rows between the least and the largest value of the batch are
    compared, and files are written in its order, so that Parquet skips the others.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.dropDuplicates(keys)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            stored = spark.read.parquet(path).where(F.col("batch") != number)
            if prune:
                low, high = batch.agg(F.min(prune), F.max(prune)).first()
                stored = stored.where(F.col(prune).between(F.lit(low), F.lit(high)) | F.col(prune).isNull())
            own = own.join(stored.select(*keys), keys, "left_anti")
        (own.sortWithinPartitions(prune) if prune else own).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
