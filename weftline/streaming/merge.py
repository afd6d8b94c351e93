"""Extensions over streams: the weekly rollup with late data, and keyed merging of product events by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.ingest import combine_states, event_state, records


def weekly_stream(posts: DataFrame, late: str = "7 days") -> DataFrame:
    """Views and likes by account and week from Monday on, for a stream with created_at as a timestamp."""
    week = F.window("created_at", "7 days", startTime="4 days")  # epoch began on a Thursday
    return posts.withWatermark("created_at", late).groupBy("account", week).agg(F.sum("views").alias("views"), F.sum("likes").alias("likes")).select("account", F.col("window.start").alias("week_start"), "views", "likes")


def first_visits(urls: DataFrame, late: str = "1 day") -> DataFrame:
    """Each url once, among those seen within the watermark."""
    return urls.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["url"])


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the states that are written whole, in order."""
    at, files = _folder(spark, path)
    if not files.exists(at):
        return []
    done = [f.getPath() for f in files.listStatus(at) if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("state=")) for p in done)


def merge_into(path: str, key: str = "key", order: str = "at"):
    """For foreachBatch: keeps one state for each key of product events. A batch reads the state before it, not the events before it.

    A batch that runs again writes the same state again, from the one before it. The last
    two states stay.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        states, before = event_state(batch, key, order), [v for v in _versions(spark, path) if v < number]
        if before:
            states = states.unionByName(spark.read.parquet(f"{path}/state={before[-1]}"))
        combine_states(states).write.mode("overwrite").parquet(f"{path}/state={number}")
        for old in before[:-1]:
            at, files = _folder(spark, f"{path}/state={old}")
            files.delete(at, True)

    return write


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The records of all batches so far."""
    return records(spark.read.parquet(f"{path}/state={_versions(spark, path)[-1]}"))
