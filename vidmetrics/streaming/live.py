"""Hourly and daily maxima over the live stream of points."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidmetrics.operators.series import bucket_series

_KEY = ("video_id", "platform", "ts")


def live_buckets(
    points: DataFrame, sv: DataFrame, *, metric: str = "views_native", interval: str = "hour",
    lateness: str,
) -> DataFrame:
    """The streaming twin of the bucket series, for ``update`` or ``append`` mode.

    Rows that are later than ``lateness`` behind the newest one are dropped; the caller states how late
    rows may be. ``complete`` mode keeps every bucket and drops none, and so does ``store_buckets``, which
    also knows the bounds of the series.
    """
    sources = sv.filter(F.col("video_id").isNotNull()).select(
        F.col("id").alias("source_video_id"), "video_id", "platform"
    )
    width = "1 day" if interval == "day" else "1 hour"
    return (
        points.withWatermark("snapshot_at", lateness)
        .join(sources, "source_video_id")
        .groupBy("video_id", "platform", F.window("snapshot_at", width).alias("w"))
        .agg(F.max(F.coalesce(F.col(metric), F.lit(0)).cast("long")).alias("value"))
        .select("video_id", "platform", F.col("w.start").alias("ts"), "value")
    )


def merge_buckets(spark: SparkSession, path: str, found: DataFrame, *, files_per_day: int = 32) -> None:
    """Raises the buckets of a table kept in one folder per day to the maxima ``found``. Only the days of ``found``
    are read and rewritten. A maximum taken twice stays, so a repeated batch changes nothing."""
    incoming = found.select(*_KEY, "value").withColumn("day", F.to_date("ts"))
    rows = incoming
    try:
        current = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        days = [r[0] for r in incoming.select("day").distinct().collect()]  # bounded by the calendar
        rows = current.filter(F.col("day").isin(days)).select(*incoming.columns).unionByName(incoming)
    (
        rows.groupBy(*_KEY, "day").agg(F.max("value").alias("value"))
        .repartition("day", F.pmod(F.xxhash64("video_id", "platform"), F.lit(files_per_day)))
        .sortWithinPartitions("day", *_KEY).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    )


def store_buckets(
    path: str, sv: DataFrame, v: DataFrame, *, end, metric: str = "views_native", interval: str = "hour",
    range_text: str = "all", platforms: Sequence[str] | None = None,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that keeps the bucket series (A6) of a stream of points, from publication (or the
    start of the range) to ``end``, both included. Each batch is reduced to its maxima, which are merged into the
    table at ``path``: no watermark and no state, so rows count however late they are and in whatever order."""
    def write(batch: DataFrame, number: int) -> None:
        found = bucket_series(
            batch, sv, v, as_of=end, metric=metric, interval=interval, range_text=range_text, platforms=platforms
        ).persist()
        try:
            if not found.isEmpty():
                merge_buckets(batch.sparkSession, path, found)
        finally:
            found.unpersist()

    return write


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*_KEY, "value")
