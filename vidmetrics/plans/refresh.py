"""The refresh job: all derived tables from the stored ones, in dependency order."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidmetrics.operators.align import aligned_dense, aligned_raw
from vidmetrics.operators.percentiles import percentile_bands
from vidmetrics.operators.rollup import video_rollup
from vidmetrics.operators.spread import with_running_max
from vidmetrics.sources.tables import read_table, replace_table

JOB = "derived_tables"
_LOG = "name string, version string, finished_at timestamp, status string"


def may_refresh(log: DataFrame, as_of: datetime, min_seconds: int = 120) -> bool:
    """M2: false while the last successful refresh is younger than the minimum interval."""
    last = log.filter("status = 'SUCCESS'").agg({"finished_at": "max"}).first()[0]
    return last is None or as_of - last >= timedelta(seconds=min_seconds)


def refresh_triggers(runs: DataFrame, min_seconds: int = 120) -> DataFrame:
    """M2, I11 over a whole log of batch runs (run_id, finished_at, status): would the end of each run have been allowed to
    start a refresh? ``previous`` is the latest earlier success; due: none, or at least ``min_seconds`` before.

    Runs are walked hour by hour, with one carried instant per hour, so a long log is not one task.
    """
    ended = runs.filter(F.col("finished_at").isNotNull()).select("run_id", "finished_at", "status", F.lit(JOB).alias("job"))
    at = F.when(F.col("status") == "SUCCESS", F.unix_millis("finished_at"))
    walked = with_running_max(ended.withColumn("_at", at), "job", "finished_at", "run_id", "_at", "_previous")
    gap = F.unix_millis("finished_at") - F.col("_previous")
    return walked.select(
        "run_id", "finished_at", "status", F.timestamp_millis("_previous").alias("previous"),
        (F.col("_previous").isNull() | (gap >= min_seconds * 1000)).alias("due"),
    )


def refresh(
    ms: DataFrame, sv: DataFrame, v: DataFrame, root: str, *, as_of: datetime, version: str,
    with_percentiles: bool = True, granularities: tuple[str, ...] = ("hour",),
) -> dict[str, str]:
    """M1: rollup, aligned points, dense curves, bands. Each stage reads the written table before it,
    so nothing is computed twice and a lost executor costs a task, not a lineage."""
    spark = ms.sparkSession
    paths = {"video_rollup": replace_table(
        video_rollup(ms, sv, v, as_table=True), root, "video_rollup", version, sort_by=["video_id"]
    )}
    for granularity in granularities:
        horizon = 720 if granularity == "hour" else 30
        raw_name, dense_name, bands_name = (f"{n}_{granularity}" for n in ("aligned_raw", "aligned_dense", "bands"))
        raw = aligned_raw(ms, sv, as_of=as_of, granularity=granularity)
        paths[raw_name] = replace_table(raw, root, raw_name, version, ["source"], ["video_id", "age_bucket"])
        dense = aligned_dense(
            read_table(spark, root, raw_name), sv, as_of=as_of, granularity=granularity, horizon=horizon
        )
        paths[dense_name] = replace_table(dense, root, dense_name, version, ["source"], ["video_id", "age_bucket"])
        if with_percentiles:
            bands = percentile_bands(read_table(spark, root, dense_name), as_of=as_of)
            paths[bands_name] = replace_table(bands, root, bands_name, version)
    return paths


def log_entry(spark: SparkSession, version: str, finished_at: datetime, status: str = "SUCCESS") -> DataFrame:
    return spark.createDataFrame([(JOB, version, finished_at, status)], _LOG)
