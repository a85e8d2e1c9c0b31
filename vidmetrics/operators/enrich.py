"""Snapshot enrichment and the latest point per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidmetrics.operators.spread import first_rows
from vidmetrics.schemas import COUNTERS


def ratio(top: Column, bottom: Column) -> Column:
    """Double ratio, NULL on a zero or unknown denominator (ANSI mode would raise)."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def column_or_null(df: DataFrame, name: str, kind: str, prefix: str = "") -> Column:
    if name in df.columns:
        return F.col(f"{prefix}{name}")
    return F.lit(None).cast(kind)


def enrich_snapshots(ms: DataFrame, sv: DataFrame, v: DataFrame) -> DataFrame:
    """Snapshots with their source, their video and the derived ratios.

    Snapshots outnumber sources by far, so sources meet their videos first and snapshots are shuffled
    once, on the source id; adaptive execution splits the partition of a hot source.
    """
    described = sv.alias("sv").join(v.alias("v"), F.col("v.id") == F.col("sv.video_id"), "left")
    length = F.coalesce(
        column_or_null(ms, "video_length_seconds", "int", "ms."),
        F.col("sv.duration_seconds"), F.col("v.duration_seconds"),
    )
    views = F.coalesce(F.col("ms.views_native"), F.col("ms.reach"))
    counters = [
        column_or_null(ms, c, "long", "ms.").alias(c) for c in COUNTERS if c != "video_length_seconds"
    ]
    return (
        ms.alias("ms").join(described, F.col("sv.id") == F.col("ms.source_video_id"))
        .select(
            F.col("ms.id").alias("id"),
            F.col("ms.source_video_id").alias("source_video_id"),
            F.col("sv.video_id").alias("video_id"),
            F.col("sv.platform").alias("platform"),
            F.col("sv.platform_format").alias("platform_format"),
            F.col("sv.platform_video_id").alias("platform_video_id"),
            column_or_null(sv, "url", "string", "sv.").alias("url"),
            F.col("sv.title").alias("source_title"),
            F.col("sv.published_at").alias("source_published_at"),
            F.col("v.title").alias("video_title"),
            F.col("v.published_at").alias("video_published_at"),
            F.col("ms.snapshot_at").alias("snapshot_at"),
            *counters,
            length.alias("length_seconds"),
            views.alias("views_native_fallback"),
            ratio(F.col("ms.avg_watch_seconds"), length).alias("avg_watch_ratio"),
            ratio(F.col("ms.total_watch_seconds"), length).alias("watch_equivalent"),
            ratio(F.col("ms.likes") + F.col("ms.comments") + F.col("ms.shares"), views)
            .alias("engagement_rate"),
        )
    )


def latest_per_source(ms: DataFrame) -> DataFrame:
    """The newest snapshot of every source, ties to the highest id."""
    return first_rows(
        ms, ["source_video_id"], [F.col("snapshot_at").desc(), F.col("id").desc()]
    )


def latest_enriched(ms: DataFrame, sv: DataFrame, v: DataFrame) -> DataFrame:
    """The newest snapshot per source, enriched. Cut first, join afterwards."""
    return enrich_snapshots(latest_per_source(ms), sv, v)


def series_top_n(ms: DataFrame, sv: DataFrame, v: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` newest points of every source, enriched."""
    newest = first_rows(
        ms, ["source_video_id"], [F.col("snapshot_at").desc(), F.col("id").desc()],
        max(1, n),
    )
    return enrich_snapshots(newest, sv, v)


def resolved_metrics(ms: DataFrame, sv: DataFrame) -> DataFrame:
    """Metrics of active sources, views taken from reach when the native counter is unknown."""
    active = sv.filter(F.col("is_active") == 1).select(
        F.col("id").alias("source_video_id"), "video_id", F.col("platform").alias("source")
    )
    return ms.join(active, "source_video_id").select(
        "video_id", "source", F.col("snapshot_at").alias("captured_at"),
        F.coalesce("views_native", "reach").alias("views"),
        "likes", "comments", "shares", "total_watch_seconds",
    )


def explore_snapshots(
    ms: DataFrame, sv: DataFrame, metric: str, *, video_id: int | None = None,
    platform: str | None = None, start=None, end=None, page: int = 1, size: int = 200,
) -> DataFrame:
    """Raw values of one metric, filtered and paged; a size below 1 is the default."""
    if metric not in COUNTERS:
        raise ValueError(f"unknown metric {metric}")
    sources = sv
    if video_id is not None:
        sources = sources.filter(F.col("video_id") == video_id)
    if platform is not None:
        sources = sources.filter(F.col("platform") == platform.upper())
    rows = ms
    if start is not None:
        rows = rows.filter(F.col("snapshot_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.filter(F.col("snapshot_at") <= F.lit(end).cast("timestamp"))
    sources = sources.select(F.col("id").alias("source_video_id"), "video_id", "platform")
    size = size if size > 0 else 200
    return (
        rows.join(sources, "source_video_id")
        .select(
            "id", "video_id", "source_video_id", "platform", "snapshot_at",
            F.lit(metric).alias("metric"), F.col(metric).cast("long").alias("value"),
        )
        .orderBy("snapshot_at", "id")
        .offset((max(1, page) - 1) * size)
        .limit(size)
    )
