"""Per-video and per-platform sums over the latest point of every source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidmetrics.operators.enrich import latest_per_source, ratio
from vidmetrics.schemas import PLATFORM_SUFFIX

SUMS = ("views_native_sum", "likes_sum", "comments_sum", "shares_sum", "total_watch_seconds_sum")
PLATFORM_SUMS = tuple(f"views_{s}" for s in PLATFORM_SUFFIX.values())


def video_rollup(ms: DataFrame, sv: DataFrame, v: DataFrame, *, as_table: bool = False) -> DataFrame:
    """A1-A3: sums of the latest points of the active sources of every video, with ratios.

    ``as_table`` gives the stored form, where unknown sums are 0. Ratios always come from the raw
    sums: they are NULL as soon as one addend is unknown.

    Order of work: cut snapshots to one per source, sum per video (partial sums first), and only
    then join the videos, so a hot source or a hot video never reaches the join as many rows.
    """
    latest = latest_per_source(ms).select(
        "source_video_id", F.col("id").alias("snapshot_id"),
        F.coalesce("views_native", "reach").alias("views"),
        "likes", "comments", "shares", "total_watch_seconds",
    )
    active = sv.filter((F.col("is_active") == 1) & F.col("video_id").isNotNull()).select(
        F.col("id").alias("source_video_id"), "video_id", "platform"
    )

    def platform_sum(platform: str) -> Column:
        hit = F.col("snapshot_id").isNotNull() & (F.col("platform") == platform)
        return F.sum(F.when(hit, F.col("views")).otherwise(F.lit(0)))

    sums = (
        active.join(latest, "source_video_id", "left")
        .groupBy("video_id")
        .agg(
            F.count("*").alias("sources"),
            F.sum("views").alias("views_native_sum"),
            F.sum("likes").alias("likes_sum"),
            F.sum("comments").alias("comments_sum"),
            F.sum("shares").alias("shares_sum"),
            F.sum("total_watch_seconds").alias("total_watch_seconds_sum"),
            *[platform_sum(p).alias(f"views_{s}") for p, s in PLATFORM_SUFFIX.items()],
        )
    )
    watch, views = F.col("total_watch_seconds_sum"), F.col("views_native_sum")
    length = F.col("canonical_length_seconds")
    joined = (
        v.select(
            F.col("id").alias("video_id"), "slug", F.col("title").alias("video_title"),
            F.col("published_at").alias("video_published_at"),
            F.col("duration_seconds").alias("canonical_length_seconds"),
        )
        .join(sums, "video_id", "left")
        .withColumns({
            "avg_watch_ratio_est": ratio(ratio(watch, views), length),
            "watch_equivalent_sum": ratio(watch, length),
            "engagement_rate_sum": ratio(
                F.col("likes_sum") + F.col("comments_sum") + F.col("shares_sum"), views
            ),
        })
    )
    # A video without any active source has no addend at all: its platform sums are a plain 0.
    shown = {
        c: F.when(F.col("sources").isNull(), F.lit(0)).otherwise(F.col(c)) for c in PLATFORM_SUMS
    }
    if as_table:
        shown = {c: F.coalesce(F.col(c), F.lit(0)) for c in (*SUMS, *PLATFORM_SUMS)}
    return joined.withColumns(shown).drop("sources")


def video_last_snapshot(ms: DataFrame, sv: DataFrame) -> DataFrame:
    """A4: newest arrival per video; unlinked sources form the NULL video."""
    per_source = ms.groupBy("source_video_id").agg(F.max("created_at").alias("last_at"))
    return (
        per_source.join(sv.select(F.col("id").alias("source_video_id"), "video_id"), "source_video_id")
        .groupBy("video_id")
        .agg(F.max("last_at").alias("last_snapshot_at"))
    )


def overview_kpis(ms: DataFrame, sv: DataFrame) -> DataFrame:
    """Totals per platform over the latest points of all sources."""
    latest = latest_per_source(ms)
    engaged = engagement(F.col("platform"))
    return (
        latest.join(
            sv.select(F.col("id").alias("source_video_id"), "platform", "video_id"), "source_video_id"
        )
        .groupBy("platform", "video_id")
        .agg(
            F.sum(F.coalesce("views_native", "reach")).alias("views"),
            F.sum("total_watch_seconds").alias("watch"),
            F.sum(engaged).alias("engaged"),
            F.max("snapshot_at").alias("last_at"),
        )
        .groupBy("platform")
        .agg(
            F.count("video_id").alias("videos"),
            F.coalesce(F.sum("views"), F.lit(0)).alias("views_total"),
            F.coalesce(F.sum("watch"), F.lit(0)).alias("watch_time_seconds_total"),
            ratio(F.sum("watch"), F.count("video_id")).alias("watch_time_seconds_avg"),
            F.coalesce(F.sum("engaged"), F.lit(0)).alias("engagement_total"),
            F.max("last_at").alias("last_measure_at"),
        )
    )


def engagement(platform: Column) -> Column:
    """Facebook counts reactions, comments and shares; the others likes and comments."""
    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    return F.when(
        platform == "FACEBOOK", known("reactions_total") + known("comments") + known("shares")
    ).otherwise(known("likes") + known("comments"))


def engagement_by_platform(ms: DataFrame, sv: DataFrame) -> DataFrame:
    """Engagement of every (video, platform), plus the total of the video."""
    from pyspark.sql.window import Window

    per_platform = (
        latest_per_source(ms)
        .join(sv.select(F.col("id").alias("source_video_id"), "platform", "video_id"), "source_video_id")
        .filter(F.col("video_id").isNotNull())
        .groupBy("video_id", "platform")
        .agg(
            F.sum(F.coalesce("views_native", "reach")).alias("views"),
            F.sum(engagement(F.col("platform"))).alias("engagement"),
        )
    )
    # At most one row per platform and video here.
    return per_platform.withColumn(
        "engagement_video", F.sum("engagement").over(Window.partitionBy("video_id"))
    )


def engagement_table(ms: DataFrame, sv: DataFrame, v: DataFrame) -> DataFrame:
    """Q8: one row per (video, platform) over the latest points: title, format of the first publication,
    views, watch time, likes, loves, comments, shares and engagement."""
    known = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    per_platform = (
        latest_per_source(ms)
        .join(sv.select(F.col("id").alias("source_video_id"), "platform", "platform_format", "video_id"), "source_video_id")
        .filter(F.col("video_id").isNotNull())
        .groupBy("video_id", "platform")
        .agg(
            F.min_by(F.struct("platform_format"), "source_video_id").getField("platform_format").alias("platform_format"),
            F.coalesce(F.sum(F.coalesce("views_native", "reach")), F.lit(0)).alias("views"),
            known("total_watch_seconds"), known("likes"), known("reactions_love"), known("comments"), known("shares"),
            F.sum(engagement(F.col("platform"))).alias("engagement"),
        )
    )
    return per_platform.join(v.select(F.col("id").alias("video_id"), "title"), "video_id", "left")
