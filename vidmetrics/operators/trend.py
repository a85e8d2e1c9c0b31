"""Trend of a video: regression slope, day deltas, stars, milestones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vidmetrics.operators.enrich import ratio
from vidmetrics.operators.spread import first_rows, instant


def stars_from_slope(slope: Column) -> Column:
    """F22. Thresholds in views per hour are fixed values: 32, 8, 2."""
    return F.when(slope >= 32, 3).when(slope >= 8, 2).when(slope >= 2, 1).otherwise(0)


def video_trend(
    ms: DataFrame, sv: DataFrame, v: DataFrame, *, n: int = 20, views_col: str = "views_native"
) -> DataFrame:
    """Least-squares views per hour over the ``n`` newest known points of a video, all its
    sources pooled; 0 with fewer than two points or no spread in time.

    Points are cut per source before the join and again per video after it; both cuts happen
    before their shuffle, so the number of snapshots of a source does not matter.
    """
    newest = [F.col("snapshot_at").desc(), F.col("id").desc()]
    points = ms.filter(F.col(views_col).isNotNull()).select(
        "id", "source_video_id", "snapshot_at", F.col(views_col).alias("views")
    )
    linked = sv.filter(F.col("video_id").isNotNull()).select(
        F.col("id").alias("source_video_id"), "video_id"
    )
    pooled = first_rows(points, ["source_video_id"], newest, n).join(linked, "source_video_id")
    kept = first_rows(pooled, ["video_id"], newest, n)
    seconds = F.unix_seconds("snapshot_at")
    hours = (seconds - F.min(seconds).over(Window.partitionBy("video_id"))) / F.lit(3600.0)
    slopes = (
        kept.withColumn("x", hours)
        .groupBy("video_id")
        .agg(F.coalesce(F.regr_slope(F.col("views").cast("double"), F.col("x")), F.lit(0.0)).alias("slope"))
    )
    return (
        v.select(F.col("id").alias("video_id"))
        .join(slopes, "video_id", "left")
        .withColumn("slope", F.coalesce("slope", F.lit(0.0)))
        .withColumn("stars", stars_from_slope(F.col("slope")))
    )


def delta_views(ms: DataFrame, *, as_of, hours: int = 24) -> DataFrame:
    """Views now minus views ``hours`` ago, per source. The older value lies on the line
    between its two neighbours; without an older neighbour the delta is unknown.

    Neighbours are three aggregates with partial results: nothing is sorted or windowed.
    """
    now = instant(as_of)
    edge = F.timestamp_add("HOUR", F.lit(-hours), now)
    point = F.struct(
        F.unix_millis("snapshot_at").alias("t"), F.col("views_native").alias("v")
    )
    order = F.struct("snapshot_at", "id")
    at_or_before = F.col("snapshot_at") <= edge
    found = (
        ms.filter(F.col("views_native").isNotNull() & (F.col("snapshot_at") <= now))
        .groupBy("source_video_id")
        .agg(
            F.max_by(point, order).alias("last"),
            F.max_by(F.when(at_or_before, point), F.when(at_or_before, order)).alias("older"),
            F.min_by(F.when(~at_or_before, point), F.when(~at_or_before, order)).alias("newer"),
        )
    )
    t = F.unix_millis(edge)
    weight = (t - F.col("older.t")) / (F.col("newer.t") - F.col("older.t"))
    at_edge = F.when(
        F.col("newer.t").isNotNull() & (F.col("older.t") < t),
        F.col("older.v") + weight * (F.col("newer.v") - F.col("older.v")),
    ).otherwise(F.col("older.v").cast("double"))
    delta = F.col("last.v") - at_edge
    return found.select(
        "source_video_id", F.col("last.v").alias("views_now"),
        F.when(F.col("older.t").isNotNull(), delta).alias("delta"),
        F.when(F.col("older.t").isNotNull(), ratio(delta, at_edge)).alias("growth"),
    )


def stars_from_delta(delta: Column, growth: Column, views_now: Column) -> Column:
    """F23. 300 / 100 views a day, 35 % and 20 % from 500 and 200 views,
    60 % and 30 % for videos of at most 100 views."""
    small = views_now <= 100
    two = (small & (growth >= 0.60)) | (
        ~small & ((delta >= 300) | ((views_now >= 500) & (growth >= 0.35)))
    )
    one = (small & (growth >= 0.30)) | (
        ~small & ((delta >= 100) | ((views_now >= 200) & (growth >= 0.20)))
    )
    return F.when(two, 2).when(one, 1).otherwise(0)


def video_stars(ms: DataFrame, sv: DataFrame, *, as_of, hours: int = 24) -> DataFrame:
    """stars of a video = the best of its sources; the shown delta is the largest one."""
    linked = sv.filter(F.col("video_id").isNotNull()).select(
        F.col("id").alias("source_video_id"), "video_id"
    )
    stars = stars_from_delta(F.col("delta"), F.col("growth"), F.col("views_now"))
    return (
        delta_views(ms, as_of=as_of, hours=hours)
        .withColumn("stars", stars)
        .join(linked, "source_video_id")
        .groupBy("video_id")
        .agg(F.max("delta").alias("delta"), F.max("growth").alias("growth"), F.max("stars").alias("stars"))
    )


def top_accelerating(
    ms: DataFrame, sv: DataFrame, *, as_of, hours: int = 24, min_views: int = 0, limit: int = 20, platform: str | None = None,
) -> DataFrame:
    """The sources that gained most in the window, of one platform or of all."""
    wanted = F.col("video_id").isNotNull()
    if platform is not None:
        wanted = wanted & (F.col("platform") == platform.strip().upper())
    linked = sv.filter(wanted).select(
        F.col("id").alias("source_video_id"), "video_id", "platform"
    )
    return (
        delta_views(ms, as_of=as_of, hours=hours)
        .filter(F.col("delta").isNotNull() & (F.col("views_now") >= min_views))
        .join(linked, "source_video_id")
        .orderBy(F.col("delta").desc(), "source_video_id")
        .limit(limit)
    )
