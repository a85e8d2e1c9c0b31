"""Curves aligned on the publication time: measured points, dense hourly curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vidmetrics.operators.spread import instant

MONTHS = 6
HORIZON = 720


def _since(as_of, months: int) -> Column:
    return F.timestamp_add("MONTH", F.lit(-months), instant(as_of))


def _eligible(sv: DataFrame, as_of, months: int) -> DataFrame:
    """P10, source side: active, linked, published inside the window."""
    return sv.filter(
        (F.col("is_active") == 1)
        & F.col("video_id").isNotNull()
        & F.col("published_at").isNotNull()
        & (F.col("published_at") >= _since(as_of, months))
    )


def eligible_pairs(sv: DataFrame, *, as_of, months: int = MONTHS) -> DataFrame:
    """One start per (video, platform): its earliest eligible publication."""
    return (
        _eligible(sv, as_of, months)
        .groupBy("video_id", F.col("platform").alias("source"))
        .agg(F.min("published_at").alias("t0"))
    )


def aligned_raw(
    ms: DataFrame, sv: DataFrame, *, as_of, months: int = MONTHS, granularity: str = "hour",
    views_col: str = "views_native",
) -> DataFrame:
    """A5: highest views per (video, platform, complete hours since publication)."""
    unit = "DAY" if granularity == "day" else "HOUR"
    sources = _eligible(sv, as_of, months).select(
        F.col("id").alias("source_video_id"), "video_id", F.col("platform").alias("source"),
        "published_at",
    ).join(eligible_pairs(sv, as_of=as_of, months=months), ["video_id", "source"])
    age = F.timestamp_diff(unit, F.col("t0"), F.col("snapshot_at")).cast("int")
    return (
        ms.select("source_video_id", "snapshot_at", F.col(views_col).alias("views"))
        .filter(F.col("views").isNotNull() & (F.col("snapshot_at") >= _since(as_of, months)))
        .join(sources, "source_video_id")
        .filter(F.col("snapshot_at") >= F.col("published_at"))
        .groupBy("video_id", "source", "t0", age.alias("age_bucket"))
        .agg(F.max("views").alias("views_cum"))
        .select(
            "video_id", "source", "age_bucket",
            F.timestamp_add(unit, F.col("age_bucket"), F.col("t0")).alias("bucket_ts"),
            "views_cum",
        )
    )


def aligned_dense(
    raw: DataFrame, sv: DataFrame, *, as_of, months: int = MONTHS, horizon: int = HORIZON,
    granularity: str = "hour", clip_to_observed: bool = False,
) -> DataFrame:
    """A value for every age 0..horizon of every eligible (video, platform).

    Every measured point writes the ages up to the next one: its own value, then the straight line.
    Ages before the first point are 0, ages after the last one keep its value. So the windows run on
    measured points only, the grid is produced by one ``explode`` behind them, and the pair key
    is shuffled once for the join and the windows together.
    """
    unit = "DAY" if granularity == "day" else "HOUR"
    known = raw.filter(F.col("age_bucket").between(0, horizon)).select(
        "video_id", "source", "age_bucket", "views_cum"
    )
    w = Window.partitionBy("video_id", "source").orderBy("age_bucket")
    points = (
        eligible_pairs(sv, as_of=as_of, months=months)
        .join(known, ["video_id", "source"], "left")
        .withColumns({
            "next_age": F.lead("age_bucket").over(w),
            "next_views": F.lead("views_cum").over(w),
            "place": F.row_number().over(w),
        })
    )
    start = F.when(F.col("place") == 1, F.lit(0)).otherwise(F.col("age_bucket"))
    open_end = F.coalesce(F.col("age_bucket"), F.lit(-1)) if clip_to_observed else F.lit(horizon)
    stop = F.coalesce(F.col("next_age") - 1, open_end)
    ages = F.when(stop >= start, F.sequence(start, F.greatest(start, stop)))
    line = F.col("views_cum") + (
        (F.col("age") - F.col("age_bucket")) * F.lit(1.0) / (F.col("next_age") - F.col("age_bucket"))
    ) * (F.col("next_views") - F.col("views_cum"))
    value = (
        F.when(F.col("age_bucket").isNull() | (F.col("age") < F.col("age_bucket")), F.lit(0.0))
        .when(F.col("next_age").isNull(), F.col("views_cum").cast("double"))
        .otherwise(line)
    )
    return points.select("*", F.explode(ages).alias("age")).select(
        "video_id", "source", F.lit(granularity).alias("granularity"),
        F.col("age").alias("age_bucket"),
        F.timestamp_add(unit, F.col("age"), F.col("t0")).alias("bucket_ts"),
        value.alias("views_cum"),
    )
