"""Gaps, anomalies, clean-up, retention and milestones of stored points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmetrics.operators.spread import first_rows, instant, with_previous, with_running_max


def gaps(ms: DataFrame, *, hours: int = 3) -> DataFrame:
    """Points that follow the previous one of their source by more than ``hours``."""
    rows = ms.select("id", "source_video_id", "snapshot_at")
    seconds = F.unix_seconds("snapshot_at") - F.unix_seconds("prev_snapshot_at")
    return (
        with_previous(rows, "source_video_id", "snapshot_at", "id", ["snapshot_at"])
        .withColumn("gap_seconds", seconds)
        .filter(F.col("gap_seconds") > hours * 3600)
    )


def regressions(ms: DataFrame) -> DataFrame:
    """Known views lower than the previous known views of the source."""
    known = ms.filter(F.col("views_native").isNotNull()).select(
        "id", "source_video_id", "snapshot_at", "views_native"
    )
    return with_previous(known, "source_video_id", "snapshot_at", "id", ["views_native"]).filter(
        F.col("views_native") < F.col("prev_views_native")
    )


def suspicious_zeros(ms: DataFrame) -> DataFrame:
    """Zero views after a positive value of the same source: a proven anomaly."""
    known = ms.filter(F.col("views_native").isNotNull()).select(
        "id", "source_video_id", "snapshot_at", "views_native"
    )
    return with_running_max(known, "source_video_id", "snapshot_at", "id", "views_native", "top_before").filter(
        (F.col("views_native") == 0) & (F.col("top_before") > 0)
    )


def anomalies(ms: DataFrame, sv: DataFrame) -> DataFrame:
    """M3: every finding as (kind, source_video_id, snapshot_id)."""
    def found(kind: str, df: DataFrame, source: str, snapshot: str | None) -> DataFrame:
        point = F.col(snapshot) if snapshot else F.lit(None).cast("long")
        return df.select(F.lit(kind).alias("kind"), F.col(source).alias("source_video_id"), point.alias("snapshot_id"))

    twice = ms.groupBy("source_video_id", "snapshot_at").agg(
        F.count("*").alias("n"), F.max("id").alias("id")
    ).filter("n > 1")
    unmeasured = sv.join(
        ms.select(F.col("source_video_id").alias("id")).distinct(), "id", "left_anti"
    )
    return (
        found("regression", regressions(ms), "source_video_id", "id")
        .unionByName(found("suspicious_zero", suspicious_zeros(ms), "source_video_id", "id"))
        .unionByName(found("orphan_source", sv.filter(F.col("video_id").isNull()), "id", None))
        .unionByName(found("duplicate_point", twice, "source_video_id", "id"))
        .unionByName(found("source_without_metrics", unmeasured, "id", None))
    )


def cleaned(ms: DataFrame) -> DataFrame:
    """M4: proven zeros become unknown; everything else is kept as it is."""
    wrong = suspicious_zeros(ms).select("id", F.lit(True).alias("_wrong"))
    views = F.when(F.col("_wrong").isNull(), F.col("views_native"))
    return ms.join(wrong, "id", "left").withColumn("views_native", views).select(*ms.columns)


def retained(ms: DataFrame, *, as_of, recent_days: int = 30, daily_days: int = 180) -> DataFrame:
    """M5: every recent point, then the last one of each day, then of each week, per source."""
    age = F.timestamp_diff("DAY", F.col("snapshot_at"), instant(as_of))
    aged = ms.withColumn("_age", age)
    recent = aged.filter(F.col("_age") < recent_days)
    older = aged.filter(F.col("_age") >= recent_days).withColumn(
        "_period",
        F.when(F.col("_age") < daily_days, F.date_format("snapshot_at", "'d'yyyy-MM-dd"))
        .otherwise(F.concat(F.lit("w"), F.date_format(F.date_trunc("week", "snapshot_at"), "yyyy-MM-dd"))),
    )
    last = first_rows(
        older, ["source_video_id", "_period"], [F.col("snapshot_at").desc(), F.col("id").desc()]
    )
    return recent.select(*ms.columns).unionByName(last.select(*ms.columns))


def milestones(ms: DataFrame, *, step: int = 1000) -> DataFrame:
    """M6: points at which a source passes a multiple of ``step`` views."""
    known = ms.filter(F.col("views_native").isNotNull()).select(
        "id", "source_video_id", "snapshot_at", "views_native"
    )
    now = F.floor(F.col("views_native") / step)
    before = F.coalesce(F.floor(F.col("prev_views_native") / step), F.lit(0))
    return (
        with_previous(known, "source_video_id", "snapshot_at", "id", ["views_native"])
        .filter(now > before)
        .withColumn("milestone", (now * step).cast("long"))
    )


def stale_sources(ms: DataFrame, sv: DataFrame, *, as_of, hours: int = 24) -> DataFrame:
    """M6: active sources without a point for ``hours``, or without any."""
    last = ms.groupBy(F.col("source_video_id").alias("id")).agg(F.max("snapshot_at").alias("last_snapshot_at"))
    edge = F.timestamp_add("HOUR", F.lit(-hours), instant(as_of))
    return (
        sv.filter(F.col("is_active") == 1).select("id", "platform").join(last, "id", "left")
        .filter(F.col("last_snapshot_at").isNull() | (F.col("last_snapshot_at") < edge))
        .withColumnRenamed("id", "source_video_id")
    )
