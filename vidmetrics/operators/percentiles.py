"""Exact discrete percentiles of large groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vidmetrics.operators.spread import instant
from vidmetrics.session import ensure_checkpoint_dir

BANDS = (10, 25, 50, 75, 90)
_SLOTS_PER_E = 32
#: A slot that holds a rank and has more rows is cut into parts of equal width.
CROWDED, _PARTS = 100_000, 1024


def discrete_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int] = BANDS, *, crowded: int = CROWDED,
) -> DataFrame:
    """``p<k>`` = the value at rank ``ceil(n * k / 100)`` of each group with known keys, and ``n``.

    A group may hold every video of a platform, so it is never sorted in one task. The value axis is cut into slots
    by an increasing function; slot totals (at most a few thousand per group, summed by task before the shuffle) tell which
    slot holds each rank. Only rows of these slots, one per percent at most, are shuffled by value: equal values are
    counted, and the values of a slot are ordered. A slot of more than ``crowded`` rows is cut again between its own least
    and greatest value; counts per part tell which part holds the rank, and only the values of that part are ordered. The
    result is exact. The slots that hold ranks are broadcast: a row per group and percent, for groups like (platform, age).
    """
    keys = list(keys)
    ensure_checkpoint_dir(df.sparkSession)
    slot = F.floor(
        F.signum(value) * F.log1p(F.abs(F.col(value).cast("double"))) * F.lit(_SLOTS_PER_E)
    )
    rows = df.select(*keys, slot.alias("_slot"), F.col(value).alias("_value")).filter(
        " and ".join(f"{c} is not null" for c in [*keys, "_slot", "_value"])
    )
    by_slot = Window.partitionBy(*keys).orderBy("_slot")
    slots = (
        rows.groupBy(*keys, "_slot").agg(F.count("*").alias("_slot_n"), F.min("_value").alias("_low"), F.max("_value").alias("_high"))
        .withColumn(
            "_below",
            F.coalesce(F.sum("_slot_n").over(by_slot.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .withColumn("_total", F.sum("_slot_n").over(Window.partitionBy(*keys)))
    )
    # Integer ranks: a floating n * p may fall on the wrong side of a whole number.
    ranks = [F.expr(f"(_total * {p} + 99) div 100 - _below") for p in percents]
    hit = [
        F.when((r >= 1) & (r <= F.col("_slot_n")), r).alias(f"_r{p}") for p, r in zip(percents, ranks)
    ]
    targets = slots.select(
        *[F.col(k) for k in keys], "_slot", "_total", "_low", "_high", "_slot_n", *hit
    ).filter(F.coalesce(*[F.col(f"_r{p}") for p in percents]).isNotNull()).checkpoint()
    slot_of = [*keys, "_slot"]
    part_of = [*slot_of, "_part"]
    one_part = (F.col("_slot_n") <= crowded) | (F.col("_low") == F.col("_high"))
    far, wide = (F.col(c).cast("double") - F.col("_low").cast("double") for c in ("_value", "_high"))
    place = F.coalesce(F.try_divide(far, wide), F.lit(0.0))
    part = F.when(one_part, F.lit(0).cast("long")).otherwise(F.floor(place * _PARTS))

    def counts(some: DataFrame) -> DataFrame:
        met = rows.join(F.broadcast(some.select(*slot_of, "_low", "_high", "_slot_n")), slot_of)
        return met.select(*slot_of, part.alias("_part"), "_value").groupBy(*part_of, "_value").agg(F.count("*").alias("_n"))

    found = targets.filter(one_part).select(*slot_of, F.lit(0).cast("long").alias("_part"), "_total", *[F.col(f"_r{p}").alias(f"_i{p}") for p in percents])
    wide_ones = targets.filter(~one_part)
    if not wide_ones.isEmpty():  # their rows are counted by part first
        parts = counts(wide_ones).groupBy(*part_of).agg(F.sum("_n").alias("_part_n")).withColumn("_under", _running("_part_n", slot_of, "_part") - F.col("_part_n"))
        inner = [F.col(f"_r{p}") - F.col("_under") for p in percents]
        found = found.unionByName(parts.join(F.broadcast(wide_ones), slot_of).select(
            *part_of, "_total", *[F.when((x >= 1) & (x <= F.col("_part_n")), x).alias(f"_i{p}") for p, x in zip(percents, inner)]
        ).filter(F.coalesce(*[F.col(f"_i{p}") for p in percents]).isNotNull()))
    counted = counts(targets)
    ordered = counted.join(F.broadcast(found), part_of).withColumn("_upto", _running("_n", part_of, "_value"))
    return ordered.groupBy(*keys).agg(
        *[F.min(F.when(F.col("_upto") >= F.col(f"_i{p}"), F.col("_value"))).alias(f"p{p}") for p in percents], F.max("_total").alias("n"),
    )


def _running(value: str, keys: Sequence[str], order: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def percentile_bands(dense: DataFrame, *, as_of, percents: Sequence[int] = BANDS) -> DataFrame:
    """Percentile bands of the dense curves per (platform, granularity, age)."""
    found = discrete_percentiles(dense, ["source", "granularity", "age_bucket"], "views_cum", percents)
    return found.select(
        "source", "granularity", "age_bucket",
        *[F.col(f"p{p}").alias(f"p{p}_views") for p in percents],
        F.col("n").alias("count_videos"), instant(as_of).alias("updated_at"),
    )


def baseline_median(
    dense: DataFrame, sv: DataFrame, *, as_of, window_days: int | None = None
) -> DataFrame:
    """Median curve per platform, over all videos or those published in the last days."""
    curves = dense
    if window_days is not None:
        recent = sv.filter(
            F.col("published_at") >= F.timestamp_add("DAY", F.lit(-window_days), instant(as_of))
        ).select("video_id", F.col("platform").alias("source")).distinct()
        curves = dense.join(recent, ["video_id", "source"], "left_semi")
    found = discrete_percentiles(curves, ["source", "granularity", "age_bucket"], "views_cum", (50,))
    return found.select(
        "source", "granularity", "age_bucket", F.col("p50").alias("median_views"),
        F.col("n").alias("count_videos"),
    )


def curves_with_baseline(
    dense: DataFrame, baseline: DataFrame, *, video_ids: Sequence[int] | None = None
) -> DataFrame:
    """Q8, comparator: curves aligned on publication beside the median of their platform.

    The baseline has one row per (platform, age); whether it is broadcast is left to its measured size.
    """
    curves = dense if video_ids is None else dense.filter(F.col("video_id").isin(list(video_ids)))
    medians = baseline.select("source", "granularity", "age_bucket", "median_views")
    return curves.join(medians, ["source", "granularity", "age_bucket"], "left").select(
        "video_id", "source", "granularity", "age_bucket", "views_cum", "median_views"
    )
