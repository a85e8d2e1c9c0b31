"""Refresh of what changed: derived tables kept in parts, of which a run rewrites those that hold a changed pair.

A pair is a (video, platform). Its curve depends on its own sources and points only, so a batch of points leaves all other
curves as they are. Tables lie in one folder per platform and part (a hash of the video); a run reads and
rewrites the folders of changed pairs, other folders are not opened. Bands rank all curves against each other
and are made anew from the dense table.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidmetrics.operators.align import MONTHS, aligned_dense, aligned_raw
from vidmetrics.operators.percentiles import percentile_bands
from vidmetrics.operators.rollup import video_rollup
from vidmetrics.operators.spread import instant
from vidmetrics.session import ensure_checkpoint_dir

PARTS = 64
_PLACES = ["source", "part"]
#: Shares of a folder that are written by tasks of their own.
_SHARES = 16
#: Columns of a source that decide to which curve it belongs and where the curve starts.
_BELONGS = ("video_id", "platform", "published_at", "is_active")


def _differing(old: DataFrame, new: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(_old, _new: structs of ``columns``) of the ids whose rows differ; a missing row is a null struct."""
    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select("id", F.struct(*columns).alias(name))

    return packed(old, "_old").join(packed(new, "_new"), "id", "full_outer").filter(~F.col("_old").eqNullSafe(F.col("_new")))


def changed_pairs(
    points: DataFrame, old_sv: DataFrame, sv: DataFrame, old_v: DataFrame, v: DataFrame, *, last_as_of, as_of, months: int = MONTHS,
) -> DataFrame:
    """(video_id, source): pairs whose derived rows may differ since the last run; source is null where only the video's own row changed.

    These are the pairs of sources that got or lost ``points``; of sources that were added, removed, linked anew, switched
    off or on, or published at another time, before and after; and of sources that left the time window
    between the two clocks.
    """
    of_points = points.select(F.col("source_video_id").alias("id")).distinct().join(sv, "id").select("video_id", "platform")
    moved = _differing(old_sv, sv, _BELONGS)
    first, last = (F.timestamp_add("MONTH", F.lit(-months), instant(t)) for t in (last_as_of, as_of))
    left = sv.filter((F.col("published_at") >= F.least(first, last)) & (F.col("published_at") < F.greatest(first, last)))
    pairs = (
        of_points.unionByName(moved.select("_old.video_id", "_old.platform")).unionByName(moved.select("_new.video_id", "_new.platform"))
        .unionByName(left.select("video_id", "platform")).withColumnRenamed("platform", "source")
    )
    videos = _differing(old_v, v, tuple(c for c in v.columns if c != "id"))
    return (
        pairs.unionByName(videos.select(F.col("id").alias("video_id"), F.lit(None).cast("string").alias("source")))
        .filter(F.col("video_id").isNotNull()).distinct()
    )


def _path(root: str, name: str) -> str:
    return f"{root}/{name}_parts"


def read_parts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table that is kept in parts; a row without a video marks a part that was written and may be empty."""
    return spark.read.parquet(_path(root, name)).filter(F.col("video_id").isNotNull()).drop("part")


def _write(rows: DataFrame, root: str, name: str, places: list[str], sort_by: list[str], *, whole: bool) -> None:
    # Videos of a folder are dealt to several tasks; a row without one goes with any.
    share = F.pmod(F.xxhash64("video_id", F.lit(1)), F.lit(_SHARES))
    writer = rows.repartition(*places, share).sortWithinPartitions(*places, *sort_by).write.mode("overwrite")
    if not whole:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*places).parquet(_path(root, name))


def _replace(fresh: DataFrame, keys: DataFrame, root: str, name: str, places: list[str], sort_by: list[str]) -> None:
    """Puts ``fresh`` in the place of the rows with ``keys``. Only folders of ``keys`` are read and written; the list that
    picks them has at most a platform times a part."""
    spark = keys.sparkSession
    touched = keys.select(*places).distinct()
    old = spark.read.parquet(_path(root, name))
    on = [c for c in keys.columns if c != "part"]
    by_source: dict[str | None, list[int]] = {}
    for place in touched.collect():
        by_source.setdefault(place.asDict().get("source"), []).append(place["part"])
    picked = F.lit(False)
    for source, numbers in by_source.items():
        here = F.col("part").isin(numbers)
        picked = picked | (here if source is None else here & (F.col("source") == source))
    kept = old.filter(picked & F.col("video_id").isNotNull()).join(keys.select(*on), on, "left_anti")
    marks = touched.select(*[
        (F.col(f.name) if f.name in places else F.lit(None)).cast(f.dataType).alias(f.name) for f in old.schema
    ])
    _write(kept.unionByName(fresh.select(*old.columns)).unionByName(marks), root, name, places, sort_by, whole=False)


def refresh_changed(
    ms: DataFrame, sv: DataFrame, v: DataFrame, root: str, *, as_of: datetime, changed: DataFrame | None = None, parts: int = PARTS,
    with_percentiles: bool = True,
) -> None:
    """M1 for a change set: rollup, aligned points, dense curves, bands at ``root``, equal to a full refresh.

    ``changed`` (video_id, source) comes from ``changed_pairs``; without it all tables are made whole, as on the first run.
    A repeated run gives the same tables. Points of changed sources are found by a filter, the point table is not shuffled whole.
    """
    spark = ms.sparkSession
    ensure_checkpoint_dir(spark)
    part = F.pmod(F.xxhash64("video_id"), F.lit(parts)).cast("int").alias("part")
    curve, video = ["video_id", "age_bucket"], ["video_id"]
    if changed is None:
        _write(video_rollup(ms, sv, v, as_table=True).select("*", part), root, "video_rollup", ["part"], video, whole=True)
        _write(aligned_raw(ms, sv, as_of=as_of).select("*", part), root, "aligned_raw_hour", _PLACES, curve, whole=True)
        raw = read_parts(spark, root, "aligned_raw_hour")
        _write(aligned_dense(raw, sv, as_of=as_of).select("*", part), root, "aligned_dense_hour", _PLACES, curve, whole=True)
    else:
        every = changed.select("video_id", "source", part).checkpoint()
        pairs = every.filter(F.col("source").isNotNull())
        videos = every.select("video_id", "part").distinct()
        of_videos = sv.join(videos.select("video_id"), "video_id", "left_semi")
        of_pairs = sv.join(
            pairs.select("video_id", F.col("source").alias("platform")), ["video_id", "platform"], "left_semi"
        )
        touched_points = ms.join(of_videos.select(F.col("id").alias("source_video_id")), "source_video_id", "left_semi")
        some = v.join(videos.select(F.col("video_id").alias("id")), "id", "left_semi")
        rollup = video_rollup(touched_points, of_videos, some, as_table=True).select("*", part)
        _replace(rollup, videos, root, "video_rollup", ["part"], video)
        _replace(aligned_raw(touched_points, of_pairs, as_of=as_of).select("*", part), pairs, root, "aligned_raw_hour", _PLACES, curve)
        raw = read_parts(spark, root, "aligned_raw_hour").join(pairs.select("video_id", "source"), ["video_id", "source"], "left_semi")
        _replace(aligned_dense(raw, of_pairs, as_of=as_of).select("*", part), pairs, root, "aligned_dense_hour", _PLACES, curve)
    if with_percentiles:
        bands = percentile_bands(read_parts(spark, root, "aligned_dense_hour"), as_of=as_of)
        bands.write.mode("overwrite").parquet(f"{root}/bands_hour")
