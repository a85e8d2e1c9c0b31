"""The stored tables: reading, keyed upserts, replace-writes, CSV export.

Plain Parquet has no MERGE. An upsert returns the new state of the table; ``replace_table`` writes
it next to the old version, which readers keep using until the new one is announced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidmetrics.operators.spread import first_rows, numbered

SOURCE_KEY = ("platform", "platform_video_id")
# Columns of a source that an upsert overwrites, unknown values included.
SOURCE_FIELDS = (
    "platform_format", "platform_channel_id", "title", "description", "url", "etag", "published_at",
    "duration_seconds",
)


# ---- reading and writing ---------------------------------------------------

def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current version of a stored table, the one that was announced last."""
    found = _announced(spark, root, name)
    if found is None:
        raise ValueError(f"{name} has no version yet")
    return spark.read.parquet(f"{root}/{name}/{found[1]}")


def _announced(spark: SparkSession, root: str, name: str) -> tuple[int, str] | None:
    """(number of the announcement, version) of the last one: lines are ``number<TAB>version``."""
    parts = F.split("value", "\t", 2)
    lines = spark.read.text(f"{root}/{name}/_versions").select(parts[0].cast("long").alias("number"), parts[1].alias("version"))
    last = lines.orderBy(F.col("number").desc(), F.col("version").desc()).first()
    return None if last is None else (last["number"], last["version"])


def replace_table(
    df: DataFrame, root: str, name: str, version: str, partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
) -> str:
    """Full overwrite. A version is announced only after its folder is complete, so readers see
    the old or the new table, and a repeated write of one version gives the same table. The version
    announced last is the current one, whatever its name; tables have one writer at a time."""
    spark = df.sparkSession
    rows = df.sortWithinPartitions(*partition_by, *sort_by) if sort_by else df
    writer = rows.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    path = f"{root}/{name}/{version}"
    writer.parquet(path)
    try:
        last = _announced(spark, root, name)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    line = f"{last[0] + 1 if last else 1}\t{version}"
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(
        f"{root}/{name}/_versions"
    )
    return path


def export_csv(df: DataFrame, path: str) -> None:
    """S18."""
    df.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSS").csv(path)


# ---- keyed upserts ---------------------------------------------------------

def upsert_sources(sv: DataFrame, updates: DataFrame) -> DataFrame:
    """Sources after a batch, with ``change`` = inserted, updated, unchanged or kept.

    The last update per (platform, platform id) overwrites every descriptive column, unknown values
    included, and reactivates the source; the link to a video stays. New sources are numbered in
    the order of their first arrival. Every key is unique on both sides before the join.
    """
    fields = [c for c in SOURCE_FIELDS if c in updates.columns and c in sv.columns]
    firsts = updates.groupBy(*SOURCE_KEY).agg(F.min("arrival_seq").alias("_first_seq"))
    last = first_rows(
        updates.select(*SOURCE_KEY, "arrival_seq", *fields), list(SOURCE_KEY), [F.col("arrival_seq").desc()]
    ).join(firsts, list(SOURCE_KEY))
    incoming = last.select(*SOURCE_KEY, "_first_seq", F.struct(*fields).alias("_new"))
    joined = sv.withColumn("_old", F.struct(*fields, F.lit(1).alias("is_active"))).join(
        incoming, list(SOURCE_KEY), "full_outer"
    )
    hit = F.col("_new").isNotNull()
    same = F.col("_old").dropFields("is_active").eqNullSafe(F.col("_new")) & (F.col("is_active") == 1)
    merged = joined.withColumns({
        **{c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in fields},
        "change": F.when(F.col("id").isNull(), "inserted").when(~hit, "kept").when(same, "unchanged").otherwise("updated"),
        "is_active": F.when(hit, F.lit(1)).otherwise(F.col("is_active")),
    })
    top = sv.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = numbered(merged.filter(F.col("change") == "inserted"), "_first_seq", int(top), "_id")
    columns = [*sv.columns, "change"]
    return merged.filter(F.col("change") != "inserted").select(*columns).unionByName(
        fresh.withColumn("id", F.col("_id")).select(*columns)
    )


def change_report(upserted: DataFrame) -> DataFrame:
    return upserted.filter(F.col("change") != "kept").groupBy("change").agg(F.count("*").alias("sources"))


def upsert_snapshots(ms: DataFrame, stored: DataFrame) -> DataFrame:
    """Points after a batch; of one (source, instant) the last arrival wins, keeping its id.

    The table has one point per (source, instant). It is only filtered by the keys of the batch, once for the points that
    stay and once for those that are replaced; where the keys are few, as measured, it is not shuffled at all.
    """
    start = ms.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fields = [c for c in stored.columns if c in ms.columns and c != "id"]
    keys = ["source_video_id", "snapshot_at"]
    winners = first_rows(stored.select(*fields, "arrival_seq"), keys, [F.col("arrival_seq").desc()])
    touched = stored.select(*keys).distinct()
    stay = ms.select("id", *fields).join(touched, keys, "left_anti")
    ids = ms.select(*keys, "id").join(touched, keys, "left_semi").groupBy(*keys).agg(F.max("id").alias("_kept_id"))
    placed = winners.join(ids, keys, "left")
    known = placed.filter(F.col("_kept_id").isNotNull()).withColumn("id", F.col("_kept_id"))
    fresh = numbered(placed.filter(F.col("_kept_id").isNull()), "arrival_seq", int(start), "id")
    return stay.select("id", *fields).unionByName(known.select("id", *fields)).unionByName(fresh.select("id", *fields))


def merge_points(spark: SparkSession, path: str, stored: DataFrame, *, files_per_day: int = 32) -> None:
    """S14 on a point table kept in one folder per day: only the days of the batch are read and
    rewritten, whatever the size of the table. Points are named by their key, so no id is looked up. A
    day is written by up to ``files_per_day`` tasks, each with its share of the sources.

    The days of a batch are few (late rows are dropped per source), so they are listed for pruning.
    """
    keys = ["source_video_id", "snapshot_at"]
    incoming = stored.withColumn("day", F.to_date("snapshot_at"))
    fields = [c for c in incoming.columns if c not in ("id", "arrival_seq")]
    rows = incoming.select(*fields, "arrival_seq")
    try:
        current = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        days = [r[0] for r in incoming.select("day").distinct().collect()]
        old = current.filter(F.col("day").isin(days)).select(*fields, F.lit(-1).cast("long").alias("arrival_seq"))
        rows = old.unionByName(rows)
    merged = first_rows(rows, keys, [F.col("arrival_seq").desc()]).drop("arrival_seq")
    (
        merged.withColumn("id", F.xxhash64(*keys))
        .repartition("day", F.pmod(F.xxhash64("source_video_id"), F.lit(files_per_day)))
        .sortWithinPartitions("day", *keys).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    )


def read_points(spark: SparkSession, path: str, *, start=None, end=None) -> DataFrame:
    """Points of a day-wise table in a closed range; the range also picks the day folders."""
    points = spark.read.parquet(path)
    if start is not None:
        since = F.lit(start).cast("timestamp")
        points = points.filter((F.col("day") >= F.to_date(since)) & (F.col("snapshot_at") >= since))
    if end is not None:
        until = F.lit(end).cast("timestamp")
        points = points.filter((F.col("day") <= F.to_date(until)) & (F.col("snapshot_at") <= until))
    return points


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, sort_by: Sequence[str] = ()) -> None:
    """Saves a table bucketed on ``key``: later groupings and joins on the key need no shuffle."""
    rows = df.repartition(buckets, key)
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *sort_by).saveAsTable(table)


def dedup_latest(items: DataFrame) -> DataFrame:
    """Of items with the same platform, source (or platform id) and instant, the last arrival."""
    platform_id = F.concat_ws(":", F.coalesce("platform", F.lit("null")), F.coalesce("platform_video_id", F.lit("null")))
    source = (
        F.coalesce(F.col("source_video_id").cast("string"), platform_id)
        if "source_video_id" in items.columns else platform_id
    )
    keyed = items.withColumns({"_platform": F.coalesce("platform", F.lit("")), "_source": source})
    return first_rows(keyed, ["_platform", "_source", "snapshot_at"], [F.col("arrival_seq").desc()]).drop(
        "_platform", "_source"
    )


def create_minimal_sources(sv: DataFrame, items: DataFrame) -> DataFrame:
    """Rows for platform ids no source has, numbered in arrival order; the first format an item reports."""
    unknown = items.join(sv.select(*SOURCE_KEY), list(SOURCE_KEY), "left_anti")
    firsts = unknown.groupBy(*SOURCE_KEY).agg(
        F.min("arrival_seq").alias("_seq"), F.min_by("platform_format", F.when(F.col("platform_format").isNotNull(), F.col("arrival_seq"))).alias("platform_format"),
    )
    top = sv.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return numbered(firsts, "_seq", int(top), "id").select(
        "id", F.lit(None).cast("long").alias("video_id"), *SOURCE_KEY, "platform_format", F.lit(1).alias("is_active")
    )


def fill_formats(sv: DataFrame, items: DataFrame) -> DataFrame:
    """Sources without a format take the first one an item reports."""
    reported = items.filter(F.col("platform_format").isNotNull()).groupBy(*SOURCE_KEY).agg(
        F.min_by("platform_format", "arrival_seq").alias("_format")
    )
    return (
        sv.join(reported, list(SOURCE_KEY), "left")
        .withColumn("platform_format", F.coalesce("platform_format", "_format")).select(*sv.columns)
    )


def resolve_items(items: DataFrame, sv: DataFrame) -> DataFrame:
    """Metric items with the id of their source."""
    ids = sv.select(*SOURCE_KEY, F.col("id").alias("source_video_id"))
    return items.drop("source_video_id").join(ids, list(SOURCE_KEY))


def missing_sources(requested: DataFrame, sv: DataFrame) -> DataFrame:
    """Requested ids no source has; order column and repeats of the request are kept."""
    return requested.filter(F.col("platform_video_id") != "").join(
        sv.select(*SOURCE_KEY), list(SOURCE_KEY), "left_anti"
    )
