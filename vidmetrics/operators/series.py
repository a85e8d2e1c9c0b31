"""Hourly and daily series per video and platform, and what is drawn from them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vidmetrics.operators.spread import instant

# fixed values: metrics a series may show
METRICS = ("views_native", "likes", "comments", "shares", "total_watch_seconds")


def range_start(range_text: str | None, published_at: Column, as_of) -> Column:
    """``Nh`` / ``Nd`` before the clock; ``all`` since publication; otherwise seven days."""
    now = instant(as_of)
    week = F.timestamp_add("DAY", F.lit(-7), now)
    text = (range_text or "").strip().lower()
    if text in ("", "all", "full"):
        return F.coalesce(published_at, week)
    relative = re.fullmatch(r"(\d+)([hd])", text)
    if not relative:
        return week
    unit = "HOUR" if relative[2] == "h" else "DAY"
    return F.timestamp_add(unit, F.lit(-int(relative[1])), now)


def bucket_series(
    ms: DataFrame, sv: DataFrame, v: DataFrame, *, as_of, metric: str = "views_native",
    interval: str = "hour", range_text: str = "all", platforms: Sequence[str] | None = None,
) -> DataFrame:
    """Highest value per (video, platform, hour or day); an unknown value counts as 0.

    Both bounds are inclusive (P6). The source side carries the bounds, so snapshots meet one
    narrow row per source and are reduced by a partial maximum before the second shuffle.
    """
    metric = metric if metric in METRICS else "views_native"
    interval = "day" if interval == "day" else "hour"
    sources = sv.filter(F.col("video_id").isNotNull())
    if platforms:
        sources = sources.filter(F.col("platform").isin([p.strip().upper() for p in platforms]))
    bounds = sources.select(
        F.col("id").alias("source_video_id"), "video_id", "platform"
    ).join(
        v.select(
            F.col("id").alias("video_id"),
            range_start(range_text, F.col("published_at"), as_of).alias("from_at"),
        ),
        "video_id",
    )
    return (
        ms.select("source_video_id", "snapshot_at", F.col(metric).alias("value"))
        .filter(F.col("snapshot_at") <= instant(as_of))
        .join(bounds, "source_video_id")
        .filter(F.col("snapshot_at") >= F.col("from_at"))
        .groupBy("video_id", "platform", F.date_trunc(interval, "snapshot_at").alias("ts"))
        .agg(F.max(F.coalesce(F.col("value"), F.lit(0)).cast("long")).alias("value"))
    )


def global_series(series: DataFrame) -> DataFrame:
    """Per video and bucket, the sum of the platform maxima."""
    return series.groupBy("video_id", "ts").agg(F.sum("value").alias("value"))


# The windows below run on series: one row per key and hour (or day), whatever the number of
# snapshots behind it, so a partition is bounded by the calendar.


def cumsum(series: DataFrame, keys: Sequence[str] = ("video_id", "platform")) -> DataFrame:
    """Running total in time order."""
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("value", F.sum("value").over(w))


def downsample(
    series: DataFrame, limit: int, keys: Sequence[str] = ("video_id", "platform")
) -> DataFrame:
    """Every ``ceil(n / limit)``-th point, and always the last one."""
    if limit <= 0:
        return series
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("ts"))
    size = F.count("*").over(Window.partitionBy(*keys))
    step = F.greatest(F.lit(1), F.ceil(F.col("_size") / F.lit(limit)))
    kept = ((F.col("_place") - 1) % step == 0) | (F.col("_place") == F.col("_size"))
    return (
        series.withColumn("_place", place).withColumn("_size", size)
        .filter(kept).drop("_place", "_size")
    )


def non_monotonic(series: DataFrame, keys: Sequence[str] = ("video_id", "platform")) -> DataFrame:
    """The first point of each series that is lower than the point before it."""
    w = Window.partitionBy(*keys).orderBy("ts")
    drops = series.withColumn("prev_value", F.lag("value").over(w)).filter(
        F.col("value") < F.col("prev_value")
    )
    return (
        drops.groupBy(*keys)
        .agg(F.min_by(F.struct("ts", "prev_value", "value"), F.col("ts")).alias("_first"))
        .select(*keys, "_first.*")
    )


def last_buckets(series: DataFrame, v: DataFrame, granularity: str = "hour") -> DataFrame:
    """age of the last measured bucket per (video, platform), with the truncated start."""
    unit = "DAY" if granularity == "day" else "HOUR"
    starts = v.filter(F.col("published_at").isNotNull()).select(
        F.col("id").alias("video_id"), F.date_trunc(unit, "published_at").alias("t0")
    )
    last = series.groupBy("video_id", "platform").agg(F.max("ts").alias("last_ts"))
    age = F.timestamp_diff(unit, F.col("t0"), F.date_trunc(unit, "last_ts"))
    if granularity != "day":
        age = F.floor((F.unix_seconds("last_ts") - F.unix_seconds("t0")) / 3600)
    return last.join(starts, "video_id").select(
        "video_id", "platform", "t0", F.greatest(F.lit(0), age).cast("int").alias("max_bucket")
    )


def clip_bands(
    bands: DataFrame, series: DataFrame, v: DataFrame, *, granularity: str = "hour", horizon: int = 720
) -> DataFrame:
    """The bands of a platform placed on the calendar of every video that has it,
    up to its last measured bucket. Band values are cut to whole numbers.

    ``bands`` has one row per (platform, age <= horizon): a few thousand rows whatever the data,
    hence the broadcast. Ages are generated per series instead of a range join on the bands; the few bytes
    of the series are spread first, else adaptive execution would make all their ages in one task.
    """
    unit = "DAY" if granularity == "day" else "HOUR"
    small = _small_bands(bands, granularity, horizon)
    ages = F.sequence(F.lit(0), F.least(F.col("max_bucket"), F.lit(horizon)))
    spark = series.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    grid = last_buckets(series, v, granularity).repartition(tasks, "video_id", "platform").select(
        "video_id", F.col("platform").alias("source"), "t0", F.explode(ages).alias("age_bucket")
    )
    return grid.join(F.broadcast(small), ["source", "age_bucket"]).select(
        "video_id", "source", "age_bucket",
        F.timestamp_add(unit, F.col("age_bucket"), F.col("t0")).alias("ts"),
        *_band_columns(small), "count_videos",
    )


def _small_bands(bands: DataFrame, granularity: str, horizon: int) -> DataFrame:
    quantiles = [c for c in bands.columns if re.fullmatch(r"p\d+_views", c)]
    return bands.filter((F.col("granularity") == granularity) & F.col("age_bucket").between(0, horizon)).select(
        "source", "age_bucket", "count_videos",
        *[F.col(c).cast("long").alias(c.removesuffix("_views")) for c in quantiles],
    )


def _band_columns(clipped: DataFrame) -> list[str]:
    return [c for c in clipped.columns if re.fullmatch(r"p\d+", c)]


def carry_bands(
    series: DataFrame, bands: DataFrame, v: DataFrame, *, granularity: str = "hour", horizon: int = 720
) -> DataFrame:
    """One band value per point of the series, the last known one, 0 before the first; only series
    that have a band at all. A point meets the band of its own age, so no calendar grid is built."""
    unit = "DAY" if granularity == "day" else "HOUR"
    small = _small_bands(bands, granularity, horizon)
    names = _band_columns(small)
    starts = v.filter(F.col("published_at").isNotNull()).select(
        F.col("id").alias("video_id"), F.date_trunc(unit, "published_at").alias("t0")
    )
    age = F.timestamp_diff(unit, F.col("t0"), F.col("ts"))
    own = F.when(F.timestamp_add(unit, age, F.col("t0")) == F.col("ts"), age).cast("int")
    whole = Window.partitionBy("video_id", "platform")
    upto = whole.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    youngest = small.groupBy("source").agg(F.min("age_bucket").alias("_youngest")).withColumnRenamed("source", "platform")
    points = series.join(starts, "video_id").select("video_id", "platform", "ts", "value", own.alias("age_bucket"), age.alias("_age"))
    return (
        points.join(F.broadcast(youngest), "platform")
        .join(F.broadcast(small.withColumnRenamed("source", "platform")), ["platform", "age_bucket"], "left")
        .withColumn("_oldest", F.greatest(F.lit(0), F.max("_age").over(whole)))
        .withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.lit(0)) for c in names})
        .filter("_youngest <= _oldest").select("video_id", "platform", "ts", "value", *names)
    )


def exact_bands(series: DataFrame, clipped: DataFrame) -> DataFrame:
    """The points of the series that have a band value at the same instant."""
    bands = clipped.select(
        "video_id", F.col("source").alias("platform"), "ts", *_band_columns(clipped)
    )
    return series.join(bands, ["video_id", "platform", "ts"])


def as_chart(series: DataFrame, keys: Sequence[str] = ("video_id", "platform")) -> DataFrame:
    """The edge form of a series: one array of (epoch ms, value) per key."""
    point = F.struct(F.unix_millis("ts").alias("ts"), F.col("value"))
    return series.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("points"))


# ---- series sent by other tools --------------------------------------------

# fixed values: where such series keep their points, times and values, in order of preference
_WRAPPERS = ("series", "data", "points", "values", "views")
_TIME_KEYS = ("time", "timestamp", "date", "t", "x", "ts")
_VALUE_KEYS = ("views_native", "views", "value", "v", "val", "y", "sum", "count")
_SECONDS_BELOW = 1e12


def _epoch_ms(text: Column) -> Column:
    number = F.trim(text).try_cast("double")
    from_number = F.when(number < _SECONDS_BELOW, number * 1000).otherwise(number)
    return F.coalesce(F.floor(from_number + 0.5).cast("long"), F.unix_millis(F.try_to_timestamp(text)))


def _finite(text: Column) -> Column:
    number = F.trim(text).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def parse_series(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, ts_ms, value) from JSON series of unlike shapes: arrays of pairs or of objects, the
    same inside a wrapper object, or an object from time to value. Times below 1e12 are seconds; of
    several values at one time the last one counts."""
    whole = F.try_parse_json(body)

    def text_at(value: Column, path: str) -> Column:
        return F.try_variant_get(value, path, "string")

    def first_of(value: Column, names: Sequence[str], read) -> Column:
        return F.coalesce(*[read(text_at(value, f"$.{n}")) for n in names])

    def any_number(text: Column) -> Column:
        """The first numeric field as the text has them; a variant would sort its fields by name."""
        numbers = F.transform(F.map_values(F.from_json(text, "map<string,string>")), _finite)
        return F.try_element_at(F.array_compact(numbers), F.lit(1))

    parsed = df.select(key, F.col(body).alias("body"), whole.alias("whole")).filter(F.col("whole").isNotNull())
    value, item, text = F.col("whole"), F.col("item"), F.try_element_at("texts", F.col("pos") + 1)
    wrapped = [(F.try_variant_get(value, f"$.{w}", "array<variant>"), F.get_json_object("body", f"$.{w}")) for w in _WRAPPERS]
    points = F.coalesce(value.try_cast("array<variant>"), *[points for points, _ in wrapped])
    texts = F.coalesce(
        F.when(value.try_cast("array<variant>").isNotNull(), F.col("body")),
        *[F.when(points.isNotNull(), body_text) for points, body_text in wrapped],
    )
    parsed = parsed.withColumns({"points": points, "texts": F.from_json(texts, "array<string>")})
    listed = parsed.filter(F.col("points").isNotNull()).select(key, "texts", F.posexplode("points").alias("pos", "item")).select(
        key, "pos",
        F.coalesce(_epoch_ms(text_at(item, "$[0]")), first_of(item, _TIME_KEYS, _epoch_ms)).alias("ts_ms"),
        F.coalesce(
            _finite(text_at(item, "$[1]")), first_of(item, _VALUE_KEYS, _finite), any_number(text)
        ).alias("value"),
    )
    entries = F.map_entries(F.from_json("body", "map<string,string>"))
    keyed = parsed.filter(F.col("points").isNull()).select(key, F.posexplode(entries).alias("pos", "e")).select(
        key, "pos", _epoch_ms(F.col("e.key")).alias("ts_ms"),
        F.coalesce(
            _finite(F.col("e.value")), first_of(F.try_parse_json(F.col("e.value")), _VALUE_KEYS, _finite), any_number(F.col("e.value")),
        ).alias("value"),
    )
    return (
        listed.unionByName(keyed).filter(F.col("ts_ms").isNotNull() & F.col("value").isNotNull())
        .groupBy(key, "ts_ms").agg(F.max_by("value", "pos").alias("value"))
    )
