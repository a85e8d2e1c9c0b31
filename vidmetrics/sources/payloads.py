"""Landed platform answers and wire batches, flattened to metric and source rows.

Every reader takes JSON lines with a fixed schema; every mapper is a projection on nested columns.
Nothing here shuffles except the grouping of insight values per video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidmetrics import schemas
from vidmetrics.functions import coerce
from vidmetrics.functions.text import UNTITLED, abbreviated, is_blank, truncated
from vidmetrics.operators.spread import first_rows, instant

# --- fixed values: metric names in order of preference ----------------------
FACEBOOK_PICKS = {
    "views_3s": ("post_video_views_3s", "total_video_views_3s"),
    "views": ("total_video_views_unique", "total_video_views", "post_video_views", "fb_reels_total_plays"),
    "watch_ms": ("total_video_view_total_time", "post_video_view_time"),
    "avg_watch_ms": ("total_video_avg_time_watched", "post_video_avg_time_watched"),
    "comments": (
        "total_video_stories_by_action_type_comment", "total_video_comments", "post_comments",
        "post_video_social_actions_COMMENT",
    ),
    "shares": ("total_video_stories_by_action_type_share", "post_shares", "post_video_social_actions_SHARE"),
    "likes": ("total_video_reactions_by_type_total_like", "total_video_likes", "post_likes"),
    "reactions_like": (
        "total_video_reactions_by_type_total_like", "post_video_likes_by_reaction_type_REACTION_LIKE",
    ),
    "reactions_love": (
        "total_video_reactions_by_type_total_love", "post_video_likes_by_reaction_type_REACTION_LOVE",
    ),
    "reactions_haha": ("total_video_reactions_by_type_total_haha",),
    "reactions_angry": ("total_video_reactions_by_type_total_angry",),
    "reactions_wow": ("total_video_reactions_by_type_total_wow",),
    "reactions_sad": ("total_video_reactions_by_type_total_sad",),
    "reactions_total": ("total_video_reactions_by_type_total", "post_reactions_by_type_total"),
    "reach": ("post_impressions_unique",),
}
# Shorts end at 61 s in metric rows and at 60 s in source rows of the same platform.
YOUTUBE_SHORT_METRICS, YOUTUBE_SHORT_SOURCES, FACEBOOK_REEL = 61, 60, 60
DECIMAL_SCALE = 10_000
YOUTUBE_WATCH_URL = "https://www.youtube.com/watch?v="
# ---------------------------------------------------------------------------


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a fixed schema; broken lines are kept in ``_corrupt_record``."""
    return spark.read.schema(T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])).json(path)


# ---- wire batches ----------------------------------------------------------

def explode_items(batches: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """One row per item of an array of raw JSON texts: its position, and the parsed object, if it is one."""
    items = batches.select("*", F.posexplode(column).alias("item_pos", "_text")).drop(column)
    is_object = F.col("_text").rlike(r"^\s*\{")
    return items.withColumn("item", F.when(is_object, F.from_json("_text", schema))).drop("_text")


def metric_items(batches: DataFrame, *, as_of) -> DataFrame:
    """Items of ``snapshots`` with a ``problem`` for those to skip or reject."""
    items = explode_items(batches, "snapshots", schemas.SNAPSHOT_ITEM)
    item = F.col("item")
    keep = [c for c in items.columns if c not in ("item", "item_pos")]
    pvid = item["platform_video_id"]
    platform = coerce.platform_name(item["platform"])
    form = coerce.snapshot_format(item["platform_format"])
    legacy = coerce.lenient_long(F.coalesce(item["legacy_views_3s"], item["views_3s"]))
    fractional = ("avg_watch_seconds", "total_watch_seconds")
    counters = {}
    for name in schemas.COUNTERS:
        text = item[name]
        value = coerce.lenient_double(text).try_cast("long") if name in fractional else coerce.lenient_long(text)
        counters[name] = F.when(value.isNotNull(), F.greatest(F.lit(0), value))
    legacy_applies = (platform == "FACEBOOK") & (F.coalesce(form, F.lit("VIDEO")) == "VIDEO")
    counters["views_native"] = F.coalesce(
        counters["views_native"],
        F.when(legacy_applies & legacy.isNotNull(), F.greatest(F.lit(0), legacy)),
    )
    at = coerce.wire_instant(item["snapshot_at"], instant(as_of))
    problem = (
        F.when(item.isNull(), "skipped_not_an_object")
        .when(coerce.is_empty(pvid), "skipped_no_video_id")
        .when(F.trim(pvid) == "", "no_video_id").when(platform == "", "no_platform")
        .when(at.isNull(), "bad_instant")
    )
    return items.select(
        *keep, "item_pos", problem.alias("problem"), platform.alias("platform"),
        form.alias("platform_format"), F.trim(pvid).alias("platform_video_id"), at.alias("snapshot_at"),
        *[c.alias(n) for n, c in counters.items()],
    )


def source_items(batches: DataFrame) -> DataFrame:
    """Items of ``sources``; the first present alias of each key wins."""
    items = explode_items(batches, "sources", schemas.SOURCE_ITEM)
    item = F.col("item")
    keep = [c for c in items.columns if c not in ("item", "item_pos")]
    pvid = F.coalesce(item["platform_video_id"], item["platformId"], item["platform_source_id"], item["id"])
    return items.select(
        *keep, "item_pos",
        F.when(item.isNull(), "skipped_not_an_object").when(coerce.is_empty(pvid), "skipped_no_video_id")
        .alias("problem"),
        F.upper(F.coalesce(item["platform"], F.lit("YOUTUBE"))).alias("platform"),
        coerce.source_format(item["platform_format"], item["media_type"]).alias("platform_format"),
        item["platform_channel_id"].alias("platform_channel_id"), pvid.alias("platform_video_id"),
        item["title"].alias("title"), item["description"].alias("description"),
        F.coalesce(item["url"], item["permalink_url"]).alias("url"), item["etag"].alias("etag"),
        coerce.source_instant(F.coalesce(item["published_at"], item["publishedAt"])).alias("published_at"),
        coerce.lenient_long(item["duration_seconds"]).cast("int").alias("duration_seconds"),
    )


# ---- insights --------------------------------------------------------------

def insight_long(value: Column, kind: Column) -> Column:
    """whole numbers as they are, fractions times 10 000, numeric text by its shape."""
    text = F.trim(value.try_cast("string"))
    scaled = F.floor(text.try_cast("double") * DECIMAL_SCALE + 0.5)  # halves go up, below zero too
    return (
        F.when(kind.isin("BIGINT", "TINYINT", "SMALLINT", "INT"), value.try_cast("long"))
        .when(kind.startswith("DECIMAL") & text.rlike(r"^-?\d+$"), text.try_cast("long"))  # NULL beyond a long
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), scaled.cast("long"))
        .when((kind == "STRING") & text.rlike(r"^-?\d+$"), text.try_cast("long"))
        .when((kind == "STRING") & text.rlike(r"^-?\d*\.\d+$"), scaled.cast("long"))
    )


def clean_key(key: Column) -> Column:
    """F19."""
    return F.regexp_replace(key, "[^A-Za-z0-9_]", "_")


def facebook_insights(answers: DataFrame) -> DataFrame:
    """S3: (id, name, value) from answers ``id, data: array<struct<name, values: array<struct<value: variant>>>>``.

    The first value of each metric counts: a number keeps the name, an object adds its keys, an array
    its positions (and keys); everything else is ignored. A repeated name keeps its last value.
    """
    def entry(sub: Column, name: Column, value: Column) -> Column:
        return F.struct(sub.cast("int").alias("sub"), name.alias("name"), value.alias("value"))

    def of_object(value: Column, base: Column, sub: Column) -> Column:
        entries = F.map_entries(value.try_cast("map<string,variant>"))
        return F.transform(entries, lambda e: entry(sub, F.concat(base, F.lit("_"), clean_key(e["key"])), e["value"]))

    def kind(value: Column) -> Column:
        return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)

    name, value = F.col("name"), F.col("value")
    nothing = F.array().cast("array<struct<sub:int,name:string,value:variant>>")
    ignored = ("STRING", "BOOLEAN", "VOID", "ARRAY")

    def of_element(e: Column) -> Column:
        base = F.concat(name, F.lit("_"), e["i"].cast("string"))
        return (
            F.when(e["kind"] == "OBJECT", of_object(e["value"], base, e["i"]))
            .when(e["kind"].isin(*ignored), nothing).otherwise(F.array(entry(e["i"], base, e["value"])))
        )

    # Kinds are bound to a field before they are tested: inside a lambda every use would compute them.
    elements = F.transform(
        value.try_cast("array<variant>"),
        lambda v, i: F.struct(v.alias("value"), i.alias("i"), kind(v).alias("kind")),
    )
    values = (
        F.when(F.col("kind") == "OBJECT", of_object(value, name, F.lit(0)))
        .when(F.col("kind") == "ARRAY", F.flatten(F.transform(elements, of_element)))
        .when(F.col("kind").isin(*ignored), nothing).otherwise(F.array(entry(F.lit(0), name, value)))
    )
    return (
        answers.select("id", F.posexplode("data").alias("pos", "m"))
        .select("id", "pos", F.col("m.name").alias("name"), F.try_element_at("m.values", F.lit(1))["value"].alias("value"))
        .filter(value.isNotNull()).withColumn("kind", kind(value))
        .select("id", "pos", F.posexplode(values).alias("at", "f"))
        .select("id", "pos", "at", "f.*")
        .withColumn("value", insight_long(value, F.schema_of_variant(value)))
        .filter(F.col("value").isNotNull())
        .groupBy("id", "name")
        .agg(F.max_by("value", F.col("pos").cast("long") * (1 << 32) + F.col("at")).alias("value"))
    )


def instagram_insights(answers: DataFrame) -> DataFrame:
    """(id, name, value) with the first value of each metric; unreadable values are ignored."""
    metrics = answers.select("id", F.posexplode("data").alias("pos", "m"))
    value = F.try_element_at("m.values", F.lit(1))["value"]
    return (
        metrics.select("id", "pos", F.col("m.name").alias("name"), F.when(value.rlike(r"^[+-]?\d+$"), value.try_cast("long")).alias("value"))
        .filter(F.col("name").isNotNull() & F.col("value").isNotNull())
        .groupBy("id", "name").agg(F.max_by("value", "pos").alias("value"))
    )


def insight_maps(insights: DataFrame) -> DataFrame:
    """One map per id; an id has a few dozen metrics."""
    entry = F.struct("name", "value")
    return insights.groupBy("id").agg(F.map_from_entries(F.collect_list(entry)).alias("insights"))


def pick(metrics: Column, names: tuple[str, ...]) -> Column:
    """F16: the first metric of the list that is there."""
    return F.coalesce(*[F.try_element_at(metrics, F.lit(n)) for n in names])


# ---- Facebook --------------------------------------------------------------

def _facebook_seconds() -> Column:
    return F.floor(F.col("length") + 0.5).cast("int")


def facebook_format(url: Column, seconds: Column) -> Column:
    """F12."""
    reel = F.contains(F.lower(F.coalesce(url, F.lit(""))), F.lit("/reel/")) | F.coalesce(seconds <= FACEBOOK_REEL, F.lit(False))
    return F.when(reel, "REEL").otherwise("VIDEO")


def _facebook_sources(videos: DataFrame, untitled: Column) -> DataFrame:
    title = F.when(is_blank(F.col("title")), untitled).otherwise(F.col("title"))
    return videos.select(
        F.lit("FACEBOOK").alias("platform"),
        facebook_format(F.col("permalink_url"), _facebook_seconds()).alias("platform_format"),
        F.col("id").alias("platform_video_id"), title.alias("title"), "description",
        F.col("permalink_url").alias("url"), coerce.source_instant(F.col("created_time")).alias("published_at"),
        _facebook_seconds().alias("duration_seconds"),
    )


def facebook_sources(videos: DataFrame) -> DataFrame:
    """An untitled video shows the start of its description."""
    return _facebook_sources(videos, abbreviated(F.coalesce("description", F.lit(""))))


def facebook_metrics(videos: DataFrame, insights: DataFrame, *, as_of, unknown_as_zero: bool = True) -> DataFrame:
    """One metric row per video; a video without insights keeps unknown counters.

    The average watch time is 0 when it is not reported, unless ``unknown_as_zero`` is off.
    """
    joined = videos.join(insight_maps(insights), "id", "left")
    got = {k: pick(F.col("insights"), names) for k, names in FACEBOOK_PICKS.items()}

    def seconds(millis: Column) -> Column:
        return F.when(millis >= 0, F.floor(millis / 1000)).otherwise(F.ceil(millis / 1000)).cast("long")

    average = seconds(got["avg_watch_ms"])
    same = (
        "likes", "comments", "shares", "reach", "reactions_total", "reactions_like", "reactions_love",
        "reactions_wow", "reactions_haha", "reactions_sad", "reactions_angry",
    )
    return joined.select(
        F.lit("FACEBOOK").alias("platform"),
        facebook_format(F.col("permalink_url"), _facebook_seconds()).alias("platform_format"),
        F.col("id").alias("platform_video_id"), instant(as_of).alias("snapshot_at"),
        F.coalesce(got["views"], got["views_3s"]).alias("views_native"),
        (F.coalesce(average, F.lit(0)) if unknown_as_zero else average).alias("avg_watch_seconds"),
        seconds(got["watch_ms"]).alias("total_watch_seconds"),
        _facebook_seconds().cast("long").alias("video_length_seconds"),
        got["views_3s"].alias("legacy_views_3s"), *[got[n].alias(n) for n in same],
    )


def facebook_sources_older(videos: DataFrame, media_type: str = "VIDEO") -> DataFrame:
    """The older source mapping, with a fixed title for untitled videos."""
    return _facebook_sources(videos, F.lit(UNTITLED)).withColumn("platform_format", F.lit(media_type.upper()))


def facebook_metrics_older(videos: DataFrame, insights: DataFrame, *, as_of) -> DataFrame:
    """The older metric mapping, unknown to 0."""
    views = pick(F.col("insights"), ("total_video_views", "total_video_views_unique"))
    return videos.join(insight_maps(insights), "id", "left").select(
        F.lit("FACEBOOK").alias("platform"), F.col("id").alias("platform_video_id"),
        instant(as_of).alias("snapshot_at"), F.coalesce(views, F.lit(0)).alias("views_native"),
        F.lit(0).cast("long").alias("comments"), F.lit(0).cast("long").alias("shares"),
    )


def attachment_video_ids(attachment: Column) -> Column:
    """The video ids of one attachment; the first rule that applies decides."""
    target, subs = attachment["target"], attachment["subattachments"]["data"]

    def is_video(t: Column) -> Column:
        return F.coalesce(F.lower(t["type"]) == "video", F.lit(False))

    media_video = F.contains(F.lower(F.coalesce(attachment["media_type"], F.lit(""))), F.lit("video"))
    return (
        F.when(target.isNotNull() & (media_video | is_video(target)), F.array(target["id"]))
        .when(subs.isNotNull(), F.transform(F.filter(subs, lambda s: is_video(s["target"])), lambda s: s["target"]["id"]))
        .when(attachment["media"]["id"].isNotNull(), F.array(attachment["media"]["id"]))
        .otherwise(F.array().cast("array<string>"))
    )


def post_video_ids(posts: DataFrame, order: str = "pos") -> DataFrame:
    """(pos, id) of all videos in landed posts pages; ``order`` numbers the pages."""
    found = posts.select(F.col(order), F.posexplode("data").alias("p1", "post")).select(
        order, "p1", F.posexplode("post.attachments.data").alias("p2", "a")
    ).select(order, "p1", "p2", F.posexplode(attachment_video_ids(F.col("a"))).alias("p3", "id"))
    return found.select(F.struct(order, "p1", "p2", "p3").alias("pos"), "id").filter(F.col("id").isNotNull())


def listing_video_ids(listings: DataFrame, order: str = "pos") -> DataFrame:
    """(pos, id) of landed upload and reel listings."""
    return listings.select(F.col(order), F.posexplode("data").alias("p1", "v")).select(
        F.struct(order, "p1").alias("pos"), F.col("v.id").alias("id")
    ).filter(F.col("id").isNotNull())


def discovered_ids(*feeds: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct ids in the order in which the feeds, taken one after the other, name them."""
    out = None
    for i, feed in enumerate(feeds):
        flat = feed.select("id", F.lit(i).alias("feed"), *_position_keys(feed))
        out = flat if out is None else out.unionByName(flat)
    first = out.groupBy("id").agg(F.min(F.struct("feed", "k1", "k2", "k3", "k4")).alias("first"))
    ordered = first.orderBy("first").select("id", F.col("first.feed").alias("feed"))
    return ordered.limit(cap) if cap is not None else ordered


def _position_keys(feed: DataFrame) -> list[Column]:
    names = feed.schema["pos"].dataType.names
    keys = [F.col("pos")[n].cast("long") for n in names] + [F.lit(0).cast("long")] * (4 - len(names))
    return [k.alias(f"k{i + 1}") for i, k in enumerate(keys)]


# ---- YouTube ---------------------------------------------------------------

def youtube_items(answers: DataFrame) -> DataFrame:
    return answers.select(F.explode("items").alias("item")).withColumn(
        "seconds", coerce.iso_duration_seconds(F.col("item.contentDetails.duration"))
    )


def youtube_format(seconds: Column, short_up_to: int) -> Column:
    """F13."""
    return F.when(seconds <= short_up_to, "SHORT").otherwise("VIDEO")


def youtube_metrics(answers: DataFrame, *, as_of, short_up_to: int = YOUTUBE_SHORT_METRICS) -> DataFrame:
    """S5."""
    return youtube_items(answers).select(
        F.lit("YOUTUBE").alias("platform"), youtube_format(F.col("seconds"), short_up_to).alias("platform_format"),
        F.col("item.id").alias("platform_video_id"), instant(as_of).alias("snapshot_at"),
        F.col("item.statistics.viewCount").alias("views_native"), F.col("item.statistics.likeCount").alias("likes"),
        F.col("item.statistics.favoriteCount").alias("reactions_love"),
        F.col("item.statistics.commentCount").alias("comments"),
        F.col("seconds").cast("long").alias("video_length_seconds"),
    )


def youtube_sources(answers: DataFrame, *, short_up_to: int = YOUTUBE_SHORT_SOURCES) -> DataFrame:
    """S6."""
    return youtube_items(answers).select(
        F.lit("YOUTUBE").alias("platform"), youtube_format(F.col("seconds"), short_up_to).alias("platform_format"),
        F.col("item.id").alias("platform_video_id"), F.col("item.snippet.title").alias("title"),
        F.col("item.snippet.description").alias("description"),
        F.concat(F.lit(YOUTUBE_WATCH_URL), F.col("item.id")).alias("url"),
        coerce.source_instant(F.col("item.snippet.publishedAt")).alias("published_at"),
        F.col("seconds").alias("duration_seconds"),
    )


def playlist_video_ids(pages: DataFrame, order: str = "pos") -> DataFrame:
    """(pos, id) of landed playlist pages, blanks dropped, page order kept."""
    return pages.select(F.col(order), F.posexplode("items").alias("p1", "item")).select(
        F.struct(order, "p1").alias("pos"), F.col("item.contentDetails.videoId").alias("id")
    ).filter(~is_blank(F.col("id")))


# ---- Instagram -------------------------------------------------------------

def instagram_type(media_type: Column, product: Column) -> Column:
    """F14."""
    return (
        F.when(F.upper(product).isin("REELS", "REEL"), "REEL")
        .when(F.upper(media_type) == "VIDEO", "VIDEO").otherwise("POST")
    )


def instagram_rows(
    media: DataFrame, insights: DataFrame, *, since, as_of, cap: int | None = None, order: str = "pos"
) -> DataFrame:
    """Video and reel media since an instant, with their counters.

    Insights, when there are any, replace all counters, even by unknown ones. ``cap`` is the number of
    media per account and run, in listing order.
    """
    published = coerce.iso_instant(F.col("timestamp"))
    rows = media.withColumns({
        "published_at": published, "type": instagram_type(F.col("media_type"), F.col("media_product_type")),
    }).filter(
        F.col("id").isNotNull() & (F.col("published_at") >= F.lit(since).cast("timestamp"))
        & F.col("type").isin("VIDEO", "REEL")
    )
    if cap is not None:
        rows = first_rows(rows, ["account_id"], [F.col(order).asc()], max(1, cap))
    measured = F.col("insights").isNotNull()

    def counter(name: str | None, metric: str) -> Column:
        listed = F.col(name).try_cast("long") if name else F.lit(None).cast("long")
        return F.when(measured, F.try_element_at("insights", F.lit(metric))).otherwise(listed)

    return rows.join(insight_maps(insights), "id", "left").select(
        F.lit("INSTAGRAM").alias("platform"), F.col("type").alias("platform_format"),
        F.col("id").alias("platform_video_id"), truncated(F.col("caption")).alias("title"),
        F.col("caption").alias("description"), F.col("permalink").alias("url"), "published_at",
        instant(as_of).alias("snapshot_at"), counter("video_view_count", "views").alias("views_native"),
        counter("like_count", "likes").alias("likes"), counter("comments_count", "comments").alias("comments"),
        counter(None, "shares").alias("shares"), counter(None, "reach").alias("reach"),
    )
