"""Fixed vocabularies and the schemas of every landed input. Schemas are never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
PLATFORMS = ("YOUTUBE", "FACEBOOK", "INSTAGRAM", "TIKTOK")
PLATFORM_SUFFIX = {"YOUTUBE": "yt", "FACEBOOK": "fb", "INSTAGRAM": "ig", "TIKTOK": "tt"}
FORMATS = ("VIDEO", "SHORT", "REEL")

REACTIONS = (
    "reactions_like", "reactions_love", "reactions_wow",
    "reactions_haha", "reactions_sad", "reactions_angry",
)
COUNTERS = (
    "views_native", "avg_watch_seconds", "total_watch_seconds", "video_length_seconds",
    "reach", "unique_viewers", "likes", "comments", "shares", "reactions_total", *REACTIONS,
)
# Counters that may never go down for one source.
MONOTONE = ("views_native", "total_watch_seconds")
# Counters whose every change is worth a stored point.
USEFUL = ("likes", "comments", "shares", "reactions_total", *REACTIONS, "video_length_seconds")
# ---------------------------------------------------------------------------


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


S, L, I, D, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()

# Wire values arrive as numbers or as text, so every scalar is read as text and coerced afterwards.
# Items stay raw until they are exploded: one bad item must not cost the batch.
SNAPSHOT_BATCH = _struct(snapshots=T.ArrayType(S))
SOURCE_BATCH = _struct(sources=T.ArrayType(S))
SNAPSHOT_ITEM = _struct(
    platform=S, platform_format=S, source_video_id=S, platform_video_id=S, snapshot_at=S,
    **{c: S for c in COUNTERS}, legacy_views_3s=S, views_3s=S,
)
SOURCE_ITEM = _struct(
    platform=S, platform_video_id=S, platformId=S, platform_source_id=S, id=S,
    platform_format=S, media_type=S, platform_channel_id=S, title=S, description=S,
    url=S, permalink_url=S, etag=S, published_at=S, publishedAt=S, duration_seconds=S,
)

def _insights(value: T.DataType) -> T.StructType:
    metric = _struct(name=S, period=S, values=T.ArrayType(_struct(value=value)))
    return _struct(id=S, data=T.ArrayType(metric))


FACEBOOK_INSIGHTS = _insights(T.VariantType())
INSTAGRAM_INSIGHTS = _insights(S)
FACEBOOK_VIDEO = _struct(
    id=S, title=S, description=S, permalink_url=S, created_time=S, length=D,
)
_TARGET = _struct(id=S, type=S)
FACEBOOK_POSTS = _struct(
    data=T.ArrayType(_struct(
        id=S, created_time=S, permalink_url=S,
        attachments=_struct(data=T.ArrayType(_struct(
            media_type=S, target=_TARGET, media=_struct(id=S, source=S),
            subattachments=_struct(data=T.ArrayType(_struct(target=_TARGET))),
        ))),
    )),
)
FACEBOOK_LISTING = _struct(data=T.ArrayType(_struct(id=S)))
YOUTUBE_VIDEOS = _struct(
    items=T.ArrayType(_struct(
        id=S,
        snippet=_struct(publishedAt=S, channelId=S, title=S, description=S),
        contentDetails=_struct(duration=S),
        statistics=_struct(viewCount=L, likeCount=L, favoriteCount=L, commentCount=L),
    )),
)
YOUTUBE_PLAYLIST = _struct(
    items=T.ArrayType(_struct(contentDetails=_struct(videoId=S, videoPublishedAt=S))),
)
INSTAGRAM_MEDIA = _struct(
    account_id=S, id=S, caption=S, media_type=S, media_product_type=S, permalink=S,
    timestamp=S, like_count=S, comments_count=S, video_view_count=S,
)
