"""The video list: filters, orders, pages, totals; and the parts of the detail view."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidmetrics.functions.watch import average_length, plausible_watch_seconds, reported_watch_seconds
from vidmetrics.operators.enrich import latest_enriched, latest_per_source, ratio
from vidmetrics.operators.rollup import video_last_snapshot
from vidmetrics.operators.spread import first_rows
from vidmetrics.operators.trend import video_trend
from vidmetrics.schemas import FORMATS, PLATFORM_SUFFIX, REACTIONS

CASELESS = "UNICODE_CI_AI"


def _views_order(column: str) -> Callable[[bool], list[Column]]:
    def order(down: bool) -> list[Column]:
        keys = [F.coalesce(F.col(column), F.lit(0)), F.col("video_published_at"), F.col("video_id")]
        return [k.desc_nulls_last() if down else k.asc_nulls_first() for k in keys]

    return order


def _published(down: bool) -> list[Column]:
    keys = [F.col("video_published_at"), F.col("video_id")]
    return [k.desc_nulls_last() if down else k.asc_nulls_first() for k in keys]


def _ratio_order(column: str) -> Callable[[bool], list[Column]]:
    def order(down: bool) -> list[Column]:
        head = F.col(column).desc_nulls_last() if down else F.col(column).asc_nulls_last()
        rest = [F.col("views_native_sum"), F.col("video_id")]
        return [head, *[k.desc_nulls_last() if down else k.asc_nulls_first() for k in rest]]

    return order


def _title(down: bool) -> list[Column]:
    keys = [F.collate(F.col("video_title"), CASELESS), F.col("video_id")]
    return [k.desc_nulls_last() if down else k.asc_nulls_first() for k in keys]


# O1: every key exists as <key>_desc and <key>_asc.
_ORDERS: dict[str, Callable[[bool], list[Column]]] = {
    "views": _views_order("views_native_sum"),
    **{p.lower(): _views_order(f"views_{s}") for p, s in PLATFORM_SUFFIX.items()},
    "published": _published,
    "engagement": _ratio_order("engagement_rate_sum"),
    "watch_eq": _ratio_order("watch_equivalent_sum"),
    "title": _title,
}
SORTS = tuple(f"{key}_{way}" for key in _ORDERS for way in ("desc", "asc"))


def sort_columns(sort: str | None) -> list[Column]:
    name = (sort or "").strip().lower()
    if name not in SORTS:
        name = "views_desc"
    key, _, way = name.rpartition("_")
    return _ORDERS[key](way == "desc")


DEFAULT_SIZE = 20
#: Pages of up to so many ids are broadcast.
BROADCAST_PAGE = 100_000


@dataclass(frozen=True)
class VideoListQuery:
    """Arguments of the list; unknown platforms, formats and sorts are ignored, a size below 1 is the default."""

    page: int = 1
    size: int = DEFAULT_SIZE
    q: str | None = None
    platform: str | None = None
    format: str | None = None
    published_from: str | None = None
    published_to: str | None = None
    sort: str = "views_desc"

    @property
    def limit(self) -> int:
        return self.size if self.size > 0 else DEFAULT_SIZE

    @property
    def offset(self) -> int:
        return (max(1, self.page) - 1) * self.limit


def _plain_letters() -> tuple[str, str]:
    """Letters of the Latin, Greek and Cyrillic ranges with their base letters, by Unicode's own decomposition;
    behind them the combining marks, which have no counterpart and so vanish."""
    bases = {}
    for point in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        letter, *marks = unicodedata.normalize("NFD", chr(point).lower())
        if marks and all(unicodedata.combining(m) for m in marks):
            bases[chr(point).lower()[0]] = letter
    return "".join(bases) + "".join(map(chr, range(0x300, 0x370))), "".join(bases.values())


def _folded(text: Column) -> Column:
    """Without case and accents, as the collation compares: sharp s and joined vowels are two letters."""
    plain = F.translate(F.lower(text), *_plain_letters())
    for joined, letters in (("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
        plain = F.replace(plain, F.lit(joined), F.lit(letters))
    return plain


def _title_match(text: str) -> Column:
    if "%" in text or "_" in text:  # the caller's own wildcards; pattern matching knows no collation, so both sides are folded
        pattern = _folded(F.lit(f"%{text}%"))
        return F.like(_folded(F.col("video_title")), pattern) | F.like(_folded(F.col("slug")), pattern)
    needle = F.collate(F.lit(text), CASELESS)
    return F.contains(F.collate(F.col("video_title"), CASELESS), needle) | F.contains(
        F.collate(F.col("slug"), CASELESS), needle
    )


def filter_videos(rollup: DataFrame, sv: DataFrame, query: VideoListQuery) -> DataFrame:
    """P3-P5, J6."""
    rows = rollup
    text = (query.q or "").strip()
    if text:
        rows = rows.filter(_title_match(text))
    if query.published_from:
        rows = rows.filter(F.col("video_published_at") >= F.lit(query.published_from).cast("timestamp"))
    if query.published_to:
        rows = rows.filter(F.col("video_published_at") < F.lit(query.published_to).cast("timestamp"))
    suffix = PLATFORM_SUFFIX.get((query.platform or "").strip().upper())
    if suffix:
        rows = rows.filter(F.col(f"views_{suffix}") > 0)
    wanted = (query.format or "").strip().upper()
    if wanted in FORMATS:
        with_format = sv.filter(F.col("platform_format") == wanted).select("video_id")
        rows = rows.join(with_format, "video_id", "left_semi")
    return rows


def page_of(rows: DataFrame, query: VideoListQuery) -> DataFrame:
    """O3: sorted page; offset + limit rows per task at most."""
    return rows.orderBy(*sort_columns(query.sort)).offset(query.offset).limit(query.limit)


def list_videos(
    rollup: DataFrame, sv: DataFrame, ms: DataFrame, query: VideoListQuery, *, with_trend: bool = False
) -> DataFrame:
    """The page is cut first; last measure and trend are computed for its videos only.

    Nothing runs before the result is asked for. The page is kept once it is sorted, for its ids also
    filter the sources; they are broadcast if the request is small.
    """
    page = page_of(filter_videos(rollup, sv, query), query).persist()
    ids = page.select("video_id")
    if query.limit <= BROADCAST_PAGE:
        ids = F.broadcast(ids)
    page_sources = sv.join(ids, "video_id", "left_semi")
    page_snapshots = ms.join(
        page_sources.select(F.col("id").alias("source_video_id")), "source_video_id", "left_semi"
    )
    out = page.join(video_last_snapshot(page_snapshots, page_sources), "video_id", "left")
    if with_trend:
        videos = page.select(F.col("video_id").alias("id"))
        out = out.join(video_trend(page_snapshots, page_sources, videos), "video_id", "left")
    return out


def list_totals(rollup: DataFrame, sv: DataFrame, query: VideoListQuery) -> DataFrame:
    """Count, platform sums and grand total of the filtered list, in one aggregate."""
    rows = filter_videos(rollup, sv, query)
    sums = [
        F.coalesce(F.sum(f"views_{s}"), F.lit(0)).cast("long").alias(f"sum_{s}")
        for s in PLATFORM_SUFFIX.values()
    ]
    totals = rows.agg(F.count("*").alias("total"), *sums)
    grand = sum((F.col(f"sum_{s}") for s in PLATFORM_SUFFIX.values()), F.lit(0))
    return totals.withColumn("sum_all", grand.cast("long"))


def view_band(platform: str | None, views: Column) -> Column:
    """F32: colour class of a view count. Fixed thresholds: 2000 / 1000, YouTube 400 / 200."""
    limits = {"YOUTUBE": (400, 200), "FACEBOOK": (2000, 1000), None: (2000, 1000)}.get(platform)
    if limits is None:
        return F.when(views.isNotNull(), F.lit("plain"))
    high, middle = limits
    return (
        F.when(views >= high, F.lit("green")).when(views >= middle, F.lit("yellow"))
        .when(views.isNotNull(), F.lit("plain"))
    )


def list_bands(rollup: DataFrame) -> DataFrame:
    """F32 over the list: the class of the total and of every platform."""
    return rollup.select(
        "video_id",
        view_band(None, F.coalesce(F.col("views_native_sum"), F.lit(0))).alias("band_sum"),
        *[view_band(p, F.col(f"views_{s}")).alias(f"band_{s}") for p, s in PLATFORM_SUFFIX.items()],
    )


def find_video(
    v: DataFrame, sv: DataFrame, *, video_id: int | None = None, slug: str | None = None,
    platform: str | None = None, platform_video_id: str | None = None,
) -> DataFrame:
    """One video by id, slug or publication, tried in that order."""
    if video_id is not None:
        return v.filter(F.col("id") == video_id)
    if slug is not None:
        return v.filter(F.col("slug") == slug.strip())
    if platform and platform_video_id:
        source = sv.filter(
            (F.col("platform") == platform.strip().upper())
            & (F.col("platform_video_id") == platform_video_id.strip())
        ).select(F.col("video_id").alias("id"))
        return v.join(source, "id", "left_semi")
    raise ValueError("give an id, a slug, or a platform with its video id")


def ordered_sources(sv: DataFrame) -> DataFrame:
    """Linked sources in display order."""
    return sv.filter(F.col("video_id").isNotNull()).orderBy(
        "video_id", F.col("platform").asc_nulls_first(), F.col("platform_format").asc_nulls_first(), "id"
    )


def _linked_latest(ms: DataFrame, sv: DataFrame) -> DataFrame:
    linked = sv.filter(F.col("video_id").isNotNull()).select(
        F.col("id").alias("source_video_id"), "video_id"
    )
    return linked.join(latest_per_source(ms), "source_video_id", "left")


def detail_totals(ms: DataFrame, sv: DataFrame, v: DataFrame) -> DataFrame:
    """Sums over all linked sources, active or not; unknown counts as 0."""
    names = ("views_native", "likes", "comments", "shares")
    sums = _linked_latest(ms, sv).groupBy("video_id").agg(
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in names]
    )
    known = {c: F.coalesce(F.col(c), F.lit(0)) for c in names}
    rows = v.select(F.col("id").alias("video_id")).join(sums, "video_id", "left").withColumns(known)
    engaged = F.col("likes") + F.col("comments") + F.col("shares")
    return rows.select(
        "video_id", F.col("views_native").alias("views"), "likes", "comments", "shares",
        ratio(engaged, F.greatest(F.lit(1), F.col("views_native"))).alias("engagement_rate"),
    )


def detail_watch_seconds(ms: DataFrame, sv: DataFrame, v: DataFrame) -> DataFrame:
    """Plausible watch time of a video, never above views x length."""
    latest = latest_enriched(ms, sv.filter(F.col("video_id").isNotNull()), v)
    facts = latest.groupBy("video_id").agg(
        F.avg(F.when(F.col("length_seconds") > 0, F.col("length_seconds"))).alias("mean_length")
    )
    fallback = v.select(F.col("id").alias("video_id"), "duration_seconds").join(
        facts, "video_id", "left"
    ).select("video_id", average_length(F.col("duration_seconds"), F.col("mean_length")).alias("fallback"))
    views = F.coalesce(F.col("views_native"), F.lit(0)).cast("double")
    length = F.coalesce(
        F.when(F.col("length_seconds") != 0, F.col("length_seconds")), F.col("fallback")
    ).cast("double")
    rows = latest.join(fallback, "video_id").withColumns({"_views": views, "_length": length})
    watch = plausible_watch_seconds(
        reported_watch_seconds(rows.columns), F.col("_views"), F.col("_length"),
        F.col("avg_watch_seconds"), F.col("avg_watch_ratio"),
    )
    per_video = rows.groupBy("video_id").agg(
        F.sum(watch).alias("total"),
        F.sum(F.when((F.col("_views") > 0) & (F.col("_length") > 0), F.col("_views") * F.col("_length"))
              .otherwise(0.0)).alias("cap"),
    )
    total = F.when(F.col("cap") > 0, F.least("total", "cap")).otherwise(F.col("total"))
    return fallback.join(per_video, "video_id", "left").select(
        "video_id", F.col("fallback").alias("length_fallback"),
        F.coalesce(F.greatest(F.lit(0), F.floor(total + 0.5)), F.lit(0)).cast("long").alias("watch_seconds"),
    )


def reaction_rows(ms: DataFrame, sv: DataFrame, v: DataFrame) -> DataFrame:
    """Latest points with at least one reaction."""
    known = {c: F.coalesce(F.col(c), F.lit(0)) for c in REACTIONS}
    linked = sv.filter(F.col("video_id").isNotNull())
    return (
        latest_enriched(ms, linked, v).withColumns(known)
        .filter(F.greatest(*[F.col(c) for c in REACTIONS]) > 0)
        .select("video_id", "source_video_id", "platform", "snapshot_at", *REACTIONS)
    )


def first_per_platform(ms: DataFrame, sv: DataFrame) -> DataFrame:
    """Per video, the first measured source of every platform, in display order."""
    key = F.lower(F.trim(F.coalesce("platform", F.lit(""))))
    measured = latest_per_source(ms).select("source_video_id", "snapshot_at", "views_native")
    rows = (
        sv.filter(F.col("video_id").isNotNull())
        .select(F.col("id").alias("source_video_id"), "video_id", "platform", "platform_format")
        .join(measured, "source_video_id")
        .withColumn("platform_key", key)
        .filter(F.col("platform_key") != "")
    )
    order = [
        F.col("platform").asc_nulls_first(), F.col("platform_format").asc_nulls_first(),
        F.col("source_video_id").asc(),
    ]
    return first_rows(rows, ["video_id", "platform_key"], order)
