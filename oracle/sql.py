"""DuckDB text for each registered query, written from the semantics and not from the Spark code."""

from __future__ import annotations

from vidmetrics.fixtures import AS_OF, with_views

ORACLES: dict[str, str] = {}

NOW = f"timestamp '{AS_OF}'"


def oracle(name: str, body: str, *views: str, recursive: bool = False) -> None:
    text = with_views(body, *views)
    ORACLES[name] = text.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else text


ENRICHED = """, enriched AS (
SELECT ms.id, ms.source_video_id, sv.video_id, sv.platform, sv.platform_format, sv.platform_video_id,
  sv.title AS source_title, sv.published_at AS source_published_at,
  v.title AS video_title, v.published_at AS video_published_at, ms.snapshot_at,
  ms.views_native, ms.avg_watch_seconds, ms.total_watch_seconds, ms.reach, ms.unique_viewers,
  ms.likes, ms.comments, ms.shares, ms.reactions_total, ms.reactions_like, ms.reactions_love,
  coalesce(ms.video_length_seconds, sv.duration_seconds, v.duration_seconds) AS length_seconds,
  coalesce(ms.views_native, ms.reach) AS views_native_fallback,
  round(ms.avg_watch_seconds / nullif(coalesce(ms.video_length_seconds, sv.duration_seconds, v.duration_seconds), 0), 6) AS avg_watch_ratio,
  round(ms.total_watch_seconds / nullif(coalesce(ms.video_length_seconds, sv.duration_seconds, v.duration_seconds), 0), 6) AS watch_equivalent,
  round((ms.likes + ms.comments + ms.shares) / nullif(coalesce(ms.views_native, ms.reach), 0), 6) AS engagement_rate
FROM metric_snapshot ms JOIN source_video sv ON sv.id = ms.source_video_id LEFT JOIN video v ON v.id = sv.video_id)
"""
BASE = ("video", "source_video", "metric_snapshot")
LATEST = """, latest AS (
SELECT * FROM metric_snapshot
QUALIFY row_number() OVER (PARTITION BY source_video_id ORDER BY snapshot_at DESC, id DESC) = 1)
"""

oracle("enriched_snapshots", ENRICHED + "SELECT * FROM enriched", *BASE)
oracle("latest_snapshots", LATEST + """SELECT id, source_video_id, snapshot_at, created_at, views_native, likes, comments, shares
FROM latest""", "metric_snapshot")
oracle("latest_enriched", ENRICHED + LATEST + "SELECT e.* FROM enriched e JOIN latest l ON l.id = e.id", *BASE)
oracle("source_series_topn", ENRICHED + """SELECT * FROM enriched
QUALIFY row_number() OVER (PARTITION BY source_video_id ORDER BY snapshot_at DESC, id DESC) <= 50""", *BASE)
oracle("resolved_metrics", """SELECT sv.video_id, sv.platform AS source, ms.snapshot_at AS captured_at,
  coalesce(ms.views_native, ms.reach) AS views, ms.likes, ms.comments, ms.shares, ms.total_watch_seconds
FROM metric_snapshot ms JOIN source_video sv ON sv.id = ms.source_video_id WHERE sv.is_active = 1""",
       "source_video", "metric_snapshot")

ROLL = LATEST + """, e AS (
SELECT l.source_video_id, sv.platform, coalesce(l.views_native, l.reach) AS views, l.likes, l.comments, l.shares, l.total_watch_seconds
FROM latest l JOIN source_video sv ON sv.id = l.source_video_id),
rollup AS (
SELECT v.id AS video_id, v.slug, v.title AS video_title, v.published_at AS video_published_at,
  v.duration_seconds AS canonical_length_seconds,
  cast(sum(e.views) AS bigint) AS views_native_sum, cast(sum(e.likes) AS bigint) AS likes_sum,
  cast(sum(e.comments) AS bigint) AS comments_sum, cast(sum(e.shares) AS bigint) AS shares_sum,
  cast(sum(e.total_watch_seconds) AS bigint) AS total_watch_seconds_sum,
  cast(sum(CASE WHEN e.platform = 'YOUTUBE' THEN e.views ELSE 0 END) AS bigint) AS views_yt,
  cast(sum(CASE WHEN e.platform = 'FACEBOOK' THEN e.views ELSE 0 END) AS bigint) AS views_fb,
  cast(sum(CASE WHEN e.platform = 'INSTAGRAM' THEN e.views ELSE 0 END) AS bigint) AS views_ig,
  cast(sum(CASE WHEN e.platform = 'TIKTOK' THEN e.views ELSE 0 END) AS bigint) AS views_tt,
  sum(e.total_watch_seconds) / nullif(sum(e.views), 0) / nullif(v.duration_seconds, 0) AS avg_watch_ratio_est,
  sum(e.total_watch_seconds) / nullif(v.duration_seconds, 0) AS watch_equivalent_sum,
  (sum(e.likes) + sum(e.comments) + sum(e.shares)) / nullif(sum(e.views), 0) AS engagement_rate_sum
FROM video v LEFT JOIN source_video sv ON sv.video_id = v.id AND sv.is_active = 1
LEFT JOIN e ON e.source_video_id = sv.id
GROUP BY v.id, v.slug, v.title, v.published_at, v.duration_seconds)
"""
SUMS = ("views_native_sum", "likes_sum", "comments_sum", "shares_sum", "total_watch_seconds_sum",
        "views_yt", "views_fb", "views_ig", "views_tt")
TABLE = ROLL + ", stored AS (SELECT * REPLACE (" + ", ".join(
    f"coalesce({c}, 0) AS {c}" for c in SUMS) + """) FROM rollup),
last_measure AS (SELECT sv.video_id, max(ms.created_at) AS last_snapshot_at
FROM source_video sv JOIN metric_snapshot ms ON ms.source_video_id = sv.id GROUP BY sv.video_id)
"""
ROUNDED = """REPLACE (round(avg_watch_ratio_est, 6) AS avg_watch_ratio_est, round(watch_equivalent_sum, 6) AS watch_equivalent_sum,
  round(engagement_rate_sum, 6) AS engagement_rate_sum)"""
oracle("video_rollup", ROLL + f"SELECT * {ROUNDED} FROM rollup", *BASE)
oracle("video_last_snapshot", """SELECT sv.video_id, max(ms.created_at) AS last_snapshot_at
FROM source_video sv JOIN metric_snapshot ms ON ms.source_video_id = sv.id GROUP BY sv.video_id""",
       "source_video", "metric_snapshot")


def page(name: str, where: str, order: str, limit: int = 20, offset: int = 0) -> None:
    oracle(name, TABLE + f"""SELECT * {ROUNDED} FROM (
SELECT s.*, l.last_snapshot_at FROM stored s LEFT JOIN last_measure l ON l.video_id = s.video_id
{where} ORDER BY {order} LIMIT {limit} OFFSET {offset})""", *BASE)


page("list_views_desc", "", "s.views_native_sum DESC, s.video_published_at DESC, s.video_id DESC")
page("list_engagement_desc", "", "(s.engagement_rate_sum IS NULL), s.engagement_rate_sum DESC, s.views_native_sum DESC, s.video_id DESC")
page("list_watch_eq_asc", "", "(s.watch_equivalent_sum IS NULL), s.watch_equivalent_sum, s.views_native_sum, s.video_id")
page("list_title_asc", "", "s.video_title NULLS FIRST, s.video_id")
page("list_page2", "", "s.video_published_at DESC NULLS LAST, s.video_id DESC", 10, 10)
page("list_search", "WHERE lower(s.video_title) LIKE '%red%' OR lower(s.slug) LIKE '%red%'",
     "s.video_title DESC NULLS LAST, s.video_id DESC", 100)
page("list_platform_filter", """WHERE s.views_yt > 0 AND s.video_published_at >= timestamp '2024-01-02 00:00:00'
AND s.video_published_at < timestamp '2024-01-09 00:00:00'""", "s.views_yt DESC, s.video_published_at DESC, s.video_id DESC")
page("list_format_filter", """WHERE EXISTS (SELECT 1 FROM source_video x WHERE x.video_id = s.video_id AND x.platform_format = 'SHORT')""",
     "s.views_fb, s.video_published_at, s.video_id")
oracle("list_totals", TABLE + """SELECT count(*) AS total, cast(coalesce(sum(views_yt), 0) AS bigint) AS sum_yt,
  cast(coalesce(sum(views_fb), 0) AS bigint) AS sum_fb, cast(coalesce(sum(views_ig), 0) AS bigint) AS sum_ig,
  cast(coalesce(sum(views_tt), 0) AS bigint) AS sum_tt,
  cast(coalesce(sum(views_yt + views_fb + views_ig + views_tt), 0) AS bigint) AS sum_all
FROM stored s WHERE EXISTS (SELECT 1 FROM source_video x WHERE x.video_id = s.video_id AND x.platform_format = 'VIDEO')""", *BASE)
oracle("list_bands", TABLE + """SELECT video_id,
  CASE WHEN views_native_sum >= 2000 THEN 'green' WHEN views_native_sum >= 1000 THEN 'yellow' ELSE 'plain' END AS band_sum,
  CASE WHEN views_yt >= 400 THEN 'green' WHEN views_yt >= 200 THEN 'yellow' ELSE 'plain' END AS band_yt,
  CASE WHEN views_fb >= 2000 THEN 'green' WHEN views_fb >= 1000 THEN 'yellow' ELSE 'plain' END AS band_fb,
  'plain' AS band_ig, 'plain' AS band_tt FROM stored""", *BASE)

TREND = """, pooled AS (
SELECT sv.video_id, epoch(date_trunc('second', ms.snapshot_at)) AS s, ms.views_native AS y
FROM metric_snapshot ms JOIN source_video sv ON sv.id = ms.source_video_id
WHERE ms.views_native IS NOT NULL AND sv.video_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY sv.video_id ORDER BY ms.snapshot_at DESC, ms.id DESC) <= 20),
slopes AS (
SELECT video_id, coalesce(regr_slope(y, (s - s0) / 3600.0), 0) AS slope
FROM (SELECT *, min(s) OVER (PARTITION BY video_id) AS s0 FROM pooled) GROUP BY video_id),
trends AS (
SELECT v.id AS video_id, round(coalesce(slope, 0), 6) AS slope,
  CASE WHEN coalesce(slope, 0) >= 32 THEN 3 WHEN coalesce(slope, 0) >= 8 THEN 2 WHEN coalesce(slope, 0) >= 2 THEN 1 ELSE 0 END AS stars
FROM video v LEFT JOIN slopes s ON s.video_id = v.id)
"""
oracle("video_trend", TREND + "SELECT * FROM trends", *BASE)
oracle("list_with_trend", TABLE + TREND + """SELECT s.video_id, s.views_native_sum, l.last_snapshot_at, t.slope, t.stars
FROM stored s LEFT JOIN last_measure l ON l.video_id = s.video_id LEFT JOIN trends t ON t.video_id = s.video_id
ORDER BY s.views_native_sum DESC, s.video_published_at DESC, s.video_id DESC LIMIT 20""", *BASE)

oracle("detail_totals", LATEST + """, t AS (
SELECT v.id AS video_id, cast(coalesce(sum(l.views_native), 0) AS bigint) AS views, cast(coalesce(sum(l.likes), 0) AS bigint) AS likes,
  cast(coalesce(sum(l.comments), 0) AS bigint) AS comments, cast(coalesce(sum(l.shares), 0) AS bigint) AS shares
FROM video v LEFT JOIN source_video sv ON sv.video_id = v.id LEFT JOIN latest l ON l.source_video_id = sv.id GROUP BY v.id)
SELECT *, round((likes + comments + shares) / greatest(1, views), 6) AS engagement_rate FROM t""", *BASE)
oracle("detail_watch_seconds", ENRICHED + LATEST + """, le AS (
SELECT e.*, e.avg_watch_seconds / nullif(e.length_seconds, 0) AS share FROM enriched e JOIN latest l ON l.id = e.id),
fb AS (
SELECT v.id AS video_id, coalesce(CASE WHEN v.duration_seconds > 0 THEN v.duration_seconds END,
  cast(floor(avg(CASE WHEN le.length_seconds > 0 THEN le.length_seconds END) + 0.5) AS bigint), 300) AS fallback
FROM video v LEFT JOIN le ON le.video_id = v.id GROUP BY v.id, v.duration_seconds),
w AS (
SELECT le.*, coalesce(views_native, 0)::double AS vw, coalesce(nullif(length_seconds, 0), fallback)::double AS ln
FROM le JOIN fb USING (video_id)),
p AS (
SELECT video_id, CASE WHEN vw > 0 AND ln > 0 THEN vw * ln END AS cap,
  coalesce(CASE WHEN total_watch_seconds > 0 THEN total_watch_seconds::double END,
    CASE WHEN vw = 0 THEN NULL WHEN nullif(avg_watch_seconds, 0) IS NULL THEN NULL
      ELSE least(avg_watch_seconds * vw, share * ln * vw) END) AS pick FROM w),
s AS (SELECT video_id, sum(CASE WHEN pick IS NULL THEN 0 WHEN cap IS NULL OR pick < cap THEN pick ELSE cap END) AS total, sum(coalesce(cap, 0)) AS cap FROM p GROUP BY video_id)
SELECT fb.video_id, cast(fb.fallback AS bigint) AS length_fallback,
  cast(coalesce(greatest(0, floor(CASE WHEN cap > 0 THEN least(total, cap) ELSE total END + 0.5)), 0) AS bigint) AS watch_seconds
FROM fb LEFT JOIN s USING (video_id)""", *BASE)
oracle("reaction_rows", ENRICHED + LATEST + """SELECT e.video_id, e.source_video_id, e.platform, e.snapshot_at,
  coalesce(e.reactions_like, 0) AS reactions_like, coalesce(e.reactions_love, 0) AS reactions_love,
  0::bigint AS reactions_wow, 0::bigint AS reactions_haha, 0::bigint AS reactions_sad, 0::bigint AS reactions_angry
FROM enriched e JOIN latest l ON l.id = e.id
WHERE e.video_id IS NOT NULL AND (e.reactions_like > 0 OR e.reactions_love > 0)""", *BASE)
oracle("first_per_platform", LATEST + """SELECT sv.id AS source_video_id, sv.video_id, sv.platform, sv.platform_format,
  l.snapshot_at, l.views_native, lower(trim(sv.platform)) AS platform_key
FROM source_video sv JOIN latest l ON l.source_video_id = sv.id WHERE sv.video_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY sv.video_id, lower(trim(sv.platform)) ORDER BY sv.platform, sv.platform_format NULLS FIRST, sv.id) = 1""",
       "source_video", "metric_snapshot")
oracle("snapshot_explorer", """SELECT ms.id, sv.video_id, ms.source_video_id, sv.platform, ms.snapshot_at, 'likes' AS metric, ms.likes AS value
FROM metric_snapshot ms JOIN source_video sv ON sv.id = ms.source_video_id
WHERE sv.platform = 'FACEBOOK' AND ms.snapshot_at BETWEEN timestamp '2024-01-05 00:00:00' AND timestamp '2024-01-20 00:00:00'
ORDER BY ms.snapshot_at, ms.id LIMIT 100 OFFSET 100""", "source_video", "metric_snapshot")

oracle("overview_kpis", LATEST + """, l AS (
SELECT sv.platform, sv.video_id, coalesce(l.views_native, l.reach) AS views, l.total_watch_seconds AS watch, l.snapshot_at,
  CASE WHEN sv.platform = 'FACEBOOK' THEN coalesce(reactions_total, 0) + coalesce(comments, 0) + coalesce(shares, 0)
    ELSE coalesce(likes, 0) + coalesce(comments, 0) END AS engaged
FROM latest l JOIN source_video sv ON sv.id = l.source_video_id)
SELECT platform, count(DISTINCT video_id) AS videos, cast(coalesce(sum(views), 0) AS bigint) AS views_total,
  cast(coalesce(sum(watch), 0) AS bigint) AS watch_time_seconds_total,
  round(sum(watch) / nullif(count(DISTINCT video_id), 0), 6) AS watch_time_seconds_avg,
  cast(sum(engaged) AS bigint) AS engagement_total, max(snapshot_at) AS last_measure_at FROM l GROUP BY platform""",
       "source_video", "metric_snapshot")
oracle("engagement_by_platform", LATEST + """, g AS (
SELECT sv.video_id, sv.platform, cast(sum(coalesce(l.views_native, l.reach)) AS bigint) AS views,
  cast(sum(CASE WHEN sv.platform = 'FACEBOOK' THEN coalesce(reactions_total, 0) + coalesce(comments, 0) + coalesce(shares, 0)
    ELSE coalesce(likes, 0) + coalesce(comments, 0) END) AS bigint) AS engagement
FROM latest l JOIN source_video sv ON sv.id = l.source_video_id WHERE sv.video_id IS NOT NULL GROUP BY 1, 2)
SELECT *, cast(sum(engagement) OVER (PARTITION BY video_id) AS bigint) AS engagement_video FROM g""",
       "source_video", "metric_snapshot")

oracle("ordered_sources", "SELECT video_id, id, platform, platform_format, is_active FROM source_video WHERE video_id IS NOT NULL", "source_video")
oracle("latest_video", "SELECT * FROM video ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 1", "video")

# ---- series ----------------------------------------------------------------
SERIES = f""", series AS (
SELECT sv.video_id, sv.platform, date_trunc('hour', ms.snapshot_at) AS ts, cast(max(coalesce(ms.views_native, 0)) AS bigint) AS value
FROM metric_snapshot ms JOIN source_video sv ON sv.id = ms.source_video_id JOIN video v ON v.id = sv.video_id
WHERE ms.snapshot_at >= coalesce(v.published_at, {NOW} - interval 7 day) AND ms.snapshot_at <= {NOW}
GROUP BY 1, 2, 3)
"""
oracle("series_hour_platform", SERIES + "SELECT * FROM series", *BASE)
oracle("live_series", SERIES + "SELECT * FROM series", *BASE)
oracle("series_day_platform", f"""SELECT sv.video_id, sv.platform, cast(date_trunc('day', ms.snapshot_at) AS timestamp) AS ts,
  cast(max(coalesce(ms.likes, 0)) AS bigint) AS value
FROM metric_snapshot ms JOIN source_video sv ON sv.id = ms.source_video_id JOIN video v ON v.id = sv.video_id
WHERE ms.snapshot_at >= {NOW} - interval 20 day AND ms.snapshot_at <= {NOW} AND sv.platform IN ('YOUTUBE', 'FACEBOOK')
GROUP BY 1, 2, 3""", *BASE)
oracle("series_hour_global", SERIES + "SELECT video_id, ts, cast(sum(value) AS bigint) AS value FROM series GROUP BY 1, 2", *BASE)
oracle("series_cumsum", SERIES + """SELECT video_id, platform, ts,
  cast(sum(value) OVER (PARTITION BY video_id, platform ORDER BY ts) AS bigint) AS value FROM series""", *BASE)
oracle("series_downsampled", SERIES + """SELECT video_id, platform, ts, value FROM (
SELECT *, row_number() OVER (PARTITION BY video_id, platform ORDER BY ts) AS i, count(*) OVER (PARTITION BY video_id, platform) AS n FROM series)
WHERE (i - 1) % greatest(1, cast(ceil(n / 20.0) AS bigint)) = 0 OR i = n""", *BASE)
oracle("series_nonmonotonic", SERIES + """SELECT video_id, platform, ts, prev_value, value FROM (
SELECT *, lag(value) OVER (PARTITION BY video_id, platform ORDER BY ts) AS prev_value FROM series)
WHERE value < prev_value QUALIFY row_number() OVER (PARTITION BY video_id, platform ORDER BY ts) = 1""", *BASE)


# ---- aligned curves --------------------------------------------------------
def curves(unit: str, horizon: int) -> str:
    return f""", starts AS (
SELECT video_id, platform AS source, min(published_at) AS t0 FROM source_video
WHERE is_active = 1 AND video_id IS NOT NULL AND published_at >= {NOW} - interval 6 month GROUP BY 1, 2),
raw AS (
SELECT sv.video_id, sv.platform AS source, cast(date_sub('{unit}', s.t0, ms.snapshot_at) AS int) AS age_bucket, max(ms.views_native) AS views_cum
FROM metric_snapshot ms JOIN source_video sv ON sv.id = ms.source_video_id
JOIN starts s ON s.video_id = sv.video_id AND s.source = sv.platform
WHERE sv.is_active = 1 AND sv.published_at >= {NOW} - interval 6 month AND ms.snapshot_at >= sv.published_at
  AND ms.snapshot_at >= {NOW} - interval 6 month AND ms.views_native IS NOT NULL GROUP BY 1, 2, 3),
grid AS (SELECT s.*, cast(h AS int) AS age_bucket FROM starts s, generate_series(0, {horizon}) g(h)),
marks AS (
SELECT g.*, r.views_cum AS exact,
  last_value(CASE WHEN r.views_cum IS NOT NULL THEN {{'a': g.age_bucket, 'v': r.views_cum}} END IGNORE NULLS) OVER w AS p,
  first_value(CASE WHEN r.views_cum IS NOT NULL THEN {{'a': g.age_bucket, 'v': r.views_cum}} END IGNORE NULLS) OVER f AS n
FROM grid g LEFT JOIN raw r USING (video_id, source, age_bucket)
WINDOW w AS (PARTITION BY g.video_id, g.source ORDER BY g.age_bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  f AS (PARTITION BY g.video_id, g.source ORDER BY g.age_bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
dense AS (
SELECT video_id, source, '{unit}' AS granularity, age_bucket, t0 + to_{unit}s(age_bucket) AS bucket_ts,
  cast(CASE WHEN exact IS NOT NULL THEN exact WHEN p IS NULL THEN 0 WHEN n IS NULL THEN p.v
    ELSE p.v + ((age_bucket - p.a) * 1.0::double / (n.a - p.a)) * (n.v - p.v) END AS double) AS views_cum FROM marks)
"""


CURVES = curves("hour", 720)
BANDS = CURVES + """, bands AS (
SELECT source, granularity, age_bucket, quantile_disc(views_cum, 0.10) AS p10_views, quantile_disc(views_cum, 0.25) AS p25_views,
  quantile_disc(views_cum, 0.50) AS p50_views, quantile_disc(views_cum, 0.75) AS p75_views, quantile_disc(views_cum, 0.90) AS p90_views,
  count(*) AS count_videos FROM dense GROUP BY 1, 2, 3)
"""
CLIPPED = BANDS + SERIES + """, last_bucket AS (
SELECT s.video_id, s.platform, date_trunc('hour', v.published_at) AS t0,
  greatest(0, cast(floor((epoch(max(s.ts)) - epoch(date_trunc('hour', v.published_at))) / 3600) AS int)) AS max_bucket
FROM series s JOIN video v ON v.id = s.video_id WHERE v.published_at IS NOT NULL GROUP BY s.video_id, s.platform, v.published_at),
clipped AS (
SELECT l.video_id, b.source, b.age_bucket, l.t0 + to_hours(b.age_bucket) AS ts,
  cast(trunc(p10_views) AS bigint) AS p10, cast(trunc(p25_views) AS bigint) AS p25, cast(trunc(p50_views) AS bigint) AS p50,
  cast(trunc(p75_views) AS bigint) AS p75, cast(trunc(p90_views) AS bigint) AS p90, b.count_videos
FROM bands b JOIN last_bucket l ON l.platform = b.source AND b.age_bucket <= l.max_bucket)
"""
oracle("aligned_raw", CURVES + """SELECT r.video_id, r.source, r.age_bucket, s.t0 + to_hours(r.age_bucket) AS bucket_ts, r.views_cum
FROM raw r JOIN starts s USING (video_id, source)""", "source_video", "metric_snapshot")
oracle("aligned_dense", CURVES + "SELECT * REPLACE (round(views_cum, 6) AS views_cum) FROM dense", "source_video", "metric_snapshot")
oracle("aligned_dense_day", curves("day", 30) + "SELECT * REPLACE (round(views_cum, 6) AS views_cum) FROM dense",
       "source_video", "metric_snapshot")
oracle("percentile_bands", BANDS + f"""SELECT source, granularity, age_bucket, round(p10_views, 6) AS p10_views, round(p25_views, 6) AS p25_views,
  round(p50_views, 6) AS p50_views, round(p75_views, 6) AS p75_views, round(p90_views, 6) AS p90_views, count_videos, {NOW} AS updated_at
FROM bands""", "source_video", "metric_snapshot")
oracle("bands_clipped", CLIPPED + "SELECT * FROM clipped", *BASE)
oracle("bands_carried", CLIPPED + """SELECT s.video_id, s.platform, s.ts, s.value,
  coalesce(last_value(p10 IGNORE NULLS) OVER w, 0) AS p10, coalesce(last_value(p25 IGNORE NULLS) OVER w, 0) AS p25,
  coalesce(last_value(p50 IGNORE NULLS) OVER w, 0) AS p50, coalesce(last_value(p75 IGNORE NULLS) OVER w, 0) AS p75,
  coalesce(last_value(p90 IGNORE NULLS) OVER w, 0) AS p90
FROM series s LEFT JOIN clipped c ON c.video_id = s.video_id AND c.source = s.platform AND c.ts = s.ts
WHERE EXISTS (SELECT 1 FROM clipped x WHERE x.video_id = s.video_id AND x.source = s.platform)
WINDOW w AS (PARTITION BY s.video_id, s.platform ORDER BY s.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", *BASE)
oracle("bands_exact", CLIPPED + """SELECT s.video_id, s.platform, s.ts, s.value, c.p10, c.p25, c.p50, c.p75, c.p90
FROM series s JOIN clipped c ON c.video_id = s.video_id AND c.source = s.platform AND c.ts = s.ts""", *BASE)
oracle("baseline_median", CURVES + f"""SELECT d.source, d.granularity, d.age_bucket, round(quantile_disc(d.views_cum, 0.5), 6) AS median_views, count(*) AS count_videos
FROM dense d WHERE EXISTS (SELECT 1 FROM source_video sv WHERE sv.video_id = d.video_id AND sv.platform = d.source
  AND sv.published_at >= {NOW} - interval 25 day) GROUP BY 1, 2, 3""", "source_video", "metric_snapshot")

oracle("compared_curves", CURVES + """, medians AS (
SELECT source, age_bucket, quantile_disc(views_cum, 0.5) AS m FROM dense GROUP BY 1, 2)
SELECT d.video_id, d.source, d.granularity, d.age_bucket, round(d.views_cum, 6) AS views_cum, round(m.m, 6) AS median_views
FROM dense d JOIN medians m USING (source, age_bucket)""", "source_video", "metric_snapshot")

# ---- deltas ----------------------------------------------------------------
DELTAS = """, known AS (
SELECT *, epoch_ms(snapshot_at) AS t FROM metric_snapshot
WHERE views_native IS NOT NULL AND snapshot_at <= timestamp '2024-01-28 00:00:00'),
edge AS (SELECT epoch_ms(timestamp '2024-01-27 00:00:00') AS e),
near AS (
SELECT source_video_id, arg_max(views_native, (snapshot_at, id)) AS views_now,
  arg_max(views_native, (snapshot_at, id)) FILTER (t <= e) AS ov, max(t) FILTER (t <= e) AS ot,
  arg_min(views_native, (snapshot_at, id)) FILTER (t > e) AS nv, min(t) FILTER (t > e) AS nt, any_value(e) AS e
FROM known, edge GROUP BY source_video_id),
at_edge AS (
SELECT *, CASE WHEN ot IS NULL THEN NULL WHEN nt IS NULL OR ot = e THEN ov::double
  ELSE ov + ((e - ot) / (nt - ot)) * (nv - ov) END AS v0 FROM near),
deltas AS (
SELECT source_video_id, views_now, views_now - v0 AS delta, (views_now - v0) / nullif(v0, 0) AS growth FROM at_edge)
"""
STARS = DELTAS + """, starred AS (SELECT *, CASE
  WHEN views_now <= 100 AND growth >= 0.6 THEN 2
  WHEN views_now > 100 AND (delta >= 300 OR (views_now >= 500 AND growth >= 0.35)) THEN 2
  WHEN views_now <= 100 AND growth >= 0.3 THEN 1
  WHEN views_now > 100 AND (delta >= 100 OR (views_now >= 200 AND growth >= 0.2)) THEN 1 ELSE 0 END AS stars FROM deltas)
"""
oracle("delta_24h", DELTAS + "SELECT source_video_id, views_now, round(delta, 4) AS delta, round(growth, 4) AS growth FROM deltas", "metric_snapshot")
oracle("stars_24h", STARS + """SELECT sv.video_id, round(max(delta), 4) AS delta, round(max(growth), 4) AS growth, max(stars) AS stars
FROM starred s JOIN source_video sv ON sv.id = s.source_video_id WHERE sv.video_id IS NOT NULL GROUP BY 1""",
       "source_video", "metric_snapshot")
oracle("top_accelerating", DELTAS + """SELECT s.source_video_id, s.views_now, round(delta, 4) AS delta, round(growth, 4) AS growth, sv.video_id, sv.platform
FROM deltas s JOIN source_video sv ON sv.id = s.source_video_id WHERE sv.video_id IS NOT NULL AND delta IS NOT NULL
ORDER BY s.delta DESC, s.source_video_id LIMIT 20""", "source_video", "metric_snapshot")

# ---- ingestion -------------------------------------------------------------
FIELDS = ("views_native", "total_watch_seconds", "reach", "likes", "comments", "shares")
WALK = f""", feed AS (SELECT *, row_number() OVER (PARTITION BY source_video_id ORDER BY arrival_seq) AS rn FROM snapshot_feed),
walk AS (
SELECT rn, arrival_seq, source_video_id, snapshot_at, true AS stored, 'first_snapshot' AS reason, 0 AS corrections,
  cast(NULL AS bigint) AS delta, {", ".join(FIELDS)}, snapshot_at AS s_at, {", ".join(f"{c} AS s_{c}" for c in FIELDS)}
FROM feed WHERE rn = 1
UNION ALL
SELECT rn, arrival_seq, source_video_id, snapshot_at, reason NOT IN ('out_of_order', 'below_threshold'), reason,
  CASE WHEN reason = 'out_of_order' THEN 0 ELSE corrections END, CASE WHEN reason <> 'out_of_order' THEN greatest(0, m_views_native - s_views_native) + 0 * m_views_native * s_views_native END,
  {", ".join(f"CASE WHEN reason = 'out_of_order' THEN r_{c} ELSE m_{c} END" for c in FIELDS)},
  CASE WHEN reason IN ('out_of_order', 'below_threshold') THEN s_at ELSE snapshot_at END,
  {", ".join(f"CASE WHEN reason IN ('out_of_order', 'below_threshold') THEN s_{c} ELSE m_{c} END" for c in FIELDS)}
FROM (
SELECT *, CASE WHEN snapshot_at < s_at THEN 'out_of_order' WHEN snapshot_at = s_at THEN 'same_timestamp_update'
  WHEN m_likes IS DISTINCT FROM s_likes OR m_comments IS DISTINCT FROM s_comments OR m_shares IS DISTINCT FROM s_shares THEN 'useful_metric_changed'
  WHEN m_views_native IS NOT NULL AND (s_views_native IS NULL OR m_views_native - s_views_native >= 10
    OR (m_views_native > s_views_native AND s_views_native > 0 AND (m_views_native - s_views_native) / s_views_native >= 0.01)) THEN 'views_delta'
  WHEN cast(snapshot_at AS date) <> cast(s_at AS date) THEN 'daily_guard' ELSE 'below_threshold' END AS reason
FROM (
SELECT f.rn, f.arrival_seq, f.source_video_id, f.snapshot_at, w.s_at, {", ".join(f"w.s_{c}" for c in FIELDS)}, {", ".join(f"f.{c} AS r_{c}" for c in FIELDS)},
  greatest(coalesce(f.views_native, w.s_views_native), w.s_views_native) AS m_views_native,
  greatest(coalesce(f.total_watch_seconds, w.s_total_watch_seconds), w.s_total_watch_seconds) AS m_total_watch_seconds,
  {", ".join(f"coalesce(f.{c}, w.s_{c}) AS m_{c}" for c in FIELDS[2:])},
  coalesce(cast(f.views_native < w.s_views_native AS int), 0) + coalesce(cast(f.total_watch_seconds < w.s_total_watch_seconds AS int), 0) AS corrections
FROM walk w JOIN feed f ON f.source_video_id = w.source_video_id AND f.rn = w.rn + 1)))
"""
oracle("sparse_decisions", WALK + f"""SELECT arrival_seq, source_video_id, snapshot_at, stored, reason, corrections AS monotonic_corrections,
  delta AS views_delta, {", ".join(FIELDS)} FROM walk""", "snapshot_feed", recursive=True)
oracle("sparse_stored", WALK + f"""SELECT arrival_seq, source_video_id, snapshot_at, reason, {", ".join(FIELDS)} FROM walk WHERE stored
QUALIFY row_number() OVER (PARTITION BY source_video_id, snapshot_at ORDER BY arrival_seq DESC) = 1""", "snapshot_feed", recursive=True)
oracle("ingest_report", WALK + """SELECT reason, stored, count(*) AS items, cast(sum(corrections) AS bigint) AS monotonic_corrections
FROM walk GROUP BY 1, 2""", "snapshot_feed", recursive=True)
oracle("ingest_totals", WALK + """SELECT count(*) AS ok, cast(0 AS bigint) AS ko, count(*) FILTER (stored) AS stored,
  count(*) FILTER (NOT stored) AS skipped, cast(sum(corrections) AS bigint) AS monotonic_corrections FROM walk""", "snapshot_feed", recursive=True)
# The newest stored point of a source is at or after everything in the feed: a row at the same
# instant updates it, every other row is late.
oracle("seeded_decisions", """, newest AS (SELECT source_video_id, max(snapshot_at) AS n FROM metric_snapshot GROUP BY 1)
SELECT f.arrival_seq, f.source_video_id, f.snapshot_at, f.snapshot_at = n.n AS stored,
  CASE WHEN f.snapshot_at = n.n THEN 'same_timestamp_update' ELSE 'out_of_order' END AS reason
FROM snapshot_feed f JOIN newest n ON n.source_video_id = f.source_video_id""", "snapshot_feed")
UPSERTED = """, k AS (
SELECT *, row_number() OVER (PARTITION BY platform, platform_video_id ORDER BY arrival_seq DESC) AS rn FROM source_update)
"""
oracle("source_changes", UPSERTED + """SELECT CASE WHEN s.id IS NULL THEN 'inserted'
  WHEN s.is_active = 1 AND s.platform_format IS NOT DISTINCT FROM k.platform_format AND s.title IS NOT DISTINCT FROM k.title
    AND s.published_at IS NOT DISTINCT FROM k.published_at AND s.duration_seconds IS NOT DISTINCT FROM k.duration_seconds THEN 'unchanged'
  ELSE 'updated' END AS change, count(*) AS sources
FROM k LEFT JOIN source_video s ON s.platform = k.platform AND s.platform_video_id = k.platform_video_id WHERE rn = 1 GROUP BY 1""",
       "source_video", "source_update")
oracle("upsert_sources", """, last AS (
SELECT * FROM source_update QUALIFY row_number() OVER (PARTITION BY platform, platform_video_id ORDER BY arrival_seq DESC) = 1),
firsts AS (SELECT platform, platform_video_id, min(arrival_seq) AS seq FROM source_update GROUP BY 1, 2),
j AS (
SELECT s.id, s.video_id, coalesce(s.platform, l.platform) AS platform, coalesce(s.platform_video_id, l.platform_video_id) AS platform_video_id,
  CASE WHEN l.arrival_seq IS NOT NULL THEN l.platform_format ELSE s.platform_format END AS platform_format,
  CASE WHEN l.arrival_seq IS NOT NULL THEN l.title ELSE s.title END AS title,
  CASE WHEN l.arrival_seq IS NOT NULL THEN l.published_at ELSE s.published_at END AS published_at,
  CASE WHEN l.arrival_seq IS NOT NULL THEN l.duration_seconds ELSE s.duration_seconds END AS duration_seconds,
  CASE WHEN l.arrival_seq IS NOT NULL THEN 1 ELSE s.is_active END AS is_active,
  CASE WHEN s.id IS NULL THEN 'inserted' WHEN l.arrival_seq IS NULL THEN 'kept'
    WHEN s.is_active = 1 AND s.platform_format IS NOT DISTINCT FROM l.platform_format AND s.title IS NOT DISTINCT FROM l.title
      AND s.published_at IS NOT DISTINCT FROM l.published_at AND s.duration_seconds IS NOT DISTINCT FROM l.duration_seconds THEN 'unchanged'
    ELSE 'updated' END AS change, f.seq
FROM source_video s FULL JOIN last l ON l.platform = s.platform AND l.platform_video_id = s.platform_video_id
LEFT JOIN firsts f ON f.platform = l.platform AND f.platform_video_id = l.platform_video_id)
SELECT CASE WHEN change = 'inserted' THEN (SELECT max(id) FROM source_video) + row_number() OVER (PARTITION BY change ORDER BY seq) ELSE id END AS id,
  video_id, platform, platform_format, platform_video_id, title, published_at, duration_seconds, is_active, change FROM j""",
       "source_video", "source_update")
oracle("upsert_snapshots", """, u AS (
SELECT id AS old_id, -1 AS seq, source_video_id, snapshot_at, views_native, likes, comments FROM metric_snapshot
UNION ALL SELECT NULL, arrival_seq, source_video_id, snapshot_at, views_native, likes, comments FROM snapshot_feed),
w AS (
SELECT *, max(old_id) OVER (PARTITION BY source_video_id, snapshot_at) AS kept FROM u
QUALIFY row_number() OVER (PARTITION BY source_video_id, snapshot_at ORDER BY seq DESC, old_id DESC NULLS LAST) = 1)
SELECT CASE WHEN kept IS NULL THEN (SELECT max(id) FROM metric_snapshot) + row_number() OVER (PARTITION BY kept IS NULL ORDER BY seq) ELSE kept END AS id,
  source_video_id, snapshot_at, views_native, likes, comments FROM w""", "metric_snapshot", "snapshot_feed")
oracle("dedup_latest", """SELECT arrival_seq, source_video_id, snapshot_at, views_native FROM snapshot_feed
QUALIFY row_number() OVER (PARTITION BY source_video_id, snapshot_at ORDER BY arrival_seq DESC) = 1""", "snapshot_feed")
oracle("minimal_sources", """, u AS (
SELECT r.platform, r.platform_video_id, min(r.pos) AS seq, arg_min(CASE r.pos % 3 WHEN 1 THEN 'SHORT' ELSE 'VIDEO' END, r.pos) FILTER (r.pos % 3 <> 0) AS platform_format FROM requested_id r
WHERE NOT EXISTS (SELECT 1 FROM source_video s WHERE s.platform = r.platform AND s.platform_video_id = r.platform_video_id) GROUP BY 1, 2)
SELECT (SELECT max(id) FROM source_video) + row_number() OVER (ORDER BY seq) AS id, cast(NULL AS bigint) AS video_id, platform, platform_video_id,
  platform_format, 1 AS is_active FROM u""", "source_video", "requested_id")
oracle("filled_formats", """SELECT s.id, coalesce(s.platform_format,
  (SELECT arg_min(u.platform_format, u.arrival_seq) FROM source_update u WHERE u.platform = s.platform AND u.platform_video_id = s.platform_video_id)) AS platform_format
FROM source_video s""", "source_video", "source_update")
oracle("missing_sources", """SELECT pos, platform, platform_video_id FROM requested_id r
WHERE NOT EXISTS (SELECT 1 FROM source_video s WHERE s.platform = r.platform AND s.platform_video_id = r.platform_video_id)""",
       "source_video", "requested_id")
oracle("polling_due", """, p AS (
SELECT sv.id AS source_video_id, sv.platform, l.newest AS last_snapshot_at,
  CASE WHEN date_sub('day', sv.published_at, timestamp '2024-01-12 06:00:00') <= 3 THEN 2
    WHEN date_sub('day', sv.published_at, timestamp '2024-01-12 06:00:00') <= 7 THEN 6 ELSE 24 END AS wait_hours
FROM source_video sv LEFT JOIN (SELECT source_video_id, max(snapshot_at) AS newest FROM metric_snapshot GROUP BY 1) l ON l.source_video_id = sv.id)
SELECT *, coalesce(last_snapshot_at + to_hours(wait_hours) < timestamp '2024-01-12 06:00:00', true) AS due,
  cast(coalesce(greatest(0, epoch(date_trunc('second', last_snapshot_at)) + wait_hours * 3600 - epoch(timestamp '2024-01-12 06:00:00')), 0) AS bigint) AS next_delay_seconds
FROM p""", "source_video", "metric_snapshot")

# ---- reconciliation --------------------------------------------------------
NORM = r"""trim(regexp_replace(regexp_replace(lower(title), '\b(teaser|bande-annonce|preview|extrait)\b', '', 'g'), '[\s\-_:;,.!?()\[\]{}]+', ' ', 'g'))"""
oracle("norm_titles", f"SELECT id, {NORM} AS norm_title FROM catalog_source", "catalog_source")
oracle("teaser_flag", """SELECT id, coalesce(duration_seconds <= 45, false) OR regexp_matches(lower(title || ' | ' || description),
  'teaser|extrait|trailer|bande-annonce|short|extract|sneak peek') AS is_teaser FROM catalog_source""", "catalog_source")


def clusters(hours: int) -> str:
    return f""", cand AS (
SELECT c.*, {NORM} AS norm_title, cast(epoch(c.published_at) AS bigint) AS sec FROM catalog_source c
WHERE c.is_active = 1 AND NOT EXISTS (SELECT 1 FROM video v WHERE v.id = c.video_id AND v.is_locked = 1)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY norm_title ORDER BY published_at, id) AS rn FROM cand),
walk AS (
SELECT norm_title, rn, id, sec AS ref, 1 AS bucket FROM ordered WHERE rn = 1
UNION ALL
SELECT o.norm_title, o.rn, o.id, CASE WHEN abs(o.sec - w.ref) <= {hours * 3600} THEN (w.ref + o.sec + 1) // 2 ELSE o.sec END,
  CASE WHEN abs(o.sec - w.ref) <= {hours * 3600} THEN w.bucket ELSE w.bucket + 1 END
FROM walk w JOIN ordered o ON o.norm_title = w.norm_title AND o.rn = w.rn + 1),
items AS (
SELECT o.*, w.bucket, first_value(o.id) OVER (PARTITION BY o.norm_title, w.bucket ORDER BY o.rn) AS cluster_id
FROM ordered o JOIN walk w ON w.norm_title = o.norm_title AND w.rn = o.rn),
clusters AS (
SELECT norm_title, cluster_id, count(*) AS items, arg_min(video_id, rn) FILTER (video_id IS NOT NULL) AS existing_video_id, min(published_at) AS published_at,
  coalesce(arg_min(title, rn) FILTER (platform = 'YOUTUBE' AND trim(title) <> ''), arg_min(title, (-length(title), rn)) FILTER (trim(title) <> ''), '(sans titre)') AS title,
  coalesce(arg_min(description, rn) FILTER (platform = 'YOUTUBE' AND trim(description) <> ''), arg_min(description, (-length(description), rn)) FILTER (trim(description) <> ''), '') AS description
FROM items GROUP BY 1, 2),
placed AS (
SELECT *, CASE WHEN existing_video_id IS NULL THEN (SELECT max(id) FROM video) + row_number() OVER (PARTITION BY existing_video_id IS NULL ORDER BY cluster_id)
  ELSE existing_video_id END AS new_id FROM clusters)
"""


C48 = clusters(48)
oracle("reconcile_clusters", C48 + "SELECT norm_title, cluster_id, items, existing_video_id, published_at FROM clusters",
       "video", "catalog_source", recursive=True)
oracle("canonical_videos", C48 + """SELECT new_id AS id, title, description, published_at, 0 AS is_locked FROM placed WHERE existing_video_id IS NULL""",
       "video", "catalog_source", recursive=True)
oracle("reconcile_links", C48 + """SELECT i.id, i.cluster_id, i.video_id AS old_video_id, p.new_id AS new_video_id
FROM items i JOIN placed p ON p.cluster_id = i.cluster_id WHERE i.video_id IS DISTINCT FROM p.new_id""",
       "video", "catalog_source", recursive=True)
oracle("reconcile_report", clusters(72) + """SELECT (SELECT count(*) FROM placed) AS clusters,
  (SELECT count(*) FROM placed WHERE existing_video_id IS NULL) AS created_videos,
  (SELECT count(*) FROM items i JOIN placed p ON p.cluster_id = i.cluster_id WHERE i.video_id IS DISTINCT FROM p.new_id) AS linked_sources,
  cast(0 AS bigint) AS applied_overrides""", "video", "catalog_source", recursive=True)
oracle("overrides_applied", """, last AS (
SELECT * FROM reconcile_override WHERE (action = 'LINK' AND target_video_id IS NOT NULL) OR action = 'UNLINK'
QUALIFY row_number() OVER (PARTITION BY source_video_id ORDER BY id DESC) = 1)
SELECT c.id, CASE WHEN l.id IS NULL THEN c.video_id WHEN l.action = 'LINK' THEN l.target_video_id END AS video_id
FROM catalog_source c LEFT JOIN last l ON l.source_video_id = c.id""", "catalog_source", "reconcile_override")
oracle("override_requests", """, o AS (
SELECT r.*, upper(r.action) AS act, s.id AS sid FROM override_request r
LEFT JOIN source_video s ON s.platform = r.source_platform AND s.platform_video_id = r.source_platform_id),
k AS (
SELECT *, CASE WHEN source_platform_id = '' OR act NOT IN ('LINK', 'UNLINK') OR (act = 'LINK' AND target_video_id IS NULL) THEN 'invalid'
  WHEN sid IS NULL THEN 'unknown' ELSE 'applied' END AS outcome FROM o)
SELECT seq, source_platform, source_platform_id, CASE WHEN outcome <> 'invalid' THEN sid END AS source_video_id, act AS action, target_video_id, outcome FROM k""",
       "source_video", "override_request")
oracle("appended_overrides", """, o AS (
SELECT r.seq, s.id AS source_video_id, upper(r.action) AS action, r.target_video_id FROM override_request r
JOIN source_video s ON s.platform = r.source_platform AND s.platform_video_id = r.source_platform_id
WHERE r.source_platform_id <> '' AND (upper(r.action) = 'UNLINK' OR (upper(r.action) = 'LINK' AND r.target_video_id IS NOT NULL)))
SELECT 1000 + row_number() OVER (ORDER BY seq) AS id, source_video_id, action, target_video_id FROM o""", "source_video", "override_request")
CHECKED = """, given AS (SELECT * FROM resolution WHERE keep_id <> delete_id),
odd AS (SELECT CASE source_id % 3 WHEN 0 THEN keep_id + 1000000 ELSE keep_id END AS keep_id, delete_id,
  CASE source_id % 3 WHEN 1 THEN source_id + 1000000 ELSE source_id END AS source_id FROM given WHERE source_id % 5 = 0),
proposed AS (SELECT keep_id, delete_id, source_id FROM given WHERE source_id % 5 <> 0 UNION ALL SELECT * FROM odd UNION ALL SELECT * FROM odd WHERE source_id % 3 = 2),
vids AS (SELECT DISTINCT id // 4 AS id FROM catalog_source),
own AS (SELECT *, CASE WHEN keep_id NOT IN (SELECT id FROM vids) OR delete_id NOT IN (SELECT id FROM vids) THEN 'unknown video'
  WHEN source_id NOT IN (SELECT id FROM catalog_source) THEN 'unknown source'
  WHEN count(*) OVER (PARTITION BY source_id) > 1 THEN 'source named twice' END AS mine FROM proposed),
checked AS (
SELECT keep_id, delete_id, source_id, coalesce(mine, CASE WHEN EXISTS (SELECT 1 FROM own x WHERE x.mine IS NULL AND x.delete_id = p.keep_id) THEN 'kept video is deleted' END) AS problem
FROM own p)
"""
oracle("resolution_checks", CHECKED + "SELECT * FROM checked", "catalog_source", "resolution")
oracle("resolve_duplicate", CHECKED + """SELECT c.id, CASE WHEN k.keep_id IS NOT NULL THEN k.keep_id
  WHEN c.video_id IN (SELECT delete_id FROM checked WHERE problem IS NULL) THEN NULL ELSE c.video_id END AS video_id
FROM catalog_source c LEFT JOIN (SELECT * FROM checked WHERE problem IS NULL) k ON k.source_id = c.id""", "catalog_source", "resolution")
oracle("duplicate_pairs", """, pairs AS (
SELECT a.id AS s1_id, b.id AS s2_id, cast(abs(epoch(a.published_at) - epoch(b.published_at)) AS bigint) AS d,
  a.video_id AS s1_video_id, a.title AS s1_title, a.published_at AS s1_published_at, a.duration_seconds AS s1_duration_seconds,
  b.video_id AS s2_video_id, b.title AS s2_title, b.published_at AS s2_published_at, b.duration_seconds AS s2_duration_seconds
FROM catalog_source a JOIN catalog_source b ON b.id > a.id
  AND b.published_at BETWEEN a.published_at - interval 48 hour AND a.published_at + interval 48 hour
  AND (a.duration_seconds IS NULL OR b.duration_seconds IS NULL OR abs(a.duration_seconds - b.duration_seconds) < 60)
WHERE a.video_id IS NULL OR b.video_id IS NULL OR a.video_id <> b.video_id)
SELECT * EXCLUDE (d), round(d / 3600, 6) AS delta_h FROM pairs ORDER BY d, s1_id, s2_id LIMIT 200""", "catalog_source")

# ---- health ----------------------------------------------------------------
FRESH = """, fresh AS (
SELECT sv.platform, max(ms.snapshot_at) AS last_snapshot_at, count(DISTINCT sv.id) AS source_count
FROM source_video sv LEFT JOIN metric_snapshot ms ON ms.source_video_id = sv.id WHERE sv.is_active = 1 GROUP BY 1)
"""
HEALTH = """, ev AS (
SELECT *, CASE WHEN outcome = 'SUCCESS' AND token_expires_at <= date_trunc('second', happened_at) THEN 'EXPIRED' WHEN outcome = 'SUCCESS' THEN 'OK'
  WHEN regexp_matches(lower(message), '401|403|oauth|access token|invalid credential|keyinvalid|expired') THEN 'EXPIRED' ELSE 'ERROR' END AS status_now
FROM health_event),
state AS (
SELECT platform, max_by(happened_at, seq) FILTER (outcome = 'SUCCESS') AS last_success_at,
  max_by(snapshot_at, seq) FILTER (outcome = 'SUCCESS' AND snapshot_at IS NOT NULL) AS last_snapshot_at,
  CASE WHEN max_by(outcome, seq) = 'ERROR' THEN max_by(happened_at, seq) END AS last_error_at,
  CASE WHEN max_by(outcome, seq) = 'ERROR' THEN max_by(message, seq) END AS last_error,
  max_by(duration_ms, seq) AS last_duration_ms, max_by(items, seq) FILTER (outcome = 'SUCCESS') AS last_items,
  max_by(status_now, seq) AS token_status,
  max_by({'x': token_expires_at}, seq) FILTER (outcome = 'SUCCESS' OR token_expires_at IS NOT NULL).x AS token_expires_at
FROM ev GROUP BY platform)
""".replace("max_by({'x': token_expires_at}, seq) FILTER (outcome = 'SUCCESS' OR token_expires_at IS NOT NULL).x",
            "(max_by({'x': token_expires_at}, seq) FILTER (outcome = 'SUCCESS' OR token_expires_at IS NOT NULL)).x")
oracle("platform_freshness", FRESH + "SELECT * FROM fresh", "source_video", "metric_snapshot")
oracle("platform_health", HEALTH + "SELECT * FROM state", "health_event")
CLOCK = "strftime({}, '%Y-%m-%d %H:%M:%S.%g')"
STATUS = FRESH + HEALTH + f""", a AS (
SELECT coalesce(f.platform, s.platform) AS platform, coalesce(f.source_count, 0) AS source_count,
  coalesce(f.last_snapshot_at, s.last_snapshot_at) AS last_snapshot_at, s.last_success_at, s.last_error_at, s.last_error,
  s.last_duration_ms, s.last_items, s.token_expires_at, coalesce(s.token_status, 'UNKNOWN') AS token0,
  epoch(s.token_expires_at) - epoch({NOW}) AS secs,
  round(greatest(0, epoch({NOW}) - epoch(date_trunc('second', coalesce(f.last_snapshot_at, s.last_snapshot_at)))) / 3600, 1) AS snapshot_age_hours,
  round(greatest(0, epoch({NOW}) - epoch(date_trunc('second', s.last_success_at))) / 3600, 1) AS success_age_hours
FROM fresh f FULL JOIN state s ON s.platform = f.platform),
b AS (
SELECT *, CASE WHEN secs <= 0 THEN 'ERROR' WHEN secs <= 1209600 THEN 'WARNING' ELSE 'OK' END AS st1,
  CASE WHEN secs <= 0 THEN 'EXPIRED' WHEN secs <= 1209600 THEN 'WARNING' ELSE token0 END AS token_status,
  CASE WHEN secs <= 0 THEN 'Token ' || platform || ' expiré depuis le ' || {CLOCK.format("token_expires_at")} || '.'
    WHEN secs <= 1209600 THEN 'Token ' || platform || ' expire le ' || {CLOCK.format("token_expires_at")} || '.' END AS m1 FROM a),
c AS (
SELECT *, CASE WHEN token_status IN ('EXPIRED', 'ERROR') THEN 'ERROR' WHEN last_error IS NOT NULL AND st1 = 'OK' THEN 'WARNING' ELSE st1 END AS st2,
  CASE WHEN token_status = 'EXPIRED' AND last_error_at IS NOT NULL THEN 'Token ' || platform || ' expiré ou refusé depuis le ' || {CLOCK.format("last_error_at")} || '.'
    WHEN token_status = 'EXPIRED' THEN 'Token ' || platform || ' expiré ou refusé par la plateforme.'
    WHEN token_status = 'ERROR' THEN platform || ' : ' || coalesce(last_error, 'erreur de collecte')
    WHEN last_error IS NOT NULL THEN platform || ' : ' || last_error END AS m2 FROM b),
d AS (
SELECT *, CASE WHEN source_count > 0 AND last_snapshot_at IS NULL THEN 'ERROR' ELSE st2 END AS st3,
  CASE WHEN source_count > 0 AND last_snapshot_at IS NULL THEN platform || ' possède ' || source_count || ' source(s) active(s), mais aucun snapshot.' END AS m3 FROM c),
e AS (
SELECT *, CASE WHEN last_success_at IS NULL THEN CASE WHEN source_count > 0 AND st3 = 'OK' THEN 'WARNING' ELSE st3 END
    WHEN success_age_hours >= 72 THEN 'ERROR' WHEN success_age_hours >= 26 AND st3 = 'OK' THEN 'WARNING' ELSE st3 END AS st4,
  CASE WHEN last_success_at IS NULL THEN CASE WHEN source_count > 0 THEN platform || ' : aucun succès de collecte rapporté.' END
    WHEN success_age_hours >= 72 THEN platform || ' : aucun succès de collecte depuis le ' || {CLOCK.format("last_success_at")} || '.'
    WHEN success_age_hours >= 26 AND st3 = 'OK' THEN platform || ' : dernière collecte réussie le ' || {CLOCK.format("last_success_at")} || '.' END AS m4 FROM d),
g AS (
SELECT *, CASE WHEN snapshot_age_hours >= 72 AND success_age_hours < 26 AND st4 = 'OK' THEN 'WARNING' ELSE st4 END AS status,
  CASE WHEN snapshot_age_hours >= 72 AND success_age_hours < 26 AND st4 = 'OK'
    THEN platform || ' : collecte récente, mais aucune métrique utile n’a changé depuis le ' || {CLOCK.format("last_snapshot_at")} || '.' END AS m5 FROM e)
"""
oracle("platform_status", STATUS + """SELECT platform, status, token_status, token_expires_at, last_success_at, success_age_hours, last_snapshot_at,
  snapshot_age_hours, last_duration_ms, last_items, last_error_at, last_error, source_count, coalesce(m1, m2, m3, m4, m5) AS message FROM g""",
       "source_video", "metric_snapshot", "health_event")
oracle("health_alerts", STATUS + """SELECT DISTINCT message FROM (SELECT unnest([m1, m2, m3, m4, m5]) AS message FROM g) WHERE message IS NOT NULL""",
       "source_video", "metric_snapshot", "health_event")
RUNS = """, runs AS (
SELECT run_id, arg_min(started_at, seq) AS started_at, max_by({'x': finished_at}, seq).x AS finished_at,
  max_by(greatest(0, duration_ms), seq) AS duration_ms, max_by(upper(status), seq) AS status, max_by(items, seq) AS items,
  max_by({'x': message}, seq).x AS error FROM batch_event GROUP BY run_id)
"""
oracle("batch_runs", RUNS + "SELECT * FROM runs", "batch_event")
oracle("last_runs", RUNS + "SELECT * FROM runs ORDER BY started_at DESC NULLS LAST, run_id DESC LIMIT 1", "batch_event")
GAPS = """, gaps AS (
SELECT id, source_video_id, snapshot_at, lag(snapshot_at) OVER (PARTITION BY source_video_id ORDER BY snapshot_at, id) AS prev_snapshot_at FROM metric_snapshot),
wide AS (SELECT *, cast(epoch(date_trunc('second', snapshot_at)) - epoch(date_trunc('second', prev_snapshot_at)) AS bigint) AS gap_seconds FROM gaps)
"""
oracle("gaps_3h", GAPS + "SELECT * FROM wide WHERE gap_seconds > 10800", "metric_snapshot")
oracle("collection_quality", GAPS + """, lat AS (
SELECT sv.platform, round(avg(epoch_ms(ms.created_at) - epoch_ms(ms.snapshot_at)) / 1000, 6) AS mean_latency_seconds
FROM metric_snapshot ms JOIN source_video sv ON sv.id = ms.source_video_id GROUP BY 1),
mis AS (SELECT sv.platform, count(*) AS missing_windows FROM wide w JOIN source_video sv ON sv.id = w.source_video_id WHERE gap_seconds > 10800 GROUP BY 1),
err AS (SELECT platform, round(avg(CASE WHEN outcome <> 'SUCCESS' THEN 1.0::double ELSE 0.0::double END), 6) AS error_rate FROM health_event GROUP BY 1)
SELECT platform, mean_latency_seconds, coalesce(missing_windows, 0) AS missing_windows, error_rate
FROM lat FULL JOIN mis USING (platform) FULL JOIN err USING (platform)""", "source_video", "metric_snapshot", "health_event")

# ---- quality ---------------------------------------------------------------
POINTS = """, pts AS (
SELECT id, source_video_id, snapshot_at, views_native, lag(views_native) OVER w AS prev_views_native,
  max(views_native) OVER (PARTITION BY source_video_id ORDER BY snapshot_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top_before
FROM metric_snapshot WHERE views_native IS NOT NULL WINDOW w AS (PARTITION BY source_video_id ORDER BY snapshot_at, id))
"""
oracle("anomalies", POINTS + """SELECT 'regression' AS kind, source_video_id, id AS snapshot_id FROM pts WHERE views_native < prev_views_native
UNION ALL SELECT 'suspicious_zero', source_video_id, id FROM pts WHERE views_native = 0 AND top_before > 0
UNION ALL SELECT 'orphan_source', id, NULL FROM source_video WHERE video_id IS NULL
UNION ALL SELECT 'duplicate_point', source_video_id, max(id) FROM metric_snapshot GROUP BY source_video_id, snapshot_at HAVING count(*) > 1
UNION ALL SELECT 'source_without_metrics', id, NULL FROM source_video s WHERE NOT EXISTS (SELECT 1 FROM metric_snapshot m WHERE m.source_video_id = s.id)""",
       "source_video", "metric_snapshot")
oracle("cleaned_points", POINTS + """SELECT m.id, m.source_video_id, m.snapshot_at,
  CASE WHEN p.views_native = 0 AND p.top_before > 0 THEN NULL ELSE m.views_native END AS views_native
FROM metric_snapshot m LEFT JOIN pts p ON p.id = m.id""", "metric_snapshot")
oracle("milestones", POINTS + """SELECT id, source_video_id, snapshot_at, views_native, prev_views_native, (views_native // 1000) * 1000 AS milestone
FROM pts WHERE views_native // 1000 > coalesce(prev_views_native // 1000, 0)""", "metric_snapshot")
oracle("retention_points", f""", aged AS (
SELECT id, source_video_id, snapshot_at, date_sub('day', snapshot_at, {NOW}) AS age FROM metric_snapshot)
SELECT id, source_video_id, snapshot_at FROM aged WHERE age < 7
UNION ALL SELECT id, source_video_id, snapshot_at FROM (SELECT * FROM aged WHERE age >= 7 AND age < 21
  QUALIFY row_number() OVER (PARTITION BY source_video_id, cast(snapshot_at AS date) ORDER BY snapshot_at DESC, id DESC) = 1)
UNION ALL SELECT id, source_video_id, snapshot_at FROM (SELECT * FROM aged WHERE age >= 21
  QUALIFY row_number() OVER (PARTITION BY source_video_id, date_trunc('week', snapshot_at) ORDER BY snapshot_at DESC, id DESC) = 1)""", "metric_snapshot")
oracle("stale_sources", """SELECT sv.id AS source_video_id, sv.platform, max(ms.snapshot_at) AS last_snapshot_at
FROM source_video sv LEFT JOIN metric_snapshot ms ON ms.source_video_id = sv.id WHERE sv.is_active = 1
GROUP BY 1, 2 HAVING max(ms.snapshot_at) IS NULL OR max(ms.snapshot_at) < timestamp '2024-01-29 12:00:00'""", "source_video", "metric_snapshot")

# ---- landed payloads: the same values straight from the events -------------
ORACLES["insights_flat"] = """SELECT cast(event_id AS varchar) AS id, 'views' AS name, event_id AS value FROM events
UNION ALL SELECT cast(event_id AS varchar), 'share', (event_id % 97) * 10000 + 2500 FROM events
UNION ALL SELECT cast(event_id AS varchar), 'react_like', user_id FROM events
UNION ALL SELECT cast(event_id AS varchar), 'react_a_b', 12 FROM events
UNION ALL SELECT cast(event_id AS varchar), 'arr_0', event_id % 7 FROM events
UNION ALL SELECT cast(event_id AS varchar), 'arr_1_x', 2 FROM events"""
ORACLES["instagram_insights"] = """SELECT cast(event_id AS varchar) AS id, 'views' AS name, event_id AS value FROM events
UNION ALL SELECT cast(event_id AS varchar), 'reach', user_id FROM events"""
ORACLES["youtube_rows"] = """, """.join(["""WITH e AS (SELECT *, (event_id % 3) * 60 + event_id % 59 AS s FROM events)
SELECT 'YOUTUBE' AS platform, CASE WHEN s <= 61 THEN 'SHORT' ELSE 'VIDEO' END AS platform_format, 'yt' || event_id AS platform_video_id""",
    f"{NOW} AS snapshot_at", "event_id AS views_native", "user_id AS likes", "cast(0 AS bigint) AS reactions_love",
    "cast(NULL AS bigint) AS comments", "s AS video_length_seconds",
    "CASE WHEN s <= 60 THEN 'SHORT' ELSE 'VIDEO' END AS source_format", "event_type AS title",
    "'https://www.youtube.com/watch?v=yt' || event_id AS url", "timestamp '2024-01-05 10:00:00' AS published_at",
    "cast(s AS int) AS duration_seconds FROM e"])
ORACLES["wire_items"] = f"""WITH i AS (
SELECT event_id, 0 AS item_pos, CASE WHEN event_id % 11 = 0 THEN 'skipped_no_video_id' WHEN event_id % 5 = 4 THEN 'bad_instant' END AS problem,
  CASE WHEN event_id % 3 = 0 THEN 'FACEBOOK' ELSE 'YOUTUBE' END AS platform, CASE WHEN event_id % 4 = 0 THEN 'REEL' END AS platform_format,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE 'pv' || user_id END AS platform_video_id,
  CASE event_id % 5 WHEN 0 THEN timestamp '2024-01-01 10:00:00' WHEN 1 THEN timestamp '2024-01-01 10:00:00.25'
    WHEN 2 THEN timestamp '2024-01-01 10:00:00.5' WHEN 3 THEN {NOW} END AS snapshot_at,
  CASE WHEN event_id % 3 = 0 AND event_id % 4 <> 0 THEN event_id END AS views_native, greatest(0, event_id % 100 - 3) AS likes, event_id % 10 AS avg_watch_seconds
FROM events)
SELECT * FROM i UNION ALL SELECT event_id, 1, 'skipped_not_an_object', 'YOUTUBE', NULL, NULL, {NOW}, NULL, NULL, NULL FROM events"""

ORACLES["source_items"] = """SELECT event_id, 0 AS item_pos, cast(NULL AS varchar) AS problem, 'YOUTUBE' AS platform,
  CASE WHEN event_id % 3 = 0 THEN 'REEL' ELSE 'VIDEO' END AS platform_format, 'pv' || user_id AS platform_video_id, '/p/' || event_id AS url,
  CASE WHEN event_id % 7 <> 0 THEN timestamp '2024-01-05 08:00:00' END AS published_at, cast(event_id % 500 AS int) AS duration_seconds FROM events
UNION ALL SELECT event_id, 1, 'skipped_not_an_object', 'YOUTUBE', 'VIDEO', NULL, NULL, NULL, NULL FROM events"""
ORACLES["facebook_rows"] = """SELECT cast(event_id AS varchar) AS platform_video_id, event_id AS views_native, CASE WHEN event_id % 2 = 1 THEN event_id END AS legacy_views_3s,
  cast(0 AS bigint) AS avg_watch_seconds, event_id // 1000 AS total_watch_seconds, event_id % 90 + 1 AS video_length_seconds, cast(NULL AS bigint) AS likes,
  user_id AS reactions_like, user_id AS comments, cast(NULL AS bigint) AS reach,
  CASE WHEN event_id % 5 = 0 OR event_id % 90 + 1 <= 60 THEN 'REEL' ELSE 'VIDEO' END AS platform_format,
  CASE WHEN event_id % 4 <> 0 THEN event_type WHEN length(event_type) * 40 > 160 THEN left(repeat(event_type, 40), 157) || '...' ELSE repeat(event_type, 40) END AS title,
  timestamp '2024-01-05 10:00:00' AS published_at, cast(event_id % 90 + 1 AS int) AS duration_seconds FROM events"""
ORACLES["facebook_rows_older"] = f"""SELECT cast(event_id AS varchar) AS platform_video_id, {NOW} AS snapshot_at,
  CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END AS views_native, cast(0 AS bigint) AS comments, cast(0 AS bigint) AS shares,
  'VIDEO' AS platform_format, CASE WHEN event_id % 4 = 0 THEN '(sans titre)' ELSE event_type END AS title FROM events"""
ORACLES["instagram_rows"] = f"""SELECT 'INSTAGRAM' AS platform, CASE WHEN event_id % 4 = 0 THEN 'REEL' ELSE 'VIDEO' END AS platform_format,
  cast(event_id AS varchar) AS platform_video_id, left(repeat(event_type, 30), 140) AS title, repeat(event_type, 30) AS description, cast(NULL AS varchar) AS url,
  timestamp '2024-01-01 10:00:00' + to_days(cast(event_id % 28 AS int)) AS published_at, {NOW} AS snapshot_at,
  CASE WHEN event_id % 2 = 0 THEN event_id + 7 ELSE event_id END AS views_native, CASE WHEN event_id % 2 = 1 THEN user_id END AS likes,
  cast(NULL AS bigint) AS comments, cast(NULL AS bigint) AS shares, cast(NULL AS bigint) AS reach FROM events
WHERE (event_id % 4 = 0 OR event_id % 3 <> 0) AND event_id % 28 + 1 >= 10"""
ORACLES["discovered_ids"] = """WITH a AS (
SELECT 0 AS feed, CASE WHEN event_id % 2 = 0 OR event_id % 3 = 0 THEN 't' || user_id ELSE 'm' || event_id % 300 END AS id FROM events
UNION ALL SELECT 1, 't' || (user_id + 3) FROM events UNION ALL SELECT 1, 'u' || event_id % 40 FROM events)
SELECT id, min(feed) AS feed FROM a GROUP BY id"""
ORACLES["playlist_ids"] = "SELECT 'y' || event_id AS id FROM events WHERE event_id % 6 <> 0"
ORACLES["foreign_series"] = """SELECT event_id, CASE event_id % 3 WHEN 0 THEN (1704067200 + event_id) * 1000 WHEN 1 THEN 1704067200000 + event_id ELSE 1704067200000 END AS ts_ms,
  cast(CASE event_id % 3 WHEN 0 THEN event_id WHEN 1 THEN user_id ELSE event_id + 0.5 END AS double) AS value FROM events"""
# Zurich is one hour ahead of UTC all through the month of the events.
oracle("zurich_times", "SELECT id, published_at + interval 1 hour AS local_published_at FROM video", "video")

# ---- written and read back, composed views ---------------------------------
oracle("stored_versions", "SELECT id, slug, duration_seconds FROM video", "video")
oracle("exported_points", "SELECT id, source_video_id, snapshot_at, views_native, likes FROM metric_snapshot", "metric_snapshot")
oracle("refreshed_rollup", TABLE + f"SELECT * {ROUNDED} FROM stored", *BASE)
oracle("found_videos", """SELECT 'id' AS found_by, id, slug FROM video WHERE id = 1 UNION ALL SELECT 'slug', id, slug FROM video WHERE slug = 'v-2'
UNION ALL SELECT 'publication', v.id, v.slug FROM video v WHERE v.id IN (SELECT video_id FROM source_video WHERE platform = 'TIKTOK' AND platform_video_id = 'pv3')""",
       "video", "source_video")
oracle("dry_run", C48 + "SELECT count(*) AS clusters FROM clusters", "video", "catalog_source", recursive=True)
oracle("video_detail_parts", LATEST + """, own AS (SELECT id FROM source_video WHERE video_id = 1)
SELECT 'video' AS part, cast(id AS bigint) AS id FROM video WHERE id = 1 UNION ALL SELECT 'source', id FROM own
UNION ALL SELECT 'latest', id FROM latest WHERE source_video_id IN (FROM own)
UNION ALL SELECT 'point', id FROM (SELECT id FROM metric_snapshot WHERE source_video_id IN (FROM own)
  QUALIFY row_number() OVER (PARTITION BY source_video_id ORDER BY snapshot_at DESC, id DESC) <= 5)""", *BASE)
oracle("video_series_view", SERIES + """, both_series AS (
SELECT video_id, platform, ts, value FROM series UNION ALL SELECT video_id, 'ALL', ts, sum(value) FROM series GROUP BY ALL),
run AS (SELECT video_id, platform, ts, cast(sum(value) OVER (PARTITION BY video_id, platform ORDER BY ts) AS bigint) AS value FROM both_series)
SELECT video_id, platform, ts, value FROM (
SELECT *, row_number() OVER (PARTITION BY video_id, platform ORDER BY ts) AS i, count(*) OVER (PARTITION BY video_id, platform) AS n FROM run)
WHERE (i - 1) % greatest(1, cast(ceil(n / 20.0) AS bigint)) = 0 OR i = n""", *BASE)
oracle("fuzzy_titles", r"""SELECT id, trim(regexp_replace(lower(concat_ws(' ', title, 'Été_-2')), '[^a-z0-9]+', ' ', 'g')) AS fuzzy_title FROM catalog_source""",
       "catalog_source")
ORACLES["unsigned_counts"] = """SELECT event_id, CASE event_id % 5 WHEN 1 THEN 0 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE event_id END AS count,
  event_id % 5 = 2 AS rejected FROM events"""
ORACLES["hms_values"] = """SELECT event_id, cast(CASE event_id % 4 WHEN 0 THEN event_id % 7 * 3600 + user_id % 60 * 60 + event_id % 60
  WHEN 1 THEN user_id % 90 * 60 + event_id % 60 ELSE 0 END AS double) AS seconds FROM events"""
ORACLES["first_discovered"] = """WITH a AS (SELECT event_id, 0 AS k, 't' || (user_id + 3) AS id FROM events UNION ALL SELECT event_id, 1, 'u' || event_id % 400 FROM events),
f AS (SELECT id, min(event_id * 2 + k) AS first FROM a GROUP BY id)
SELECT id, 0 AS feed FROM f ORDER BY first LIMIT 100"""


# ---- fuzzy similarity -------------------------------------------------------
def jaro_winkler(name: str, a: str, b: str, source: str) -> str:
    """CTEs that end in ``name`` (a, b, jw): Jaro-Winkler of the distinct text pairs of ``source``. ``took`` has,
    for each letter of the shorter text, the place of the letter taken in the longer one, 0 for none."""
    return f"""{name}_s AS (SELECT DISTINCT {a} AS a, {b} AS b FROM {source}),
{name}_x AS (SELECT *, string_split(CASE WHEN length(a) > length(b) THEN b ELSE a END, '') AS x, string_split(CASE WHEN length(a) > length(b) THEN a ELSE b END, '') AS y FROM {name}_s),
{name}_r AS (SELECT *, greatest(len(y) // 2 - 1, 0) AS reach FROM {name}_x),
{name}_u AS (SELECT *, list_reduce(list_transform(range(1, len(x) + 1), lambda i: [i]), lambda st, i: list_append(st,
  coalesce(list_filter(range(greatest(1, i[1] - reach), least(len(y), i[1] + reach) + 1), lambda j: y[j] = x[i[1]] AND NOT list_contains(st, j))[1], 0)),
  []::BIGINT[]) AS took FROM {name}_r),
{name}_h AS (SELECT *, list_filter(took, lambda j: j > 0) AS hit FROM {name}_u),
{name}_m AS (SELECT *, len(hit) AS m, list_sum(list_transform(list_zip(
  list_transform(list_filter(range(1, len(x) + 1), lambda i: took[i] > 0), lambda i: x[i]), list_transform(list_sort(hit), lambda j: y[j])),
  lambda z: (z[1] <> z[2])::INT)) / 2.0 AS moved FROM {name}_h),
{name}_j AS (SELECT *, CASE WHEN a = b THEN 1 WHEN m = 0 OR a = '' OR b = '' THEN 0 ELSE (m / len(x) + m / len(y) + (m - moved) / m) / 3 END AS jaro FROM {name}_m),
{name} AS (SELECT a, b, CASE WHEN jaro < 0.7 THEN jaro ELSE jaro + 0.1 * (1 - jaro) * coalesce(list_filter(range(0, 5),
  lambda k: left(a, k) = left(b, k) AND k <= least(length(a), length(b)))[-1], 0) END AS jw FROM {name}_j)"""


FUZZY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
SIMILAR = f""", texts AS (
SELECT id, {FUZZY.format('title')} AS t, {FUZZY.format('description')} AS d, epoch_ms(published_at) AS at FROM catalog_source),
candidates AS (
SELECT a.id AS a_id, b.id AS b_id, a.t AS a_t, b.t AS b_t, a.d AS a_d, b.d AS b_d, abs(a.at - b.at) // 3600000 AS hours FROM texts a JOIN texts b ON a.id < b.id),
{jaro_winkler('tj', 'a_t', 'b_t', 'candidates')},
{jaro_winkler('dj', 'a_d', 'b_d', 'candidates')},
scored AS (
SELECT a_id, b_id, tj.jw AS title_score, CASE WHEN a_d = '' OR b_d = '' THEN 0 ELSE dj.jw END AS description_score,
  CASE WHEN hours <= 72 THEN 0.1 * (1 - hours / 72) ELSE 0 END AS bonus
FROM candidates JOIN tj ON tj.a = a_t AND tj.b = b_t JOIN dj ON dj.a = a_d AND dj.b = b_d),
linked AS (
SELECT a_id, b_id, title_score, description_score, greatest(0, least(1, 0.6 * title_score + 0.3 * description_score + bonus)) AS score
FROM scored WHERE 0.6 * title_score + 0.3 * description_score + bonus >= 0.78)
"""
oracle("similar_pairs", SIMILAR + """SELECT a_id, b_id, round(title_score, 6) AS title_score, round(description_score, 6) AS description_score,
  round(score, 6) AS score FROM linked""", "catalog_source")
oracle("similar_counts", SIMILAR + """, sides AS (
SELECT DISTINCT a_id AS id, b_id AS other, title_score, description_score FROM linked UNION SELECT b_id, a_id, title_score, description_score FROM linked),
counts AS (SELECT id, count(*) AS n_links, round(avg(title_score), 6) AS title_score, round(avg(description_score), 6) AS description_score FROM sides GROUP BY id)
SELECT s.id, s.class_id, coalesce(c.n_links, 0) AS n_links, c.title_score, c.description_score
FROM (SELECT DISTINCT x.id, x.t, x.d, x.at, min(x.id) OVER (PARTITION BY x.t, x.d) AS class_id FROM texts x) s LEFT JOIN counts c ON c.id = s.id""", "catalog_source")
oracle("similar_components", SIMILAR + """, links AS MATERIALIZED (SELECT a_id AS x, b_id AS y FROM linked UNION SELECT b_id, a_id FROM linked),
reach AS (SELECT id AS x, id AS label FROM catalog_source UNION SELECT l.y, r.label FROM reach r JOIN links l ON l.x = r.x)
SELECT x AS id, min(label) AS component FROM reach GROUP BY x""", "catalog_source", recursive=True)

oracle("overview_engagement", LATEST + """SELECT sv.video_id, sv.platform, (arg_min({'f': sv.platform_format}, sv.id)).f AS platform_format,
  cast(coalesce(sum(coalesce(l.views_native, l.reach)), 0) AS bigint) AS views, cast(coalesce(sum(l.total_watch_seconds), 0) AS bigint) AS total_watch_seconds,
  cast(coalesce(sum(l.likes), 0) AS bigint) AS likes, cast(coalesce(sum(l.reactions_love), 0) AS bigint) AS reactions_love,
  cast(coalesce(sum(l.comments), 0) AS bigint) AS comments, cast(coalesce(sum(l.shares), 0) AS bigint) AS shares,
  cast(sum(CASE WHEN sv.platform = 'FACEBOOK' THEN coalesce(l.reactions_total, 0) + coalesce(l.comments, 0) + coalesce(l.shares, 0)
    ELSE coalesce(l.likes, 0) + coalesce(l.comments, 0) END) AS bigint) AS engagement, any_value(v.title) AS title
FROM latest l JOIN source_video sv ON sv.id = l.source_video_id LEFT JOIN video v ON v.id = sv.video_id
WHERE sv.video_id IS NOT NULL GROUP BY sv.video_id, sv.platform""", *BASE)


def all_sorts() -> str:
    views = {"views": "views_native_sum", "youtube": "views_yt", "facebook": "views_fb", "instagram": "views_ig", "tiktok": "views_tt"}
    orders = {}
    for key, c in views.items():
        orders[f"{key}_desc"] = f"{c} DESC NULLS LAST, video_published_at DESC NULLS LAST, video_id DESC"
        orders[f"{key}_asc"] = f"{c} NULLS FIRST, video_published_at NULLS FIRST, video_id"
    for key, c in {"engagement": "engagement_rate_sum", "watch_eq": "watch_equivalent_sum"}.items():
        orders[f"{key}_desc"] = f"{c} DESC NULLS LAST, views_native_sum DESC NULLS LAST, video_id DESC"
        orders[f"{key}_asc"] = f"{c} NULLS LAST, views_native_sum NULLS FIRST, video_id"
    for key, c in {"published": "video_published_at", "title": "lower(video_title)"}.items():
        orders[f"{key}_desc"] = f"{c} DESC NULLS LAST, video_id DESC"
        orders[f"{key}_asc"] = f"{c} NULLS FIRST, video_id"
    parts = [
        f"SELECT '{name}' AS sort, rank, video_id FROM (SELECT video_id, row_number() OVER (ORDER BY {order}) AS rank FROM stored)"
        for name, order in orders.items()
    ]
    return " UNION ALL ".join(parts)


oracle("all_sorts", TABLE + all_sorts(), *BASE)
oracle("overview_alerts", DELTAS + """SELECT s.source_video_id, s.views_now, round(delta, 4) AS delta, round(growth, 4) AS growth, sv.video_id, sv.platform
FROM deltas s JOIN source_video sv ON sv.id = s.source_video_id WHERE sv.video_id IS NOT NULL AND delta IS NOT NULL AND sv.platform = 'YOUTUBE'
ORDER BY s.delta DESC, s.source_video_id LIMIT 20""", "source_video", "metric_snapshot")


# ---- whole jobs and documents ------------------------------------------------
ORACLES["refreshed_tables"] = f"""SELECT 'video_rollup' AS part, video_id, NULL AS platform, NULL AS age, round(cast(views_native_sum AS double), 6) AS value FROM ({ORACLES["refreshed_rollup"]})
UNION ALL SELECT 'aligned_raw_hour', video_id, source, age_bucket, round(cast(views_cum AS double), 6) FROM ({ORACLES["aligned_raw"]})
UNION ALL SELECT 'aligned_dense_hour', video_id, source, age_bucket, round(cast(views_cum AS double), 6) FROM ({ORACLES["aligned_dense"]})
UNION ALL SELECT 'bands_hour', NULL, source, age_bucket, round(cast(p50_views AS double), 6) FROM ({ORACLES["percentile_bands"]})"""
ORACLES["refreshed_changes"] = ORACLES["refreshed_tables"]  # changes only, yet the rows of a full refresh
oracle("ingested_items", WALK.replace("FROM snapshot_feed)", "FROM snapshot_feed WHERE arrival_seq % 13 <> 0 AND arrival_seq % 29 <> 0)") + """,
told AS (SELECT count(*) AS ok, count(*) FILTER (stored) AS stored, count(*) FILTER (NOT stored) AS skipped, cast(sum(corrections) AS bigint) AS corrections FROM walk),
bad AS (SELECT arrival_seq, views_native FROM snapshot_feed WHERE arrival_seq % 13 = 0)
SELECT 'decided' AS sink, arrival_seq, reason, stored, views_native FROM walk
UNION ALL SELECT 'rejected', arrival_seq, 'bad_instant', false, views_native FROM bad
UNION ALL SELECT 'report', NULL, unnest(['ok', 'ko', 'stored', 'skipped', 'monotonic_corrections']), NULL,
  unnest([ok, (SELECT count(*) FROM bad), stored, skipped, corrections]) FROM told""", "snapshot_feed", recursive=True)
oracle("health_document_rows", STATUS + RUNS + """SELECT 'platform' AS part, platform AS name, status, last_success_at AS at, last_error AS message FROM g
UNION ALL SELECT DISTINCT 'alert', NULL, NULL, NULL, message FROM (SELECT unnest([m1, m2, m3, m4, m5]) AS message FROM g) WHERE message IS NOT NULL
UNION ALL (SELECT 'batch', run_id, status, finished_at, error FROM runs ORDER BY started_at DESC NULLS LAST, run_id DESC LIMIT 1)""",
       "source_video", "metric_snapshot", "health_event", "batch_event")
oracle("refresh_triggers", RUNS + """, ended AS (SELECT run_id, finished_at, status,
  max(finished_at) FILTER (status = 'SUCCESS') OVER (ORDER BY finished_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous
FROM runs WHERE finished_at IS NOT NULL)
SELECT *, previous IS NULL OR epoch_ms(finished_at) - epoch_ms(previous) >= 7200000 AS due FROM ended""", "batch_event")
oracle("reconcile_with_overrides_report", """, last AS (
SELECT * FROM reconcile_override WHERE (action = 'LINK' AND target_video_id IS NOT NULL) OR action = 'UNLINK'
QUALIFY row_number() OVER (PARTITION BY source_video_id ORDER BY id DESC) = 1),
overridden AS (SELECT c.* REPLACE (CASE WHEN l.id IS NULL THEN c.video_id WHEN l.action = 'LINK' THEN l.target_video_id END AS video_id)
FROM catalog_source c LEFT JOIN last l ON l.source_video_id = c.id)""" + clusters(48).replace("FROM catalog_source", "FROM overridden") + """SELECT (SELECT count(*) FROM placed) AS clusters,
  (SELECT count(*) FROM placed WHERE existing_video_id IS NULL) AS created_videos,
  (SELECT count(*) FROM items i JOIN placed p ON p.cluster_id = i.cluster_id WHERE i.video_id IS DISTINCT FROM p.new_id) AS linked_sources,
  (SELECT count(*) FROM reconcile_override WHERE (action = 'LINK' AND target_video_id IS NOT NULL) OR action = 'UNLINK') AS applied_overrides""",
       "video", "catalog_source", "reconcile_override", recursive=True)
