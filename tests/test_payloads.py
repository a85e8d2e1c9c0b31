import json

import pytest
from pyspark.sql import functions as F

from vidmetrics import schemas
from vidmetrics.operators import ingest
from vidmetrics.plans.views import ingest_items
from vidmetrics.sources import payloads, tables

AS_OF = "2024-01-31 00:00:00"


def lines(spark, tmp_path, rows, schema, name="in"):
    path = tmp_path / f"{name}.json"
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return payloads.read_json(spark, str(path), schema)


def metric(name, *values):
    return {"name": name, "period": "lifetime", "values": [{"value": v} for v in values]}


def test_facebook_insights(spark, tmp_path):
    data = [
        metric("n", 5, 9), metric("f", 0.9811), metric("text", "12"), metric("o", {"like": 61, "a-b": 1, "t": " 12 ", "d": "0.5", "x": "y"}),
        metric("arr", [1, {"x": 2}, "3", True]), metric("b", True), metric("none"), metric("again", 1), metric("again", 2),
        metric("one", 1.5), metric("neg", -0.25),
    ]
    answers = lines(spark, tmp_path, [{"id": "v", "data": data}], schemas.FACEBOOK_INSIGHTS)
    got = {r.name: r.value for r in payloads.facebook_insights(answers).collect()}
    assert got == {
        "n": 5, "f": 9811, "o_like": 61, "o_a_b": 1, "o_t": 12, "o_d": 5000, "arr_0": 1, "arr_1_x": 2, "again": 2,
        "one": 15000, "neg": -2500,
    }


def test_instagram_insights(spark, tmp_path):
    wanted = {"views": 248, "reach": 150, "saved": 1, "likes": 7, "comments": 0, "shares": 4, "total_interactions": 12}
    data = [metric(k, v) for k, v in wanted.items()] + [metric("bad", "x"), metric("half", 1.5)]
    answers = lines(spark, tmp_path, [{"id": "m", "data": data}], schemas.INSTAGRAM_INSIGHTS)
    assert {r.name: r.value for r in payloads.instagram_insights(answers).collect()} == wanted


def test_facebook_rows(spark, tmp_path):
    videos = lines(spark, tmp_path, [
        {"id": "1", "title": " ", "description": "d" * 200, "permalink_url": "/x/Reel/1", "created_time": "2024-01-01T10:00:00+0000", "length": 100.4},
        {"id": "2", "title": "T", "description": "d", "permalink_url": "/watch/2", "length": 59.6},
        {"id": "3", "title": "U", "permalink_url": None, "length": None},
    ], schemas.FACEBOOK_VIDEO)
    got = {r.platform_video_id: r for r in payloads.facebook_sources(videos).collect()}
    assert got["1"].title == "d" * 157 + "..." and got["1"].platform_format == "REEL" and got["1"].duration_seconds == 100
    assert got["2"].platform_format == "REEL" and got["2"].duration_seconds == 60
    assert got["3"].platform_format == "VIDEO" and got["3"].published_at is None
    assert {r.title for r in payloads.facebook_sources_older(videos).collect()} == {"(sans titre)", "T", "U"}
    insights = spark.createDataFrame([
        ("1", "total_video_views", 70), ("1", "post_video_views_3s", 9), ("1", "total_video_view_total_time", 12999),
        ("1", "post_comments", 4), ("2", "total_video_views_3s", 3), ("2", "total_video_avg_time_watched", 2500),
    ], "id string, name string, value long")
    rows = {r.platform_video_id: r for r in payloads.facebook_metrics(videos, insights, as_of=AS_OF).collect()}
    assert (rows["1"].views_native, rows["1"].total_watch_seconds, rows["1"].comments, rows["1"].avg_watch_seconds) == (70, 12, 4, 0)
    assert (rows["2"].views_native, rows["2"].avg_watch_seconds) == (3, 2)
    assert rows["3"].views_native is None
    older = {r.platform_video_id: r.views_native for r in payloads.facebook_metrics_older(videos, insights, as_of=AS_OF).collect()}
    assert older == {"1": 70, "2": 0, "3": 0}
    strict = payloads.facebook_metrics(videos, insights, as_of=AS_OF, unknown_as_zero=False)
    assert strict.filter("platform_video_id = '1'").first().avg_watch_seconds is None


def test_discovery_order(spark, tmp_path):
    def att(**kw):
        return {"attachments": {"data": [kw]}}

    posts = lines(spark, tmp_path, [{"data": [
        att(media_type="video_inline", target={"id": "a", "type": "x"}),
        att(media_type="photo", target={"id": "b", "type": "VIDEO"}),
        att(media_type="album", subattachments={"data": [{"target": {"id": "c", "type": "video"}}, {"target": {"id": "no", "type": "photo"}}]}),
        att(media_type="album", subattachments={"data": []}, media={"id": "hidden"}),
        att(media={"id": "d"}), {"id": "plain"},
    ]}], schemas.FACEBOOK_POSTS, "posts").withColumn("pos", F.lit(0))
    uploads = lines(spark, tmp_path, [{"data": [{"id": "b"}, {"id": "e"}, {"id": None}]}], schemas.FACEBOOK_LISTING, "up").withColumn("pos", F.lit(0))
    found = payloads.post_video_ids(posts)
    assert [r.id for r in found.orderBy("pos").collect()] == ["a", "b", "c", "d"]
    ids = payloads.discovered_ids(found, payloads.listing_video_ids(uploads))
    assert [r.id for r in ids.collect()] == ["a", "b", "c", "d", "e"]
    assert payloads.discovered_ids(found, payloads.listing_video_ids(uploads), cap=2).count() == 2


def test_youtube(spark, tmp_path):
    item = {
        "id": "y", "snippet": {"publishedAt": "2024-01-05T10:00:00Z", "title": "T", "description": "D"},
        "contentDetails": {"duration": "PT1M1S"}, "statistics": {"viewCount": 9, "likeCount": 2, "favoriteCount": 1, "commentCount": 0},
    }
    answers = lines(spark, tmp_path, [{"items": [item]}], schemas.YOUTUBE_VIDEOS)
    m = payloads.youtube_metrics(answers, as_of=AS_OF).first()
    assert (m.platform_format, m.views_native, m.reactions_love, m.video_length_seconds) == ("SHORT", 9, 1, 61)
    s = payloads.youtube_sources(answers).first()
    assert (s.platform_format, s.duration_seconds, s.url) == ("VIDEO", 61, "https://www.youtube.com/watch?v=y")
    pages = lines(spark, tmp_path, [{"items": [{"contentDetails": {"videoId": v}} for v in ("q", " ", "p")]}], schemas.YOUTUBE_PLAYLIST, "pl")
    ids = payloads.playlist_video_ids(pages.withColumn("pos", F.lit(1)))
    assert [r.id for r in ids.orderBy("pos").collect()] == ["q", "p"]


def test_instagram_rows(spark, tmp_path):
    def media(i, **kw):
        base = {"account_id": "acc", "id": str(i), "media_type": "VIDEO", "timestamp": "2024-01-10T00:00:00+0000", "like_count": 5, "comments_count": 1, "video_view_count": 50}
        return {**base, **kw}

    rows = lines(spark, tmp_path, [
        media(1), media(2, timestamp="2023-01-01T00:00:00+0000"), media(3, media_type="IMAGE"), media(4, media_product_type="reels"),
        media(5, id=None), media(6, timestamp="bad"), media(7), media(8, caption="c" * 150),
    ], schemas.INSTAGRAM_MEDIA).withColumn("pos", F.col("id").try_cast("int"))
    insights = spark.createDataFrame([("1", "views", 99), ("1", "likes", 6)], "id string, name string, value long")
    got = {r.platform_video_id: r for r in payloads.instagram_rows(rows, insights, since="2024-01-01", as_of=AS_OF).collect()}
    assert set(got) == {"1", "4", "7", "8"} and got["4"].platform_format == "REEL"
    assert (got["1"].views_native, got["1"].likes, got["1"].comments) == (99, 6, None)
    assert (got["7"].views_native, got["7"].comments) == (50, 1) and len(got["8"].title) == 140
    capped = payloads.instagram_rows(rows, insights, since="2024-01-01", as_of=AS_OF, cap=2)
    assert {r.platform_video_id for r in capped.collect()} == {"1", "4"}


def test_metric_and_source_items(spark, tmp_path):
    batch = {"snapshots": [
        {"platform": "facebook", "platform_video_id": "f1", "snapshot_at": 1704103200, "legacy_views_3s": 8, "likes": "7 likes", "avg_watch_seconds": 3.9},
        {"platform_video_id": "y1", "views_native": -5, "platform_format": "clip", "views_3s": 4, "snapshot_at": "2024-01-01T10:00:00Z"},
        {"platform_video_id": ""}, 5, "text", None, {"platform_video_id": "z", "snapshot_at": "soon"}, {"platform": " ", "platform_video_id": "w"},
    ]}
    items = payloads.metric_items(lines(spark, tmp_path, [batch, "{broken"], schemas.SNAPSHOT_BATCH), as_of=AS_OF).orderBy("item_pos").collect()
    assert [r.problem for r in items] == [
        None, None, "skipped_no_video_id", "skipped_not_an_object", "skipped_not_an_object", "skipped_not_an_object", "bad_instant", "no_platform"]
    assert (items[0].views_native, items[0].likes, items[0].avg_watch_seconds) == (8, 7, 3)
    assert (items[1].platform, items[1].views_native, items[1].platform_format) == ("YOUTUBE", 0, None)
    sources = {"sources": [
        {"platformId": "p", "media_type": "reel", "permalink_url": "u", "publishedAt": "2024-01-01T10:00:00.900+01:00", "duration_seconds": "61.5"},
        {"platform_video_id": "q", "platform_source_id": "r", "id": "s", "platform_format": "odd", "published_at": "never"}, {"title": "none"},
    ]}
    got = payloads.source_items(lines(spark, tmp_path, [sources], schemas.SOURCE_BATCH, "s")).orderBy("item_pos").collect()
    assert (got[0].platform_video_id, got[0].platform_format, got[0].url, got[0].duration_seconds) == ("p", "REEL", "u", 61)
    assert (got[1].platform_video_id, got[1].platform_format, got[1].published_at) == ("q", "VIDEO", None)
    assert got[2].problem == "skipped_no_video_id"


def test_ingest_items_end_to_end(spark, fixtures):
    raw = [
        {"platform": "YOUTUBE", "platform_video_id": "pv0", "snapshot_at": "2024-02-01T00:00:00Z", "views_native": "999999999", "platform_format": "REEL"},
        {"platform": "TIKTOK", "platform_video_id": "new", "snapshot_at": "2024-02-01T00:00:00Z", "views_native": "1"},
        {"platform": "TIKTOK", "platform_video_id": "new", "snapshot_at": "2024-02-01T01:00:00Z", "views_native": "2"},
        {"platform": "TIKTOK", "platform_video_id": "new", "snapshot_at": "soon"}, {"platform_video_id": ""},
    ]
    batches = spark.createDataFrame([([json.dumps(r) for r in raw],)], "snapshots array<string>")
    items = payloads.metric_items(batches, as_of=AS_OF).withColumn("arrival_seq", F.col("item_pos").cast("long"))
    run = ingest_items(items, fixtures.source_video, fixtures.metric_snapshot)
    report = run.report.first()
    assert (report.ok, report.ko, report.stored, report.skipped) == (3, 1, 3, 0)
    created = run.sources.filter("platform_video_id = 'new'").collect()
    assert len(created) == 1 and created[0].video_id is None
    reasons = [r.reason for r in run.decisions.orderBy("arrival_seq").collect()]
    assert reasons[1] == "first_snapshot" and reasons[2] == "views_delta"
    after = tables.upsert_snapshots(fixtures.metric_snapshot, run.stored)
    assert after.count() == fixtures.metric_snapshot.count() + 3


@pytest.mark.parametrize("change", ["inserted", "updated", "unchanged"])
def test_source_upsert_changes(spark, change):
    sv = spark.createDataFrame(
        [(1, 7, "YOUTUBE", "VIDEO", "a", "t", 1), (2, None, "YOUTUBE", "VIDEO", "b", "t", 0)],
        "id long, video_id long, platform string, platform_format string, platform_video_id string, title string, is_active int",
    )
    updates = spark.createDataFrame(
        [(1, "YOUTUBE", "a", "VIDEO", "x"), (2, "YOUTUBE", "a", "VIDEO", "t"), (3, "YOUTUBE", "b", "VIDEO", None), (4, "YOUTUBE", "c", "VIDEO", "n")],
        "arrival_seq long, platform string, platform_video_id string, platform_format string, title string",
    )
    got = {r.change: r for r in tables.upsert_sources(sv, updates).collect()}
    assert got["unchanged"].id == 1 and got["unchanged"].video_id == 7
    assert got["updated"].title is None and got["updated"].is_active == 1 and got["inserted"].id == 3
    assert change in {r.change for r in tables.change_report(tables.upsert_sources(sv, updates)).collect()}


def test_unresolved_seed_sources_do_not_leak(spark, fixtures):
    feed = fixtures.snapshot_feed.filter("source_video_id = 3")
    assert ingest.sparse_fold(feed, fixtures.metric_snapshot).select("source_video_id").distinct().count() == 1


def test_snapshot_upsert_does_not_shuffle_the_table(spark):
    """A small batch meets a large table: replaced, new and repeated keys; the plan joins by broadcast only."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n") * 3600)
    ms = spark.range(20_000).select(
        F.col("id"), (F.col("id") % 100).alias("source_video_id"), F.floor(F.col("id") / 100).alias("n"), F.col("id").alias("views_native")
    ).withColumn("snapshot_at", at).drop("n")
    batch = spark.createDataFrame([(1, 5, 3, -1), (2, 5, 3, -2), (3, 7, 500, -3), (4, 7, 501, -4), (5, 7, 500, -5)],
                                  "arrival_seq long, source_video_id long, n long, views_native long").withColumn("snapshot_at", at).drop("n")
    after = tables.upsert_snapshots(ms, batch)
    got = {r.id: (r.source_video_id, r.views_native) for r in after.collect()}
    want = {i: (i % 100, i) for i in range(20_000)} | {305: (5, -2), 20_000: (7, -4), 20_001: (7, -5)}
    assert got == want
    stay = [line for line in after._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "LeftAnti" in line]
    assert stay and all("BroadcastHashJoin" in line for line in stay)
    assert tables.upsert_snapshots(ms, batch.limit(0)).count() == 20_000
    assert {r.id for r in tables.upsert_snapshots(ms.limit(0), batch).collect()} == {1, 2, 3}
