"""Operators against brute force on small tables built to be awkward."""

import datetime as dt
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vidmetrics.operators import align, catalog, duplicates, enrich, health, percentiles, quality, reconcile, rollup, series, spread, trend
from vidmetrics.operators.catalog import SORTS, VideoListQuery, sort_columns

T0 = dt.datetime(2024, 1, 1)
SOURCES = "id long, video_id long, platform string, title string, description string, published_at timestamp, duration_seconds int, is_active int"


# ---- spread helpers --------------------------------------------------------

def test_numbering_is_dense_and_in_order(spark):
    ids = random.Random(1).sample(range(5000), 700)
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r.id: r.n for r in spread.numbered(df, "id", 100, "n").collect()}
    assert got == {i: 101 + k for k, i in enumerate(sorted(ids))}


def test_numbering_of_hash_ids(spark):
    ids = [random.Random(2).getrandbits(64) - (1 << 63) for _ in range(1)] + [random.Random(k).getrandbits(64) - (1 << 63) for k in range(3, 600)]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(3)
    got = spread.numbered(df, "id", 0, "n")
    assert {r.id: r.n for r in got.collect()} == {i: 1 + k for k, i in enumerate(sorted(ids))}
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert spread.numbered(df.limit(0), "id", 0, "n").count() == 0


def test_large_requests_are_honoured(spark):
    rows = [(i, i // 2, "YOUTUBE", f"t{i}", None, T0 + dt.timedelta(seconds=i // 7), 60, 1) for i in range(2400)]
    sv = spark.createDataFrame(rows, SOURCES)
    assert duplicates.duplicate_report(sv, limit=6000).count() == 6000
    points = spark.range(12_000).select(
        "id", F.lit(1).cast("long").alias("source_video_id"), F.timestamp_seconds("id").alias("snapshot_at"), F.col("id").alias("likes"),
    )
    one = spark.createDataFrame([(1, 1, "YOUTUBE")], "id long, video_id long, platform string")
    assert enrich.explore_snapshots(points, one, "likes", size=6000).count() == 6000
    assert enrich.explore_snapshots(points, one, "likes", size=0).count() == 200


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), T0 + dt.timedelta(minutes=rng.randrange(6000)), rng.choice([None, rng.randrange(50)])) for i in range(500)]
    return spark.createDataFrame(rows, "id long, source_video_id long, snapshot_at timestamp, views_native long").cache()


def test_previous_rows_equal_a_plain_lag(walk):
    w = Window.partitionBy("source_video_id").orderBy("snapshot_at", "id")
    want = walk.withColumn("prev_views_native", F.lag("views_native").over(w)).withColumn("prev_id", F.lag("id").over(w))
    got = spread.with_previous(walk, "source_video_id", "snapshot_at", "id", ["views_native", "id"]).select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_running_max_equals_a_plain_window(walk):
    w = Window.partitionBy("source_video_id").orderBy("snapshot_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = walk.withColumn("top", F.max("views_native").over(w))
    got = spread.with_running_max(walk, "source_video_id", "snapshot_at", "id", "views_native", "top").select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("n", [1, 3, 1500])
def test_first_rows(walk, n):
    got = spread.first_rows(walk, ["source_video_id"], [F.col("id").desc()], n)
    sizes = {r.source_video_id: r["count"] for r in walk.groupBy("source_video_id").count().collect()}
    assert {r.source_video_id: r["count"] for r in got.groupBy("source_video_id").count().collect()} == {k: min(n, v) for k, v in sizes.items()}


def test_hot_keys_are_cut_before_the_shuffle(walk):
    plan = spread.first_rows(walk, ["source_video_id"], [F.col("id").desc()], 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")


# ---- percentiles -----------------------------------------------------------

@pytest.mark.parametrize("size", [1, 2, 9, 10, 11, 70, 400])
def test_percentiles_by_rank(spark, size):
    rng = random.Random(size)
    values = [rng.choice([0.0, 1.0, rng.uniform(-5, 5), float(rng.randrange(10**9))]) for _ in range(size)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None)], "k string, v double")
    got = percentiles.discrete_percentiles(df, ["k"], "v").collect()
    assert len(got) == 1 and got[0].n == size
    ordered = sorted(values)
    for p in percentiles.BANDS:
        assert got[0][f"p{p}"] == ordered[math.ceil(size * p / 100 - 1e-9) - 1]


def test_bands_are_ordered(fixtures):
    raw = align.aligned_raw(fixtures.metric_snapshot, fixtures.source_video, as_of="2024-01-31")
    dense = align.aligned_dense(raw, fixtures.source_video, as_of="2024-01-31")
    pairs = align.eligible_pairs(fixtures.source_video, as_of="2024-01-31").count()
    assert dense.count() == pairs * 721
    bands = percentiles.percentile_bands(dense, as_of="2024-01-31")
    assert bands.filter("not (p10_views <= p25_views and p25_views <= p50_views and p50_views <= p75_views and p75_views <= p90_views)").isEmpty()


# ---- aligned curves --------------------------------------------------------

def curve(spark, points, **kw):
    sv = spark.createDataFrame([(1, 5, "YOUTUBE", "t", None, T0, 60, 1)], SOURCES)
    raw = spark.createDataFrame([(5, "YOUTUBE", a, v) for a, v in points], "video_id long, source string, age_bucket int, views_cum long")
    rows = align.aligned_dense(raw, sv, as_of="2024-01-31", **kw).orderBy("age_bucket").collect()
    return [r.views_cum for r in rows]


def test_dense_curve_rules(spark):
    assert curve(spark, [(2, 10), (5, 40), (9, 7)], horizon=7) == [0, 0, 10, 20, 30, 40, 40, 40]
    assert curve(spark, [], horizon=3) == [0, 0, 0, 0]
    assert curve(spark, [(0, 4)], horizon=2) == [4, 4, 4]
    assert curve(spark, [(9, 4)], horizon=2) == [0, 0, 0]
    assert curve(spark, [(1, 5), (3, 7)], horizon=6, clip_to_observed=True) == [0, 5, 6, 7]


def test_two_sources_of_one_platform_share_a_start(spark):
    sv = spark.createDataFrame([
        (1, 5, "YOUTUBE", "t", None, T0, 60, 1), (2, 5, "YOUTUBE", "t", None, T0 + dt.timedelta(hours=3), 60, 1),
        (3, None, "YOUTUBE", "t", None, T0, 60, 1), (4, 5, "FACEBOOK", "t", None, T0, 60, 0),
    ], SOURCES)
    ms = spark.createDataFrame([
        (1, 1, T0 + dt.timedelta(minutes=59), 5), (2, 2, T0 + dt.timedelta(hours=2), 99), (3, 2, T0 + dt.timedelta(hours=4), 8),
        (4, 1, T0 + dt.timedelta(hours=4, minutes=1), 6), (5, 3, T0, 1), (6, 4, T0, 1), (7, 1, T0 - dt.timedelta(hours=1), 50),
    ], "id long, source_video_id long, snapshot_at timestamp, views_native long")
    rows = align.aligned_raw(ms, sv, as_of="2024-01-31").orderBy("age_bucket").collect()
    assert [(r.source, r.age_bucket, r.views_cum) for r in rows] == [("YOUTUBE", 0, 5), ("YOUTUBE", 4, 8)]
    assert rows[1].bucket_ts == T0 + dt.timedelta(hours=4)


# ---- series ----------------------------------------------------------------

def plain_downsample(points, limit):
    n = len(points)
    if limit <= 0 or n <= limit:
        return points
    kept = points[:: math.ceil(n / limit)]
    return kept if kept[-1] == points[-1] else kept + [points[-1]]


@pytest.mark.parametrize("n, limit", [(1, 5), (5, 5), (6, 5), (23, 7), (24, 6), (10, 0), (10, 1)])
def test_downsample(spark, n, limit):
    rows = [(1, "P", T0 + dt.timedelta(hours=i), i) for i in range(n)]
    df = spark.createDataFrame(rows, "video_id long, platform string, ts timestamp, value long")
    assert sorted(r.value for r in series.downsample(df, limit).collect()) == plain_downsample(list(range(n)), limit)


def test_chart_edge_form(spark):
    rows = [(1, "P", T0 + dt.timedelta(hours=i), i) for i in (2, 0, 1)]
    df = spark.createDataFrame(rows, "video_id long, platform string, ts timestamp, value long")
    points = series.as_chart(df).first().points
    assert [p.value for p in points] == [0, 1, 2] and points[0].ts == 1704067200000


@pytest.mark.parametrize("body, want", [
    ('[[1704067200, 5], ["1704067201000", "6"], ["2024-01-01T00:00:02Z", 7], [1704067200, 8]]', {1704067200000: 8, 1704067201000: 6, 1704067202000: 7}),
    ('{"data": [{"ts": 1704067200, "views": 3}, {"time": "2024-01-01T00:00:01Z", "v": "4"}, {"value": 9}]}', {1704067200000: 3, 1704067201000: 4}),
    ('[{"t": "2024-01-01T00:00:00Z", "zz": 7, "aa": 5}]', {1704067200000: 7}), ('{"series": [{"zz": "x", "mm": 3, "t": 1704067200, "aa": 5}]}', {1704067200000: 3}),
    ('[{"t": 1704067200, "zz": 7}]', {1704067200000: 1704067200}),  # the time is a numeric field too
    ('{"1704067200": {"zz": 7, "aa": 5}}', {1704067200000: 7}),
    ('{"1704067200": 1, "1704067201": {"value": 2}, "soon": 3, "1704067202": null}', {1704067200000: 1, 1704067201000: 2}),
    ("not json", {}), ("[]", {}), ("7", {}),
])
def test_parse_series(spark, body, want):
    df = spark.createDataFrame([("k", body)], "k string, body string")
    assert {r.ts_ms: r.value for r in series.parse_series(df, "k", "body").collect()} == want


# ---- trend -----------------------------------------------------------------

def test_slope_edges(spark):
    sv = spark.createDataFrame([(1, 1, "YOUTUBE", "t", None, T0, 1, 1), (2, 2, "YOUTUBE", "t", None, T0, 1, 1)], SOURCES)
    ms = spark.createDataFrame(
        [(i, 1, T0 + dt.timedelta(hours=i), i * 8) for i in range(50)] + [(90, 2, T0, 4), (91, 2, T0, 9)],
        "id long, source_video_id long, snapshot_at timestamp, views_native long",
    )
    v = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = {r.video_id: (round(r.slope, 9), r.stars) for r in trend.video_trend(ms, sv, v).collect()}
    assert got == {1: (8.0, 2), 2: (0.0, 0), 3: (0.0, 0)}


# ---- duplicates ------------------------------------------------------------

def brute_pairs(rows, window_s, tol):
    out = []
    for a, b in itertools.combinations(sorted(rows), 2):
        if a[5] is None or b[5] is None:
            continue
        d = abs(int((a[5] - b[5]).total_seconds()))
        alike = a[6] is None or b[6] is None or abs(a[6] - b[6]) < tol
        other = a[1] is None or b[1] is None or a[1] != b[1]
        if d <= window_s and alike and other:
            out.append((d, a[0], b[0]))
    return sorted(out)


def random_sources(seed, n, spread_s, videos=40, hot=0.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = T0 if rng.random() < hot else T0 + dt.timedelta(seconds=rng.randrange(spread_s))
        rows.append((
            i, rng.choice([None, rng.randrange(videos)]), rng.choice(["YOUTUBE", "FACEBOOK"]), rng.choice(["red", "Teaser red", "blue", " ", None]),
            rng.choice(["d", "", "longer text"]), rng.choice([at, at, at, None]) if hot == 0 else at,
            rng.choice([None, 60, 61, 100, rng.randrange(600)]), 1,
        ))
    return rows


@pytest.mark.parametrize("seed, spread_s, hot, limit, tol", [
    (1, 400_000, 0.0, 50, 60), (2, 2_000_000, 0.0, 1000, 60), (3, 5_000, 0.5, 20, 60), (4, 100_000, 0.9, 100, 10),
    (5, 50_000, 0.3, 30, 0), (6, 1_000, 1.0, 7, 60),
])
def test_duplicates_equal_brute_force(spark, seed, spread_s, hot, limit, tol):
    rows = random_sources(seed, 220, spread_s, videos=5 if hot else 40, hot=hot)
    sv = spark.createDataFrame(rows, SOURCES)
    got = duplicates.duplicate_report(sv, tol_s=tol, limit=limit)
    found = sorted((round(r.delta_h * 3600), r.s1_id, r.s2_id) for r in got.collect())
    assert found == brute_pairs(rows, 48 * 3600, tol)[:limit]


@pytest.mark.parametrize("tol", [0, 60])
def test_unknown_lengths_pair_with_all(spark, tol):
    rows = [r[:6] + (None if r[0] % 5 else r[6], 1) for r in random_sources(8, 200, 30_000, hot=0.4)]
    got = duplicates.duplicate_report(spark.createDataFrame(rows, SOURCES), tol_s=tol, limit=60)
    found = sorted((round(r.delta_h * 3600), r.s1_id, r.s2_id) for r in got.collect())
    assert found == brute_pairs(rows, 48 * 3600, tol)[:60]


def test_hot_copies_shrink_before_the_join(spark):
    rows = [(i, None, "YOUTUBE", "t", "d", T0, 60, 1) for i in range(3000)]
    narrow = duplicates._narrow(spark.createDataFrame(rows, SOURCES))
    assert duplicates._interchangeable_cut(narrow, 10).count() == 22
    got = duplicates.duplicate_report(spark.createDataFrame(rows, SOURCES), limit=10, offset=5).collect()
    assert sorted((r.s1_id, r.s2_id) for r in got) == [(0, i) for i in range(6, 16)]


# ---- reconciliation --------------------------------------------------------

def brute_clusters(rows, hours):
    """The full scan over all buckets of a title, as the rule is written."""
    groups = {}
    for r in sorted((r for r in rows if r[5] is not None), key=lambda r: (r[5], r[0])):
        title = (r[3] or "").lower().replace("teaser", "").strip()
        at = int(r[5].replace(tzinfo=dt.timezone.utc).timestamp())
        for bucket in groups.setdefault(title, []):
            if abs(at - bucket["ref"]) <= hours * 3600:
                bucket["items"].append(r)
                bucket["ref"] = math.floor((bucket["ref"] + at) / 2 + 0.5)
                break
        else:
            groups[title].append({"ref": at, "items": [r]})
    return [b["items"] for g in groups.values() for b in g]


@pytest.mark.parametrize("seed, spread_s, hot", [(1, 3_000_000, 0.0), (2, 600_000, 0.0), (3, 900_000, 0.6), (4, 60_000_000, 0.9)])
def test_clusters_equal_brute_force(spark, seed, spread_s, hot):
    rows = random_sources(seed, 400, spread_s, hot=hot)
    sv = spark.createDataFrame(rows, SOURCES)
    clustered = reconcile.cluster_sources(sv)
    got = Counter(
        tuple(sorted(r.ids)) for r in clustered.groupBy("norm_title", "opened_at").agg(F.collect_list("id").alias("ids")).collect()
    )
    assert got == Counter(tuple(sorted(r[0] for r in items)) for items in brute_clusters(rows, 48))


@pytest.mark.parametrize("seed, spread_s, hot, block", [(3, 900_000, 0.6, 1), (5, 6_000_000, 0.9, 3), (6, 60_000_000, 1.0, 20)])
def test_clusters_of_titles_cut_into_blocks(spark, seed, spread_s, hot, block):
    rows = random_sources(seed, 400, spread_s, hot=hot)
    clustered = reconcile.cluster_sources(spark.createDataFrame(rows, SOURCES), seconds_per_block=block)
    got = Counter(
        tuple(sorted(r.ids)) for r in clustered.groupBy("norm_title", "opened_at").agg(F.collect_list("id").alias("ids")).collect()
    )
    assert got == Counter(tuple(sorted(r[0] for r in items)) for items in brute_clusters(rows, 48))


@pytest.mark.parametrize("window_s", [3, 50, 3600, 172_800])
def test_block_map_equals_the_walk_for_every_reference(window_s):
    pick = random.Random(window_s)
    for _ in range(200):
        at, seconds = pick.randrange(10**9, 2 * 10**9), []
        for _ in range(pick.choice([1, 2, 5, 60])):
            seconds.append((at, pick.choice([1, 1, 2, 5, 1000])))
            at += 1 + int(pick.random() ** 3 * window_s * pick.choice([0.01, 0.3, 1.5]))
        first = seconds[0][0]
        block = reconcile.BlockMap(window_s, first)
        for a, n in seconds:
            block.step(a, n)
        below, opened, reference, add, shift = block.columns()
        assert below == sorted(below) and len(below) < 10
        for r in (first, *(first - pick.randrange(int(window_s * 1.2) + 1) for _ in range(20))):
            want, of = r, None
            for a, n in seconds:
                if a - want > window_s:
                    want = of = a
                for _ in range(n):
                    want = (want + a + 1) // 2
            k = next((k for k, top in enumerate(below) if r < top), None)
            assert ((r + add) >> shift, None) == (want, of) if k is None else (reference[k], opened[k]) == (want, of)


def test_dense_title_in_blocks_equals_one_walk(spark):
    """One title, a row every 20 minutes for ten years, with some gaps inside the window: no gap cuts it."""
    n, start = 262_800, 1_400_000_000
    at = F.col("id") * 1200 + start + F.when(F.col("id") % 5000 > 4990, (F.col("id") % 7) * 100).otherwise(0)
    step = F.floor(F.col("id") / 30_000) * 150_000  # now and then nearly the window, which moves the reference far
    rows = spark.range(n).select(
        "id", F.lit(None).cast("long").alias("video_id"), F.lit("YOUTUBE").alias("platform"), F.lit("one title").alias("title"),
        F.lit("").alias("description"), F.timestamp_seconds(at + step).alias("published_at"),
    )
    parts = reconcile.cluster_sources(rows, hours=42, seconds_per_block=10_000)
    whole = reconcile.cluster_sources(rows, hours=42)
    opened = {r.at: r.opened_at for r in whole.select("at", "opened_at").collect()}
    got = parts.select("at", "opened_at").collect()
    assert len(got) == n and {r.at: r.opened_at for r in got} == opened and len(set(opened.values())) > 3


def test_reconcile_is_stable_under_a_second_run(spark):
    rows = random_sources(7, 150, 900_000)
    sv = spark.createDataFrame(rows, SOURCES)
    v = spark.createDataFrame([(i, 0) for i in range(40)], "id long, is_locked int")
    run = reconcile.reconcile(sv, v)
    after = spark.createDataFrame(run.updated_sources(sv).collect(), sv.schema)
    videos = v.unionByName(spark.createDataFrame(run.new_videos.select("id", "is_locked").collect(), v.schema))
    again = reconcile.reconcile(after, videos)
    assert again.new_videos.count() == 0 and again.linked().count() == 0
    assert again.clusters.count() == run.clusters.count()
    report = run.report(3).first()
    assert report.created_videos == run.new_videos.count() and report.applied_overrides == 3


def test_canonical_texts(spark):
    rows = [
        (1, None, "FACEBOOK", "Red Plate", "short", T0, 1, 1), (2, None, "YOUTUBE", "red plate", " ", T0 + dt.timedelta(hours=1), 1, 1),
        (3, None, "TIKTOK", "RED PLATE!!", "the longest", T0 + dt.timedelta(hours=2), 1, 1),
        (4, None, "FACEBOOK", None, None, T0, 1, 1), (5, None, "FACEBOOK", "  ", "", T0 + dt.timedelta(hours=1), 1, 1),
    ]
    clusters = reconcile.describe_clusters(reconcile.cluster_sources(spark.createDataFrame(rows, SOURCES)))
    got = {r.cluster_id: (r.title, r.description) for r in clusters.collect()}
    assert got == {1: ("red plate", "the longest"), 4: ("  ", "")}
    apart = reconcile.cluster_sources(spark.createDataFrame(rows, SOURCES), cluster_blank_titles=False)
    assert {r.id for r in apart.collect()} == {1, 2, 3}


def test_locked_videos_stay_out(spark):
    rows = [(1, 9, "YOUTUBE", "a", "d", T0, 1, 1), (2, None, "YOUTUBE", "a", "d", T0, 1, 1), (3, 8, "YOUTUBE", "a", "d", T0, 1, 0)]
    v = spark.createDataFrame([(9, 1), (8, 0)], "id long, is_locked int")
    assert {r.id for r in reconcile.candidates(spark.createDataFrame(rows, SOURCES), v).collect()} == {2}


def test_overrides_and_resolutions(spark):
    rows = [(i, 10 + i, "YOUTUBE", "a", "d", T0, 1, 1) for i in range(4)]
    sv = spark.createDataFrame(rows, SOURCES)
    ov = spark.createDataFrame([(1, 0, "UNLINK", None), (2, 0, "LINK", 99), (3, 1, "LINK", None), (4, 2, "unlink", None), (5, 3, "IGNORE", 1)],
                               "id long, source_video_id long, action string, target_video_id long")
    after = {r.id: r.video_id for r in reconcile.apply_overrides(sv, ov).collect()}
    assert after == {0: 99, 1: 11, 2: None, 3: 13}
    report = reconcile.override_report(ov).first()
    assert (report.applied, report.invalid) == (3, 2)
    v = spark.createDataFrame([(10 + i, 0) for i in range(4)], "id long, is_locked int")
    res = spark.createDataFrame([(10, 11, 1), (11, 12, 2), (10, 50, 3)], "keep_id long, delete_id long, source_id long")
    problems = {(r.keep_id, r.delete_id): r.problem for r in reconcile.check_resolutions(res, sv, v).collect()}
    assert problems == {(10, 11): None, (11, 12): "kept video is deleted", (10, 50): "unknown video"}
    sources, videos = reconcile.resolve_duplicates(sv, v, res)
    assert {r.id: r.video_id for r in sources.collect()} == {0: 10, 1: 10, 2: 12, 3: 13}
    assert {r.id for r in videos.collect()} == {10, 12, 13}


# ---- list ------------------------------------------------------------------

def test_sort_names_and_fallback():
    assert len(SORTS) == 18
    assert str(sort_columns("nonsense")) == str(sort_columns("views_desc")) == str(sort_columns(None))


def test_page_clamp():
    assert (VideoListQuery(size=0).limit, VideoListQuery(size=9999).limit, VideoListQuery(page=-1).offset) == (20, 9999, 0)


def test_search_ignores_case_and_accents(spark):
    roll = spark.createDataFrame([(1, "Été à Vaud", "v-1"), (2, "Hiver", "ete-2"), (3, "100 % pur", "v-3"), (4, "autre", "v-4")],
                                 "video_id long, video_title string, slug string")
    def ids(q):
        return {r.video_id for r in catalog.filter_videos(roll, roll, VideoListQuery(q=q)).collect()}
    assert ids("ETE") == {1, 2} and ids("h%v") == {2} and ids("  ") == {1, 2, 3, 4}
    assert ids("E_e a v%d") == {1} and ids("été%VAUD") == {1}


def test_search_with_and_without_wildcards_folds_alike(spark):
    titles = ["Žižek", "ŠKODA ōta", "Straße", "œuvre Ærø", "Ελλάδα", "Ёлка", "Việt Nam", "cafe\u0301", "Ǻngström", "plain"]
    roll = spark.createDataFrame(list(enumerate(titles)), "video_id long, video_title string").withColumn("slug", F.lit(""))
    def ids(q):
        return {r.video_id for r in catalog.filter_videos(roll, roll, VideoListQuery(q=q)).collect()}
    for number, q in enumerate(["zizek", "skoda ota", "STRASSE", "OEUVRE aer", "ελλαδα", "елка", "viet", "CAFÉ", "angstrom", "plain"]):
        assert ids(q) == ids(f"{q}%") == {number}, q


def test_rollup_null_rules(spark):
    v = spark.createDataFrame([(1, "a", "A", T0, 100), (2, "b", "B", T0, 0), (3, "c", "C", T0, 10)],
                              "id long, slug string, title string, published_at timestamp, duration_seconds int")
    sv = spark.createDataFrame([(1, 1, "YOUTUBE", "t", "", T0, 1, 1), (2, 1, "FACEBOOK", "t", "", T0, 1, 1), (3, 2, "TIKTOK", "t", "", T0, 1, 0)], SOURCES)
    ms = spark.createDataFrame([(1, 1, T0, 50, None, 4, None, 1, 500), (2, 2, T0, None, 30, 2, 1, 1, None), (3, 3, T0, 9, 9, 9, 9, 9, 9)],
                               "id long, source_video_id long, snapshot_at timestamp, views_native long, reach long, likes long, comments long, shares long, total_watch_seconds long")
    got = {r.video_id: r for r in rollup.video_rollup(ms, sv, v).collect()}
    assert (got[1].views_native_sum, got[1].views_fb, got[1].comments_sum) == (80, 30, 1)
    assert got[1].watch_equivalent_sum == 5.0 and got[1].engagement_rate_sum == 9 / 80
    assert got[2].views_native_sum is None and got[2].views_tt == 0 and got[3].views_yt == 0
    assert {r.video_id: r.views_native_sum for r in rollup.video_rollup(ms, sv, v, as_table=True).collect()} == {1: 80, 2: 0, 3: 0}


# ---- health ----------------------------------------------------------------

AS_OF = "2024-01-31 00:00:00"
EVENTS = "seq long, happened_at timestamp, platform string, outcome string, snapshot_at timestamp, duration_ms long, items long, token_expires_at timestamp, message string"


def ago(hours):
    return dt.datetime(2024, 1, 31) - dt.timedelta(hours=hours)


@pytest.mark.parametrize("events, sources, snapshot_ago, want", [
    ([("SUCCESS", 1, dt.datetime(2024, 6, 1), None)], 1, 2, ("OK", "OK")),
    ([("SUCCESS", 1, dt.datetime(2024, 2, 7), None)], 1, 2, ("WARNING", "WARNING")),
    ([("SUCCESS", 1, dt.datetime(2024, 1, 30, 23, 30), None)], 1, 2, ("ERROR", "EXPIRED")),
    ([("SUCCESS", 3, None, None), ("ERROR", 1, None, "HTTP 500")], 1, 2, ("ERROR", "ERROR")),
    ([("ERROR", 3, None, "oauth refused")], 1, 2, ("ERROR", "EXPIRED")),
    ([("ERROR", 3, None, "HTTP 500"), ("SUCCESS", 1, None, None)], 1, 2, ("OK", "OK")),
    ([("SUCCESS", 30, None, None)], 1, 2, ("WARNING", "OK")),
    ([("SUCCESS", 80, None, None)], 1, 2, ("ERROR", "OK")),
    ([("SUCCESS", 1, None, None)], 1, 100, ("WARNING", "OK")),
    ([("SUCCESS", 1, None, None)], 1, None, ("ERROR", "OK")),
    ([], 1, 2, ("WARNING", "UNKNOWN")),
])
def test_platform_status(spark, events, sources, snapshot_ago, want):
    rows = [(i, ago(h), " youtube", o, None, 10, 5, token, msg) for i, (o, h, token, msg) in enumerate(events)]
    sv = spark.createDataFrame([(i, 1, "YOUTUBE", "t", "", T0, 1, 1) for i in range(sources)], SOURCES)
    points = [(1, 0, ago(snapshot_ago))] if snapshot_ago is not None else []
    ms = spark.createDataFrame(points, "id long, source_video_id long, snapshot_at timestamp")
    got = health.platform_status(sv, ms, spark.createDataFrame(rows, EVENTS), as_of=AS_OF).collect()
    assert [(r.status, r.token_status) for r in got] == [want]
    assert (got[0].message is None) == (want == ("OK", "OK"))
    alerts = {r.message for r in health.alerts(health.platform_status(sv, ms, spark.createDataFrame(rows, EVENTS), as_of=AS_OF)).collect()}
    assert (got[0].message in alerts) or not alerts


def test_batch_runs(spark):
    rows = [(1, " r1 ", "running", T0, None, None, None, None), (2, "r1", "success", ago(1), ago(0), -5, -1, "m" * 2000), (3, "", "x", T0, None, 1, 1, None)]
    df = spark.createDataFrame(rows, "seq long, run_id string, status string, started_at timestamp, finished_at timestamp, duration_ms long, items long, message string")
    got = health.fold_batch_runs(df).collect()
    assert len(got) == 1 and got[0].started_at == T0 and got[0].status == "SUCCESS"
    assert (got[0].duration_ms, got[0].items, len(got[0].error)) == (0, 0, 2000)


# ---- quality ---------------------------------------------------------------

def test_zero_after_positive_is_cleaned(spark):
    values = [0, 5, 0, None, 0, 7]
    ms = spark.createDataFrame([(i, 1, T0 + dt.timedelta(hours=5 * i), v) for i, v in enumerate(values)],
                               "id long, source_video_id long, snapshot_at timestamp, views_native long")
    assert {r.id: r.views_native for r in quality.cleaned(ms).collect()} == {0: 0, 1: 5, 2: None, 3: None, 4: None, 5: 7}
    assert sorted(r.id for r in quality.regressions(ms).collect()) == [2]
    assert quality.gaps(ms).count() == 5 and quality.gaps(ms, hours=5).count() == 0


def test_retention_classes(spark):
    rows = [(i, 1, dt.datetime(2024, 1, 30) - dt.timedelta(hours=6 * i)) for i in range(400)]
    ms = spark.createDataFrame(rows, "id long, source_video_id long, snapshot_at timestamp")
    kept = quality.retained(ms, as_of=AS_OF, recent_days=10, daily_days=40).collect()
    ages = [(dt.datetime(2024, 1, 31) - r.snapshot_at).days for r in kept]
    assert sum(a < 10 for a in ages) == sum((dt.datetime(2024, 1, 31) - r[2]).days < 10 for r in rows)
    assert len([a for a in ages if 10 <= a < 40]) <= 31 and len([a for a in ages if a >= 40]) <= 10


@pytest.mark.parametrize("crowded", [0, 1000, percentiles.CROWDED])
def test_percentiles_of_values_that_crowd_into_one_slot(spark, crowded):
    """A narrow range of distinct doubles: one slot of the value axis, cut again; a constant and a pair beside it."""
    n = 200_000
    crowd = spark.range(n).select(F.lit("a").alias("k"), (1e6 + F.pmod(F.col("id") * 7919, F.lit(n)) / n).alias("v"))
    same = spark.range(1000).select(F.lit("b").alias("k"), F.lit(5.0).alias("v"))
    two = spark.createDataFrame([("c", 1.0), ("c", -2.0)], "k string, v double")
    got = {r.k: r for r in percentiles.discrete_percentiles(crowd.unionByName(same).unionByName(two).repartition(8), ["k"], "v", crowded=crowded).collect()}
    for p in (10, 25, 50, 75, 90):
        assert got["a"][f"p{p}"] == 1e6 + (n * p // 100 - 1) / n and got["b"][f"p{p}"] == 5.0
        assert got["c"][f"p{p}"] == (-2.0 if p <= 50 else 1.0)
    assert (got["a"].n, got["b"].n, got["c"].n) == (n, 1000, 2)


def test_percentiles_shuffle_only_slots_that_hold_a_rank(spark, monkeypatch):
    """Rows outside the slots of the ranks met the shuffle by value before."""
    kept = []
    monkeypatch.setattr(percentiles, "_running", lambda n, *a, f=percentiles._running: kept.append(n) or f(n, *a))
    df = spark.range(100_000).select((F.col("id") % 2).alias("k"), (F.col("id") * 1.0).alias("v"))
    got = percentiles.discrete_percentiles(df, ["k"], "v", (50,), crowded=100)
    assert kept == ["_part_n", "_n"]  # the crowded slots are cut
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_slot_n" in text and {(r.k, r.p50, r.n) for r in got.collect()} == {(0, 49_998.0, 50_000), (1, 49_999.0, 50_000)}
    kept.clear()
    zeros = spark.range(5_000).select(F.lit(1).alias("k"), F.lit(0.0).alias("v"))
    assert percentiles.discrete_percentiles(zeros, ["k"], "v", (50,), crowded=100).collect()[0].p50 == 0.0
    assert kept == ["_n"]  # one value needs no cut, however often it comes


def test_ages_of_clipped_bands_are_made_by_many_tasks(spark):
    """Adaptive execution gave the few bytes of the series, and so all their ages, to one task."""
    start = dt.datetime(2024, 1, 1)
    v = spark.createDataFrame([(i, start) for i in range(400)], "id long, published_at timestamp")
    points = v.select(F.col("id").alias("video_id"), F.lit("X").alias("platform"), F.timestamp_add("HOUR", F.lit(30), "published_at").alias("ts"), F.lit(1).alias("value"))
    bands = spark.range(31).select(F.lit("X").alias("source"), F.lit("hour").alias("granularity"), F.col("id").cast("int").alias("age_bucket"), (F.col("id") * 1.5).alias("p50_views"), F.lit(9).alias("count_videos"))
    got = series.clip_bands(bands, points, v).withColumn("task", F.spark_partition_id())
    assert got.count() == 400 * 31 and got.select("task").distinct().count() > 8
