import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from compare import compare, duck
from oracle.sql import ORACLES
from vidmetrics.operators import align, percentiles, rollup
from vidmetrics.plans import changes
from vidmetrics.plans.registry import QUERIES

NOW = dt.datetime(2024, 1, 31)
SV = "id long, video_id long, platform string, published_at timestamp, is_active int"
V = "id long, slug string, title string, published_at timestamp, duration_seconds int"
MS = "id long, source_video_id long, snapshot_at timestamp, views_native long, reach long, likes long, comments long, shares long, total_watch_seconds long"


def tables_of(spark, drop_video=None, extra=(), unlinked=()):
    day = NOW - dt.timedelta(days=20)
    old = dt.datetime(2023, 8, 3)  # leaves the window of six months soon
    sv = [(i, None if i in unlinked else i // 2, "YOUTUBE" if i % 2 else "TIKTOK", old if i in (30, 31) else day, 1) for i in range(40)]
    v = [(i, f"v{i}", f"video {i}", day, 60) for i in range(20) if i != drop_video]
    ms = [(k, k % 40, (old if k % 40 in (30, 31) else day) + dt.timedelta(hours=5 * (k // 40) + 1), 10 * k, None, k, 1, 1, k) for k in range(400)]
    return spark.createDataFrame([*ms, *extra], MS), spark.createDataFrame(sv, SV), spark.createDataFrame(v, V)


def files(root):
    return {str(p.relative_to(root)) for p in Path(root).rglob("part=*/*.parquet")}


def same(a, b):
    return a.select(*b.columns).exceptAll(b).isEmpty() and b.exceptAll(a.select(*b.columns)).isEmpty()


def check(spark, root, ms, sv, v, now):
    raw = align.aligned_raw(ms, sv, as_of=now)
    dense = align.aligned_dense(raw, sv, as_of=now)
    assert same(changes.read_parts(spark, root, "video_rollup"), rollup.video_rollup(ms, sv, v, as_table=True))
    assert same(changes.read_parts(spark, root, "aligned_raw_hour"), raw)
    assert same(changes.read_parts(spark, root, "aligned_dense_hour"), dense)
    assert same(spark.read.parquet(f"{root}/bands_hour"), percentiles.percentile_bands(dense, as_of=now))


def test_changes_equal_a_full_refresh_and_leave_other_folders(spark, tmp_path):
    root = str(tmp_path)
    first = tables_of(spark)
    changes.refresh_changed(*first, root, as_of=NOW, parts=8)
    check(spark, root, *first, NOW)
    before = files(root)
    point = (9999, 7, NOW - dt.timedelta(hours=3), 77_777, None, 1, 1, 1, 1)
    second = tables_of(spark, extra=[point])
    changed = changes.changed_pairs(spark.createDataFrame([point], MS), first[1], second[1], first[2], second[2], last_as_of=NOW, as_of=NOW)
    assert [tuple(r) for r in changed.collect()] == [(3, "YOUTUBE")]
    for _ in range(2):  # a repeated run changes nothing
        changes.refresh_changed(*second, root, as_of=NOW, changed=changed, parts=8)
        check(spark, root, *second, NOW)
    gone = before - files(root)
    assert gone and {p.split("/")[0] for p in gone} == {"video_rollup_parts", "aligned_raw_hour_parts", "aligned_dense_hour_parts"}
    assert len({str(Path(p).parent) for p in gone}) == 3  # one folder a table; the others keep their files


def test_links_clock_removed_videos_and_emptied_parts(spark, tmp_path):
    root = str(tmp_path)
    first, later = tables_of(spark), NOW + dt.timedelta(days=10)
    changes.refresh_changed(*first, root, as_of=NOW, parts=64)  # nearly every video has a folder of its own
    second = tables_of(spark, drop_video=5, unlinked=(8, 9, 12))
    changed = changes.changed_pairs(first[0].limit(0), first[1], second[1], first[2], second[2], last_as_of=NOW, as_of=later)
    keys = {tuple(r) for r in changed.collect()}
    assert keys == {(4, "TIKTOK"), (4, "YOUTUBE"), (6, "TIKTOK"), (15, "TIKTOK"), (15, "YOUTUBE"), (5, None)}
    changes.refresh_changed(*second, root, as_of=later, changed=changed, parts=64)
    check(spark, root, *second, later)
    assert changes.read_parts(spark, root, "aligned_raw_hour").filter("video_id in (4, 15)").isEmpty()
    changes.refresh_changed(*second, root, as_of=later, changed=changed.limit(0), parts=64)
    check(spark, root, *second, later)


def test_query_at_the_earlier_state_differs(fixtures):
    assert compare(QUERIES["refreshed_changes"](fixtures), duck("/root/testdata/sf0.001"), ORACLES["refreshed_tables"]) is None
    assert not fixtures.metric_snapshot.filter(F.col("snapshot_at") >= F.lit(NOW - dt.timedelta(days=10))).isEmpty()
