import datetime as dt

import pytest

from vidmetrics.operators import percentiles, spread
from vidmetrics.plans import refresh as job
from vidmetrics.plans import views
from vidmetrics.plans.registry import QUERIES
from vidmetrics.sources import tables

AS_OF = dt.datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def root(spark, fixtures, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("derived"))
    job.refresh(
        fixtures.metric_snapshot, fixtures.source_video, fixtures.video, path, as_of=AS_OF, version="v1", granularities=("hour", "day")
    )
    return path


def test_refresh_writes_all_tables(spark, fixtures, root):
    f = fixtures
    assert tables.read_table(spark, root, "video_rollup").count() == f.video.count()
    dense = tables.read_table(spark, root, "aligned_dense_hour")
    assert dense.count() % 721 == 0
    bands = tables.read_table(spark, root, "bands_hour")
    want = percentiles.percentile_bands(dense, as_of=AS_OF).select(*bands.columns)
    assert bands.exceptAll(want).isEmpty() and bands.count() == want.count()
    assert tables.read_table(spark, root, "bands_day").filter("age_bucket > 30").isEmpty()


def test_platform_filter_prunes_partitions(spark, root):
    plan = tables.read_table(spark, root, "aligned_raw_hour").filter("source = 'YOUTUBE' and age_bucket < 5")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in text and "LessThan(age_bucket,5)" in text


def test_new_version_replaces_the_old_one(spark, tmp_path):
    root = str(tmp_path)
    for version, n in (("v1", 5), ("v2", 3), ("v2", 4)):
        tables.replace_table(spark.range(n), root, "t", version)
    assert tables.read_table(spark, root, "t").count() == 4


def test_the_last_announced_version_is_read(spark, tmp_path):
    root = str(tmp_path)
    for version in ("9", "10"):
        tables.replace_table(spark.range(int(version)), root, "t", version)
    assert tables.read_table(spark, root, "t").count() == 10
    tables.replace_table(spark.range(2), root, "t", "9")
    assert tables.read_table(spark, root, "t").count() == 2


def test_a_day_is_written_by_several_tasks(spark, tmp_path):
    from pathlib import Path

    rows = [(i, i, dt.datetime(2024, 1, 1, 5), i) for i in range(200)]
    points = spark.createDataFrame(rows, "arrival_seq long, source_video_id long, snapshot_at timestamp, views_native long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.merge_points(spark, str(tmp_path / "p"), points)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(Path(tmp_path / "p").glob("day=2024-01-01/*.parquet"))) > 1


def test_formats_of_later_items_count(spark):
    sv = spark.createDataFrame([], "id long, video_id long, platform string, platform_video_id string, platform_format string, is_active int")
    items = spark.createDataFrame([(1, "X", "a", None), (2, "X", "a", "SHORT"), (3, "X", "a", "VIDEO"), (4, "X", "b", None)], "arrival_seq long, platform string, platform_video_id string, platform_format string")
    got = {r.platform_video_id: r.platform_format for r in tables.create_minimal_sources(sv, items).collect()}
    assert got == {"a": "SHORT", "b": None}


def test_minimum_interval(spark):
    log = job.log_entry(spark, "v1", AS_OF)
    assert not job.may_refresh(log, AS_OF + dt.timedelta(seconds=60))
    assert job.may_refresh(log, AS_OF + dt.timedelta(seconds=120))
    assert job.may_refresh(log.limit(0), AS_OF)


def test_csv_export(spark, fixtures, tmp_path):
    path = str(tmp_path / "csv")
    tables.export_csv(fixtures.video, path)
    assert spark.read.option("header", True).csv(path).count() == fixtures.video.count()


def test_video_detail_and_series(spark, fixtures, root):
    f = fixtures
    detail = views.video_detail(f.metric_snapshot, f.source_video, f.video, slug="v-1", points=5)
    assert detail.video.first().id == 1 and detail.rollup.count() == 1
    n = detail.sources.count()
    assert n > 0 and detail.latest.count() == n and detail.points.count() == 5 * n
    assert detail.totals.count() == 1 and detail.watch.first().watch_seconds > 0
    by_id = views.video_detail(f.metric_snapshot, f.source_video, f.video, video_id=1).totals.first()
    pvid = detail.sources.first().platform_video_id
    by_publication = views.video_detail(
        f.metric_snapshot, f.source_video, f.video, platform=detail.sources.first().platform.lower(), platform_video_id=pvid
    ).totals.first()
    assert by_id == by_publication
    with pytest.raises(ValueError):
        views.video_detail(f.metric_snapshot, f.source_video, f.video)
    shown = views.video_series(
        f.metric_snapshot, f.source_video, f.video, as_of=AS_OF, running=True, limit=10, bands=tables.read_table(spark, root, "bands_hour")
    )
    per_series = shown.by_platform.groupBy("video_id", "platform").count()
    assert per_series.filter("count > 11").isEmpty() and not shown.bands.isEmpty() and not shown.warnings.isEmpty()
    assert shown.overall.groupBy("video_id").count().filter("count > 11").isEmpty()


def test_health_overview_and_reconcile_documents(fixtures):
    f = fixtures
    doc = views.health_document(f.source_video, f.metric_snapshot, f.health_event, f.batch_event, as_of=AS_OF)
    assert doc.platforms.count() == 5 and doc.last_batch.count() == 1 and not doc.alerts.isEmpty()
    seen = views.overview(f.metric_snapshot, f.source_video, f.video, as_of="2024-01-28")
    assert seen.platforms.count() == 4 and seen.latest_video.count() == 1 and seen.alerts.count() > 0
    run, report = views.reconcile_with_overrides(f.catalog_source, f.video, f.reconcile_override)
    assert report.first().clusters == run.clusters.count() and report.first().applied_overrides > 0


def test_merge_rewrites_only_the_days_of_the_batch(spark, tmp_path):
    from pathlib import Path

    path = str(tmp_path / "points")
    schema = "arrival_seq long, source_video_id long, snapshot_at timestamp, views_native long"

    def batch(*rows):
        return spark.createDataFrame([(s, 1, dt.datetime(2024, 1, d, h), v) for s, d, h, v in rows], schema)

    tables.merge_points(spark, path, batch((1, 1, 5, 10), (2, 2, 5, 20), (3, 2, 6, 25)))
    before = {p.name for p in Path(path).glob("day=2024-01-01/*.parquet")}
    tables.merge_points(spark, path, batch((4, 2, 5, 21), (5, 3, 1, 30)))
    got = spark.read.parquet(path).orderBy("snapshot_at").collect()
    assert [r.views_native for r in got] == [10, 21, 25, 30]
    assert {p.name for p in Path(path).glob("day=2024-01-01/*.parquet")} == before
    assert len({r.id for r in got}) == 4
    second = tables.read_points(spark, path, start="2024-01-02 05:00:00", end="2024-01-02 05:30:00")
    assert [r.views_native for r in second.collect()] == [21]
    assert "PartitionFilters: [isnotnull(day" in second._jdf.queryExecution().executedPlan().toString()


def test_bucketed_points_are_not_shuffled(spark, fixtures):
    from vidmetrics.operators.enrich import latest_per_source

    tables.save_bucketed(fixtures.metric_snapshot, "bucketed_points", "source_video_id", 4, ["snapshot_at"])
    newest = latest_per_source(spark.table("bucketed_points"))
    assert "Exchange hashpartitioning" not in newest._jdf.queryExecution().executedPlan().toString()
    assert newest.exceptAll(latest_per_source(fixtures.metric_snapshot)).isEmpty()
    spark.sql("DROP TABLE bucketed_points")


def test_all_sorts_read_one_stored_rollup(fixtures, monkeypatch):
    """The rollup is made once, not once per order and again for the samples of its ranges."""
    read, ranked = [], spread.ranked
    monkeypatch.setattr(spread, "ranked", lambda df, *more: read.append(df._jdf.queryExecution().optimizedPlan().toString()) or ranked(df, *more))
    assert QUERIES["all_sorts"](fixtures).count() > 0
    assert len(read) > 1 and not any("Join" in plan or "Aggregate" in plan for plan in read)
