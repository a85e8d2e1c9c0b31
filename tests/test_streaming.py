import datetime as dt
import os

from pyspark.sql import functions as F

from vidmetrics.operators import ingest, series
from vidmetrics.streaming.live import live_buckets, merge_buckets, read_buckets, store_buckets
from vidmetrics.streaming.sparse import sparse_stream, store_batches


def landed(df, path, files):
    """The feed as ``files`` Parquet files in arrival order; one file makes one micro-batch."""
    bounds = [r[0] for r in df.select(F.ntile(files).over(_by_arrival()).alias("t"), "arrival_seq").groupBy("t").agg(F.max("arrival_seq")).orderBy("t").select("max(arrival_seq)").collect()]
    low = -1
    for high in bounds:
        df.filter((F.col("arrival_seq") > low) & (F.col("arrival_seq") <= high)).coalesce(1).write.mode("append").parquet(path)
        low = high


def _by_arrival():
    from pyspark.sql.window import Window

    return Window.orderBy("arrival_seq")


def test_stream_equals_batch(spark, fixtures, tmp_path):
    feed = fixtures.snapshot_feed.cache()
    landing = str(tmp_path / "landing")
    landed(feed, landing, 4)
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    told = []
    q = (
        sparse_stream(stream).writeStream.foreachBatch(_both(store_batches(str(tmp_path / "stored"), told.append), str(tmp_path / "all")))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination(240)
    assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "all")).drop("batch")
    want = ingest.sparse_fold(feed).select(*got.columns)
    assert got.count() == want.count() == feed.count()
    assert got.exceptAll(want).isEmpty()
    stored = spark.read.parquet(str(tmp_path / "stored"))
    keys = ["source_video_id", "snapshot_at"]
    last = stored.select(*keys, "views_native")
    assert last.groupBy(*keys).count().filter("count > 1").isEmpty()
    wanted = ingest.stored_points(want).select(*keys, "views_native")
    assert last.exceptAll(wanted).isEmpty() and wanted.exceptAll(last).isEmpty()
    assert told == sorted(set(told)) and told


def test_restart_on_stored_points(spark, tmp_path):
    """A stream without a checkpoint goes on from the stored points, with exact counters."""
    import datetime as dt

    large = (1 << 60) + 1
    schema = "arrival_seq long, source_video_id long, snapshot_at timestamp, views_native long, likes long, comments long, shares long, total_watch_seconds long, reach long"
    rows = lambda *r: spark.createDataFrame([(s, i, dt.datetime(2024, 1, 1, h), v, None, 1, 1, None, None) for s, i, h, v in r], schema)
    table, landing = str(tmp_path / "points"), str(tmp_path / "landing")

    def run(checkpoint, seed, *given):
        rows(*given).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing)
        q = sparse_stream(stream, seed).writeStream.foreachBatch(_both(store_batches(table), f"{tmp_path}/all-{checkpoint}")).option(
            "checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        return {r.arrival_seq: r for r in spark.read.parquet(f"{tmp_path}/all-{checkpoint}").collect()}

    first = run("a", None, (1, 1, 5, large), (2, 2, 5, 10))
    assert {r.reason for r in first.values()} == {"first_snapshot"}
    landing = str(tmp_path / "later")
    again = run("b", spark.read.parquet(table), (3, 1, 6, large - 5), (4, 2, 5, 12), (5, 3, 5, 1))
    assert [again[k].reason for k in (4, 5)] == ["same_timestamp_update", "first_snapshot"]
    assert again[3].reason != "first_snapshot" and again[3].views_native == large and again[3].monotonic_corrections == 1
    got = {(r.source_video_id, r.snapshot_at.hour): r.views_native for r in spark.read.parquet(table).collect()}
    assert got[1, 5] == large and got[2, 5] == 12 and got[3, 5] == 1


def _both(store, path):
    def write(batch, number):
        batch.persist()
        store(batch, number)
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return write


def test_live_buckets_equal_the_batch_series(spark, fixtures, tmp_path):
    points = fixtures.metric_snapshot.select("source_video_id", "snapshot_at", "views_native")
    landing = str(tmp_path / "points")
    points.coalesce(1).write.parquet(landing)
    stream = spark.readStream.schema(points.schema).parquet(landing)
    q = (
        live_buckets(stream, fixtures.source_video, lateness="400 days").writeStream.outputMode("complete").format("memory")
        .queryName("live_buckets").trigger(availableNow=True).start()
    )
    q.awaitTermination(240)
    assert q.exception() is None
    got = spark.table("live_buckets")
    want = series.bucket_series(
        fixtures.metric_snapshot, fixtures.source_video,
        fixtures.video.withColumn("published_at", F.lit("2000-01-01").cast("timestamp")), as_of="2030-01-01",
    ).select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_stored_buckets_equal_the_batch_series_however_late(spark, fixtures, tmp_path):
    """Newest rows first, so nearly all later ones are late; publication and end bound the series on both sides."""
    points = fixtures.metric_snapshot.select("source_video_id", "snapshot_at", "likes").cache()
    end = points.agg(F.expr("percentile_approx(snapshot_at, 0.8)")).first()[0]
    video = fixtures.video.join(
        points.join(fixtures.source_video.select(F.col("id").alias("source_video_id"), "video_id"), "source_video_id")
        .groupBy(F.col("video_id").alias("id")).agg(F.expr("percentile_approx(snapshot_at, 0.3)").alias("early")), "id", "left",
    ).withColumn("published_at", F.coalesce("early", "published_at")).drop("early")
    landing, table = str(tmp_path / "points"), str(tmp_path / "buckets")
    cuts = points.agg(F.expr("percentile_approx(snapshot_at, array(0.66, 0.33))")).first()[0]
    for low, high in ((cuts[0], None), (cuts[1], cuts[0]), (None, cuts[1])):
        rows = points
        if low is not None:
            rows = rows.filter(F.col("snapshot_at") >= F.lit(low))
        if high is not None:
            rows = rows.filter(F.col("snapshot_at") < F.lit(high))
        rows.coalesce(1).write.mode("append").parquet(landing)
    sink = store_buckets(table, fixtures.source_video, video, end=end, metric="likes")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None and q.lastProgress["batchId"] == 2
    want = series.bucket_series(fixtures.metric_snapshot, fixtures.source_video, video, as_of=end, metric="likes")
    everything = series.bucket_series(
        fixtures.metric_snapshot, fixtures.source_video, video.withColumn("published_at", F.lit("2000-01-01").cast("timestamp")), as_of="2090-01-01", metric="likes")
    assert 0 < want.count() < everything.count()
    got = read_buckets(spark, table)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    sink(points.limit(50), 3)  # rows met twice
    assert read_buckets(spark, table).exceptAll(want).isEmpty()


def test_merged_buckets_leave_other_days_untouched(spark, tmp_path):
    path = str(tmp_path / "buckets")

    def rows(*given):
        return spark.createDataFrame([(1, "YOUTUBE", dt.datetime(2024, 1, day, hour), value) for day, hour, value in given], "video_id long, platform string, ts timestamp, value long")

    merge_buckets(spark, path, rows((1, 1, 10), (2, 1, 20), (2, 2, 30)))
    before = sorted(os.listdir(f"{path}/day=2024-01-01"))
    merge_buckets(spark, path, rows((2, 1, 5), (2, 2, 31), (3, 0, 1)))
    assert sorted(os.listdir(f"{path}/day=2024-01-01")) == before
    assert sorted((r.ts.day, r.ts.hour, r.value) for r in read_buckets(spark, path).collect()) == [(1, 1, 10), (2, 1, 20), (2, 2, 31), (3, 0, 1)]
