import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vidmetrics.operators import ingest
from vidmetrics.operators.ingest import SourceState, SparseRules
from vidmetrics.schemas import COUNTERS

DAY = 86_400_000
FIELDS = ("views_native", "total_watch_seconds", "likes", "reach")
SCHEMA = (
    "arrival_seq long, source_video_id long, snapshot_at timestamp, views_native long, "
    "total_watch_seconds long, likes long, reach long"
)


def state(*steps, rules=SparseRules()):
    s = SourceState(FIELDS, rules)
    return [s.decide(at, list(values)) for at, *values in steps]


def reasons(*steps, **kw):
    return [d[1] for d in state(*steps, **kw)]


def test_first_then_small_then_large_step():
    assert reasons((0, 1000, 5, 1, 9), (10, 1005, 5, 1, 9), (20, 1010, 5, 1, 9)) == [
        "first_snapshot", "below_threshold", "views_delta"]


def test_relative_threshold_and_zero_base():
    assert reasons((0, 100, None, None, None), (1, 101, None, None, None))[1] == "views_delta"
    assert reasons((0, 0, None, None, None), (1, 9, None, None, None))[1] == "below_threshold"
    assert reasons((0, None, None, None, None), (1, 3, None, None, None))[1] == "views_delta"


def test_skipped_rows_leave_the_state():
    # 5 + 5 views: the second step is measured from the last stored point
    assert reasons((0, 1000, 1, 1, 1), (1, 1005, 1, 1, 1), (2, 1009, 1, 1, 1), (3, 1011, 1, 1, 1)) == [
        "first_snapshot", "below_threshold", "below_threshold", "views_delta"]


def test_reason_priority_and_daily_guard():
    out = state((0, 10, 1, 1, 1), (DAY, 1000, 1, 2, 1), (2 * DAY, 1001, 1, 2, 1), (3 * DAY, 1500, 1, 2, 1))
    assert [d[1] for d in out] == ["first_snapshot", "useful_metric_changed", "daily_guard", "views_delta"]
    assert reasons((0, 10, 1, 1, 1), (DAY, 10, 1, 1, 1), rules=SparseRules(daily_guard=False))[1] == "below_threshold"


def test_unknown_takes_the_stored_value_and_counters_never_fall():
    stored, reason, corrections, delta, merged = state((0, 100, 50, 3, 7), (DAY, 90, 40, None, None))[1]
    assert (stored, reason, corrections, delta) == (True, "daily_guard", 2, 0)
    assert merged == [100, 50, 3, 7]


def test_reach_and_watch_time_alone_do_not_store():
    assert reasons((0, 100, 5, 1, 1), (1, 100, 500, 1, 900))[1] == "below_threshold"


def test_late_and_repeated_instants():
    out = state((10, 100, 1, 1, 1), (5, 900, 1, 1, 1), (10, 101, 1, 1, 1))
    assert [d[1] for d in out] == ["first_snapshot", "out_of_order", "same_timestamp_update"]
    assert out[1][3] is None and out[2][3] == 1


def random_feed(seed, rows=600, sources=3):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    views = [0] * sources
    out = []
    for seq in range(rows):
        s = 0 if rng.random() < 0.7 else rng.randrange(sources)
        views[s] += rng.choice([0, 1, 3, 40])
        at = start + dt.timedelta(hours=seq // 3 - (30 if rng.random() < 0.05 else 0))
        out.append((
            seq, s, at, None if rng.random() < 0.1 else max(0, views[s] - (5 if rng.random() < 0.1 else 0)),
            views[s] * 2, rng.choice([None, views[s] // 50]), rng.choice([None, 7]) if seq > 100 else None,
        ))
    return out


def walked(rows, rules=SparseRules()):
    states, out = {}, set()
    for seq, s, at, *values in sorted(rows):
        millis = int(at.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        d = states.setdefault(s, SourceState(FIELDS, rules)).decide(millis, values)
        out.add((seq, d[0], d[1], d[2], d[3], *d[4]))
    return out


def as_set(df):
    names = ["arrival_seq", "stored", "reason", "monotonic_corrections", "views_delta", *FIELDS]
    return {tuple(r) for r in df.select(*names).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_cut_histories_give_the_same_decisions(spark, seed):
    rows = random_feed(seed)
    feed = spark.createDataFrame(rows, SCHEMA)
    want = walked(rows)
    assert as_set(ingest.sparse_fold(feed)) == want
    cut = ingest.sparse_fold(feed, block=40, rows_per_segment=25)
    assert as_set(cut) == want
    typed = feed.select("arrival_seq", "source_video_id", "snapshot_at", *FIELDS)
    parts = ingest._segments(typed, FIELDS, None, SparseRules(), 40, 25)
    assert parts.filter("source_video_id = 0").select("_segment").distinct().count() > 1


def test_seed_is_the_initial_state(spark):
    rows = random_feed(5, rows=400)
    whole = as_set(ingest.sparse_fold(spark.createDataFrame(rows, SCHEMA)))
    first = ingest.sparse_fold(spark.createDataFrame(rows[:200], SCHEMA))
    stored = ingest.stored_points(first).withColumn("id", F.col("arrival_seq"))
    later = [r for r in rows[200:]]
    for options in ({}, {"block": 40, "rows_per_segment": 25}):
        second = ingest.sparse_fold(spark.createDataFrame(later, SCHEMA), stored, **options)
        assert as_set(first) | as_set(second) == whole


def test_stored_views_never_fall_and_one_first_point(fixtures):
    from pyspark.sql.window import Window

    d = ingest.sparse_fold(fixtures.snapshot_feed)
    w = Window.partitionBy("source_video_id").orderBy("snapshot_at")
    stored = ingest.stored_points(d).withColumn("prev", F.lag("views_native").over(w))
    assert stored.filter("views_native < prev").isEmpty()
    firsts = d.filter("reason = 'first_snapshot'").groupBy("source_video_id").count()
    assert firsts.filter("count <> 1").isEmpty()


def test_totals_count_rejects(spark):
    rows = random_feed(3, rows=50)
    d = ingest.sparse_fold(spark.createDataFrame(rows, SCHEMA))
    rejected = spark.range(4)
    total = ingest.ingest_totals(ingest.ingest_report(d, rejected)).first()
    assert total.ok == 50 and total.ko == 4 and total.stored + total.skipped == 50


def test_field_lists_are_consistent():
    assert len(COUNTERS) == 16
