import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from test_ingest import FIELDS, SCHEMA, as_set, walked
from vidmetrics.operators import histories, ingest
from vidmetrics.operators.ingest import SparseRules

START = dt.datetime(2024, 1, 1)
HOT = 7


def minutes(n):
    return START + dt.timedelta(minutes=n)


def never_renewing(rng, n):
    """Watch time is known once and never again; views creep by one, so only every tenth row or so is stored."""
    return [(minutes(i), 5000 + i, 900 if i == 0 else None, 3, None) for i in range(n)]


def still(rng, n):
    """Nothing is ever worth a point after the first row."""
    return [(minutes(i), 5000, None, 3, rng.choice([None, 1])) for i in range(n)]


def far_future(rng, n):
    """One early row from the future makes all later ones late."""
    return [(START + dt.timedelta(days=9999) if i == 5 else minutes(i), 5000 + 20 * i, i, rng.choice([None, i]), None) for i in range(n)]


def mixed(rng, n):
    out = []
    for i in range(n):
        late = rng.choice([0, 0, 0, 400, 1])
        out.append((
            minutes(i - i % 3 - late), rng.choice([None, 5000 + i, 5000 + i // 2, 10]), rng.choice([None, i, i - 50]),
            rng.choice([None] * 30 + [i // 200]), rng.choice([None, 4]),
        ))
    return out


def rare_counter(rng, n):
    """Likes come only late or below a stored one, so the last received value is not the stored one."""
    return [(minutes(i - (300 if i % 37 == 5 else 0)), 5000 + 3 * i, None, 8 if i == 1 else (i if i % 37 == 5 else None), None) for i in range(n)]


def feed_of(kind, seed=1, n=900):
    rng = random.Random(seed)
    rows = [(2 * i, HOT, *r) for i, r in enumerate(kind(rng, n))]
    rows += [(2 * i + 1, 100 + i % 9, *r) for i, r in enumerate(mixed(rng, 60))]
    return rows


@pytest.mark.parametrize(("kind", "guard"), [
    (never_renewing, False), (still, False), (far_future, False), (mixed, False), (rare_counter, False), (mixed, True), (far_future, True),
])
def test_one_source_in_many_chunks_equals_the_walk(spark, kind, guard):
    rows, rules = feed_of(kind), SparseRules(daily_guard=guard)
    feed = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = ingest.sparse_fold(feed, rules=rules, block=16, rows_per_segment=60)
    assert as_set(got) == walked(rows, rules)


def test_a_never_renewing_source_is_folded_by_several_tasks(spark):
    rules = SparseRules(daily_guard=False)
    rows = spark.createDataFrame(feed_of(never_renewing), SCHEMA)
    work = ingest._uncut(rows).withColumn("at_ms", F.unix_millis("snapshot_at")).drop("snapshot_at")
    cut = histories.in_chunks(work, FIELDS, rules, block=16, rows_per_chunk=60)
    sizes = cut.filter(f"source_video_id = {HOT} and _role = {histories.EMIT}").groupBy("_chunk").count()
    assert sizes.count() >= 10 and sizes.agg(F.max("count")).first()[0] <= 60 + 16
    starts = cut.filter(f"source_video_id = {HOT} and _role = {histories.STATE_ONLY}")
    assert starts.count() == sizes.count() and cut.filter("source_video_id <> 7").select("_chunk").distinct().count() == 1


def test_a_seed_starts_the_chain(spark):
    rows = feed_of(rare_counter)
    rules = SparseRules(daily_guard=False)
    first, later = rows[:200], rows[200:]
    stored = ingest.stored_points(ingest.sparse_fold(spark.createDataFrame(first, SCHEMA), rules=rules)).withColumn("id", F.col("arrival_seq"))
    got = as_set(ingest.sparse_fold(spark.createDataFrame(later, SCHEMA), stored, rules=rules, block=16, rows_per_segment=60))
    seqs = {r[0] for r in later}
    assert got == {d for d in walked(rows, rules) if d[0] in seqs}


def pieces_of(rows, guess, rules, entries=4):
    made = histories._described(iter([(0, *guess), *[(1, at, list(v)) for at, *v in rows]]), FIELDS, rules, entries)
    return {(kind, n): (at, values) for kind, n, at, values in made}


def test_other_starts_are_met_at_the_first_stored_row():
    """The guess stores other rows than the true start, whose trajectory was described all the same."""
    rules = SparseRules(daily_guard=False)
    rows = [(100 + i, 5004 + i, None, None, None) for i in range(200)]
    pieces = pieces_of(rows, (99, [5003, 900, 3, 1]), rules, entries=16)
    for views in range(4990, 5004):
        for silent in (None, 7):
            start = ingest.SourceState(FIELDS, rules, 50, [views, silent, 3, 1])
            want = start.copy()
            for at, *values in rows:
                want.decide(at, values)
            got, fits = histories._next_state(start, pieces)
            assert fits and (got.at, got.values) == (want.at, want.values)


def test_a_misfit_is_told():
    rules = SparseRules(daily_guard=False)
    rows = [(100 + i, 5000 + i // 10, None, 3 if i == 90 else None, None) for i in range(100)]
    pieces = pieces_of(rows, (99, [5000, None, 3, None]), rules)
    assert histories._next_state(ingest.SourceState(FIELDS, rules, 99, [5000, None, 4, None]), pieces)[1] is False
