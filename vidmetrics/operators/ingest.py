"""Sparse ingestion: which received snapshots become stored points.

The state of a source is its last *stored* point with merged values, so a decision depends on the
decisions before it. The fold is a small Python step over rows that Spark has partitioned on the
source and sorted by arrival; it streams Arrow batches and holds one state at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from vidmetrics.operators import histories
from vidmetrics.operators.enrich import latest_per_source
from vidmetrics.operators.histories import EMIT as _EMIT, STATE_ONLY as _STATE_ONLY
from vidmetrics.operators.sparse_state import SourceState, SparseRules
from vidmetrics.schemas import COUNTERS, MONOTONE

STORED_REASONS = (
    "first_snapshot", "same_timestamp_update", "useful_metric_changed", "views_delta", "daily_guard",
)


def feed_fields(feed: DataFrame) -> list[str]:
    """Counters the feed carries; absent ones stay unknown and decide nothing."""
    return [c for c in COUNTERS if c in feed.columns]


def _decision_schema(fields: Sequence[str]) -> T.StructType:
    schema = T.StructType()
    for name, kind in (
        ("arrival_seq", "long"), ("source_video_id", "long"), ("at_ms", "long"), ("stored", "boolean"),
        ("reason", "string"), ("monotonic_corrections", "integer"), ("views_delta", "long"),
        *((f, "long") for f in fields),
    ):
        schema.add(name, kind)
    return schema


def _fold(
    batches: Iterable[pa.RecordBatch], fields: Sequence[str], rules: SparseRules
) -> Iterator[pa.RecordBatch]:
    names = ["_segment", "_chunk", "_role", "arrival_seq", "source_video_id", "at_ms", *fields]
    out = to_arrow_schema(_decision_schema(fields))
    current, state = None, None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
        rows = []
        for segment, chunk, role, seq, source, at, *received in zip(*columns):
            if (source, segment, chunk) != current:
                current, state = (source, segment, chunk), SourceState(fields, rules)
            if role == _STATE_ONLY:
                state.at, state.values = at, received
            else:
                rows.append((seq, source, at, *_flat(state.decide(at, received))))
        if rows:
            arrays = [pa.array(c, field.type) for c, field in zip(zip(*rows), out)]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)


def _flat(decision: tuple) -> tuple:
    return (*decision[:4], *decision[4])


def sparse_fold(
    feed: DataFrame, seed: DataFrame | None = None, *, rules: SparseRules = SparseRules(),
    block: int = 1 << 20, rows_per_segment: int = 500_000,
) -> DataFrame:
    """One decision per received snapshot, with the merged counters.

    ``feed`` has a unique ``arrival_seq``, ``source_video_id``, ``snapshot_at`` and counters; rows are
    folded in arrival order. ``seed`` holds already stored points, of which the newest per source is
    the initial state. Histories of more than ``rows_per_segment`` rows are cut at points whose result does not
    depend on the past (see ``_segments``), and what stays longer into chunks that are described, chained
    and folded side by side (see ``histories``), so one source is folded by many tasks whatever it
    sends. ``block`` is a width in arrival numbers; a feed should span at most some hundred thousand blocks.
    Histories are counted when this is called.
    """
    fields = feed_fields(feed)
    if "views_native" not in fields:
        raise ValueError("the feed needs views_native")
    keys = ["arrival_seq", "source_video_id", "snapshot_at"]
    rows = feed.select(*keys, *[F.col(c).cast("long").alias(c) for c in fields])
    crowded = rows.groupBy("source_video_id").count().filter(F.col("count") > rows_per_segment)
    cut = not crowded.isEmpty()
    work = _segments(rows, fields, seed, rules, block, rows_per_segment) if cut else _uncut(rows)
    if seed is not None:
        work = work.unionByName(_seed_rows(seed, fields, rows))
    work = work.withColumn("at_ms", F.unix_millis("snapshot_at")).drop("snapshot_at")
    if cut:
        work = histories.in_chunks(work, fields, rules, block=block, rows_per_chunk=rows_per_segment)
    else:
        work = work.withColumn("_chunk", F.lit(0).cast("long"))
    history = ["source_video_id", "_segment", "_chunk"]
    sorted_rows = (
        work.select("_segment", "_chunk", "_role", "arrival_seq", "source_video_id", "at_ms", *fields)
        .repartition(*history).sortWithinPartitions(*history, "_role", "arrival_seq")
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _fold(batches, fields, rules)

    decided = sorted_rows.mapInArrow(fold, _decision_schema(fields))
    return decided.select(
        "arrival_seq", "source_video_id", F.timestamp_millis("at_ms").alias("snapshot_at"),
        "stored", "reason", "monotonic_corrections", "views_delta", *fields,
    )


_FIRST_SEGMENT = -(1 << 62)


def _uncut(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_segment": F.lit(_FIRST_SEGMENT).cast("long"), "_role": F.lit(_EMIT)})


def _seed_rows(seed: DataFrame, fields: Sequence[str], rows: DataFrame) -> DataFrame:
    present = [F.col(c).cast("long").alias(c) if c in seed.columns else F.lit(None).cast("long").alias(c) for c in fields]
    last = latest_per_source(seed).select(
        F.lit(-1).cast("long").alias("arrival_seq"), "source_video_id", "snapshot_at", *present,
        F.lit(_FIRST_SEGMENT).cast("long").alias("_segment"), F.lit(_STATE_ONLY).alias("_role"),
    )
    return last.join(rows.select("source_video_id").distinct(), "source_video_id", "left_semi")


def _segments(
    rows: DataFrame, fields: Sequence[str], seed: DataFrame | None, rules: SparseRules,
    block: int, rows_per_segment: int,
) -> DataFrame:
    """Cuts long histories where the state is known without the past.

    A row renews the state when its day is later than every day received before (so it is in order,
    and the daily guard stores it), each of its counters is known or was never known before, and its
    guarded counters are at least every value received before. After such a row the state is the row
    itself. It closes the segment before it, where it is decided, and opens its own, as state only.

    What was received before is known per block of arrivals from one aggregate row per
    (source, block); only blocks in which a source passes a multiple of ``rows_per_segment`` rows are
    searched, so sources of ordinary length are not touched at all.
    """
    if not rules.daily_guard:
        return _uncut(rows)
    guarded = [f for f in fields if f in MONOTONE]
    blocked = rows.withColumn("_block", F.floor(F.col("arrival_seq") / F.lit(block)))
    tops = {"_top_at": F.col("snapshot_at"), **{f"_top_{f}": F.col(f) for f in guarded}}
    known = {f"_known_{f}": F.col(f).isNotNull() for f in fields}
    per_block = blocked.groupBy("source_video_id", "_block").agg(
        F.count("*").alias("_n"),
        *[F.max(c).alias(n) for n, c in tops.items()], *[F.max(c).alias(n) for n, c in known.items()],
    )
    earlier = Window.partitionBy("source_video_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    history = per_block.select(
        "source_video_id", "_block", "_n", before.alias("_before"),
        *[F.max(n).over(earlier).alias(f"past{n}") for n in (*tops, *known)],
    )
    crossing = history.filter(
        F.floor(F.col("_before") / rows_per_segment) != F.floor((F.col("_before") + F.col("_n")) / rows_per_segment)
    ).drop("_n", "_before")
    if seed is not None:
        last = latest_per_source(seed)
        first = last.select(
            "source_video_id", F.col("snapshot_at").alias("seed_top_at"),
            *[(F.col(f) if f in last.columns else F.lit(None)).cast("long").alias(f"seed_top_{f}") for f in guarded],
            *[(F.col(f).isNotNull() if f in last.columns else F.lit(False)).alias(f"seed_known_{f}") for f in fields],
        )
        crossing = crossing.join(first, "source_video_id", "left").withColumns({
            f"past{n}": F.greatest(F.col(f"past{n}"), F.col(f"seed{n}")) for n in (*tops, *known)
        }).drop(*[f"seed{n}" for n in (*tops, *known)])
    nearer = (
        Window.partitionBy("source_video_id", "_block").orderBy("arrival_seq")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    past = {n: F.greatest(F.col(f"past{n}"), F.max(c).over(nearer)) for n, c in (tops | known).items()}
    searched = blocked.join(crossing, ["source_video_id", "_block"]).withColumns(past)
    renews = F.to_date("snapshot_at") > F.to_date("_top_at")
    for f in fields:
        renews = renews & (F.col(f).isNotNull() | ~F.coalesce(F.col(f"_known_{f}"), F.lit(False)))
    for f in guarded:
        renews = renews & (F.col(f).isNull() | F.col(f"_top_{f}").isNull() | (F.col(f) >= F.col(f"_top_{f}")))
    cuts = searched.filter(renews).groupBy("source_video_id", "_block").agg(F.min("arrival_seq").alias("_cut"))
    so_far = Window.partitionBy("source_video_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        per_block.select("source_video_id", "_block")
        .join(cuts.select("source_video_id").distinct(), "source_video_id", "left_semi")
        .join(cuts, ["source_video_id", "_block"], "left")
        .withColumn("_from", F.last("_cut", ignorenulls=True).over(so_far))
    )
    start = F.when(F.col("arrival_seq") >= F.col("_cut"), F.col("_cut")).otherwise(F.col("_from"))
    segment = F.coalesce(start, F.lit(_FIRST_SEGMENT))
    previous = F.coalesce(F.col("_from"), F.lit(_FIRST_SEGMENT))
    places = F.when(
        F.col("arrival_seq") == F.col("_cut"),
        F.array(
            F.struct(previous.cast("long").alias("_segment"), F.lit(_EMIT).alias("_role")),
            F.struct(segment.cast("long").alias("_segment"), F.lit(_STATE_ONLY).alias("_role")),
        ),
    ).otherwise(F.array(F.struct(segment.cast("long").alias("_segment"), F.lit(_EMIT).alias("_role"))))
    return (
        blocked.join(placed, ["source_video_id", "_block"], "left")
        .select(*rows.columns, F.explode(places).alias("_p"))
        .select(*rows.columns, "_p._segment", "_p._role")
    )


def stored_points(decisions: DataFrame) -> DataFrame:
    """Rows to write: of several stored decisions for one (source, instant), the last one wins."""
    from vidmetrics.operators.spread import first_rows

    kept = first_rows(
        decisions.filter("stored"), ["source_video_id", "snapshot_at"], [F.col("arrival_seq").desc()]
    )
    return kept.drop("stored", "monotonic_corrections", "views_delta")


def ingest_report(decisions: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Decisions per reason. Rejected items count as ``error``."""
    report = decisions.groupBy("reason", "stored").agg(
        F.count("*").alias("items"), F.sum("monotonic_corrections").alias("monotonic_corrections")
    )
    if rejected is not None:
        errors = rejected.agg(F.count("*").alias("items")).filter("items > 0").select(
            F.lit("error").alias("reason"), F.lit(False).alias("stored"), "items",
            F.lit(0).cast("long").alias("monotonic_corrections"),
        )
        report = report.unionByName(errors)
    return report


def ingest_totals(report: DataFrame) -> DataFrame:
    """The single-line report of a run."""
    good = F.col("reason") != "error"
    return report.agg(
        F.coalesce(F.sum(F.when(good, F.col("items"))), F.lit(0)).alias("ok"),
        F.coalesce(F.sum(F.when(~good, F.col("items"))), F.lit(0)).alias("ko"),
        F.coalesce(F.sum(F.when(F.col("stored"), F.col("items"))), F.lit(0)).alias("stored"),
        F.coalesce(F.sum(F.when(good & ~F.col("stored"), F.col("items"))), F.lit(0)).alias("skipped"),
        F.coalesce(F.sum("monotonic_corrections"), F.lit(0)).alias("monotonic_corrections"),
    )


def polling_due(ms: DataFrame, sv: DataFrame, *, as_of) -> DataFrame:
    """Which sources are due. Fixed cadence: 2 h up to 3 days of age, 6 h up to 7, then daily."""
    from vidmetrics.operators.spread import instant

    now = instant(as_of)
    last = ms.groupBy("source_video_id").agg(F.max("snapshot_at").alias("last_snapshot_at"))
    age_days = F.timestamp_diff("DAY", F.col("published_at"), now)
    wait = F.when(age_days <= 3, 2).when(age_days <= 7, 6).otherwise(24)
    next_at = F.timestamp_add("HOUR", F.col("wait_hours"), F.col("last_snapshot_at"))
    return (
        sv.select(F.col("id").alias("source_video_id"), "platform", "published_at")
        .join(last, "source_video_id", "left")
        .withColumn("wait_hours", wait)
        .select(
            "source_video_id", "platform", "last_snapshot_at", "wait_hours",
            F.coalesce(next_at < now, F.lit(True)).alias("due"),
            F.coalesce(
                F.greatest(F.lit(0), F.unix_seconds(next_at) - F.unix_seconds(now)), F.lit(0)
            ).cast("long").alias("next_delay_seconds"),
        )
    )
