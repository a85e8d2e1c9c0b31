"""Sparse ingestion as a stream: one state per source, kept between micro-batches.

A global watermark would be wrong here: whether a row is late depends on the last stored point of its
own source, which is exactly the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vidmetrics.operators.enrich import latest_per_source
from vidmetrics.operators.ingest import SourceState, SparseRules, _decision_schema, feed_fields, stored_points
from vidmetrics.sources.tables import merge_points


def sparse_stream(feed: DataFrame, seed: DataFrame | None = None, *, rules: SparseRules = SparseRules()) -> DataFrame:
    """I1, I2 over a streaming feed; same columns as the batch fold.

    ``seed`` holds the points that are already stored, read when the stream starts: a source without a state,
    as after a new checkpoint, starts from its newest one. Rows of one source inside a micro-batch are
    folded in arrival order; the size of a micro-batch is set by the source of the stream
    (``maxFilesPerTrigger`` and the like). Counters travel as text, since pandas has no nullable long.
    """
    fields = feed_fields(feed)
    seeded = [f"seed_{c}" for c in ("at_ms", *fields)]
    out = _decision_schema(fields)
    state_schema = T.StructType([T.StructField("at_ms", T.LongType())] + [T.StructField(f, T.LongType()) for f in fields])

    has_seed = seed is not None

    def number(x) -> int | None:
        return None if pd.isna(x) else int(x)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        known = SourceState(fields, rules)
        if state.exists:
            known.at, *values = state.get
            known.values = list(values)
        elif has_seed and len(frames[0]) and not pd.isna(frames[0]["seed_at_ms"].iloc[0]):
            known.at, *values = (number(x) for x in frames[0][seeded].iloc[0])
            known.values = list(values)
        rows = sorted(
            (int(row[0]), int(row[1]), [number(x) for x in row[2:]])
            for pdf in frames for row in pdf[["arrival_seq", "at_ms", *fields]].itertuples(index=False, name=None)
        )
        decided = []
        for seq, at, received in rows:
            stored, reason, corrections, delta, merged = known.decide(at, received)
            decided.append((seq, key[0], at, stored, reason, corrections, delta, *merged))
        state.update((known.at, *known.values))
        yield pd.DataFrame({
            c: pd.array([d[i] for d in decided], dtype="Int64") if c in ("views_delta", *fields) else [d[i] for d in decided]
            for i, c in enumerate(out.names)
        })

    rows = feed.select(
        "arrival_seq", "source_video_id", F.unix_millis("snapshot_at").alias("at_ms"),
        *[F.col(f).cast("long").cast("string").alias(f) for f in fields],
    )
    if seed is not None:
        last = latest_per_source(seed).select(
            "source_video_id", F.unix_millis("snapshot_at").cast("string").alias("seed_at_ms"),
            *[(F.col(f) if f in seed.columns else F.lit(None)).cast("long").cast("string").alias(f"seed_{f}") for f in fields],
        )
        rows = rows.join(last, "source_video_id", "left")
    decided = rows.groupBy("source_video_id").applyInPandasWithState(
        fold, out, state_schema, "append", GroupStateTimeout.NoTimeout
    )
    return decided.select(
        "arrival_seq", "source_video_id", F.timestamp_millis("at_ms").alias("snapshot_at"), "stored",
        "reason", "monotonic_corrections", "views_delta", *fields,
    )


def store_batches(path: str, on_stored: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink into the day-wise point table. Points are merged by key, so a later
    decision for a stored instant takes its place and a repeated batch changes nothing; ``on_stored`` is
    called with the batch number only when something was stored."""
    def write(batch: DataFrame, number: int) -> None:
        points = stored_points(batch).persist()
        try:
            if not points.isEmpty():
                merge_points(batch.sparkSession, path, points)
                if on_stored is not None:
                    on_stored(number)
        finally:
            points.unpersist()

    return write
