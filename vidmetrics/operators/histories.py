"""Long histories of one source, folded by many tasks.

A fold is a chain: each decision needs the state that the rows before left. A long history is cut into chunks
anyway, in three steps. Tasks *describe* the chunks side by side: from a guessed start, and as if each of the
first rows were the first one stored, to which end does the chunk lead? The descriptions are *chained*: from
the true start of a chunk its first rows are decided until the state is one that was described, whose end is
the start of the next chunk. Chunks where no description fits are described again from the start that the chain
gave them, until all fit. Then every chunk is folded from its true start.

Trajectories soon meet, since a stored row sets the state anew, so a few descriptions cover a chunk. Counters that a chunk never
reports, and chunks whose rows are all too late or all below the thresholds, are passed through whatever the start.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from vidmetrics.operators.sparse_state import DAY_MS, SourceState, SparseRules
from vidmetrics.schemas import MONOTONE, USEFUL
from vidmetrics.session import ensure_checkpoint_dir

EMIT, STATE_ONLY = 1, 0
#: First rows of a chunk that are described as entries: more of them fit more starts.
ENTRIES = 16
_HISTORY = ["source_video_id", "_segment"]
_CHUNK = [*_HISTORY, "_chunk"]
_GUESS, _FIRST_ROW, _ENTRY, _END, _BOTTOM, _TOP = range(6)
_FROM_GUESS = -1
#: Counters that can make a row worth a point; the others only travel with it.
DECIDING = ("views_native", *USEFUL)


def _schema(fields: Sequence[str], *extra: tuple[str, T.DataType]) -> T.StructType:
    columns = [(c, T.LongType()) for c in _CHUNK] + [*extra, ("at_ms", T.LongType())] + [(f, T.LongType()) for f in fields]
    return T.StructType([T.StructField(n, t) for n, t in columns])


def _pieces(fields: Sequence[str]) -> T.StructType:
    return _schema(fields, ("_kind", T.LongType()), ("_n", T.LongType()))


def _rows(batches: Iterable[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def _batches(rows: Iterable[tuple], schema: T.StructType, size: int = 8192) -> Iterator[pa.RecordBatch]:
    kinds = to_arrow_schema(schema)
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)


def _described(rows: Iterator[tuple], fields: Sequence[str], rules: SparseRules, entries: int) -> Iterator[tuple]:
    """Pieces (kind, n, at, counters) that describe one chunk; ``rows`` start with the guess. Memory: a state per live trajectory."""
    _, at, guess = next(rows)
    yield _GUESS, 0, at, guess
    start = SourceState(fields, rules, at, guess if at is not None else None)
    tracks = [[start.copy(), [_FROM_GUESS]]]
    seen, bottom, top, count, quiet = [0] * len(fields), None, None, 0, True
    for _, at, received in rows:
        moved = False
        for state, numbers in tracks:
            stored, reason, *_ = state.decide(at, received)
            moved |= stored
            if numbers[0] == _FROM_GUESS and (stored or reason == "out_of_order"):
                quiet = False
        if count < entries:
            yield _FIRST_ROW, count, at, received
            if start.at is not None and at >= start.at:
                entry = SourceState(fields, rules, at, start.merged(received)[0])
                yield _ENTRY, count, at, entry.values
                tracks.append([entry, [count]])
                moved = True
        if moved and len(tracks) > 1:
            met: dict[tuple, list] = {}
            for state, numbers in tracks:
                met.setdefault((state.at, *(state.values or ())), [state, []])[1].extend(numbers)
            tracks = list(met.values())
        seen = [s or int(r is not None) for s, r in zip(seen, received)]
        bottom, top = (at if bottom is None else min(bottom, at)), (at if top is None else max(top, at))
        count += 1
    for state, numbers in tracks:
        for n in numbers:
            yield _END, n, state.at, state.values
    yield _BOTTOM, count, bottom, seen
    yield _TOP, int(quiet), top, [None] * len(fields)


def _next_state(state: SourceState, pieces: dict[tuple[int, int], tuple]) -> tuple[SourceState, bool]:
    """(state behind the chunk, whether its description fits ``state``); where it doesn't, the state is a new guess."""
    fields, rules = state.fields, state.rules
    (guess_at, guess), = [v for (kind, _), v in pieces.items() if kind == _GUESS]
    (count, bottom, seen), = [(n, *v) for (kind, n), v in pieces.items() if kind == _BOTTOM]
    (quiet, top), = [(n, v[0]) for (kind, n), v in pieces.items() if kind == _TOP]

    own = state.values or [None] * len(fields)

    def alike(values: Sequence[int | None] | None, others: Sequence[int | None], matter: Sequence[object] = seen) -> bool:
        return all(a == b for a, b, s in zip(values or [None] * len(fields), others, matter) if s)

    def end_of(n: int) -> SourceState:
        at, values = pieces[_END, n]
        return SourceState(fields, rules, at, [v if s else old for v, old, s in zip(values, own, seen)])

    same = alike(own, guess, [s and f in DECIDING for f, s in zip(fields, seen)])
    if state.at == guess_at and alike(own, guess):
        return end_of(_FROM_GUESS), True
    if state.at is not None and state.at > top:
        return state, True
    if quiet and same and state.at is not None and guess_at is not None and state.at < bottom and (
        not rules.daily_guard or state.at // DAY_MS == guess_at // DAY_MS
    ):
        return state, True
    walk, n = state.copy(), 0
    while (_FIRST_ROW, n) in pieces:
        at, received = pieces[_FIRST_ROW, n]
        if walk.decide(at, received)[0] and (_ENTRY, n) in pieces:
            entry_at, entry = pieces[_ENTRY, n]
            if walk.at == entry_at and alike(walk.values, entry):
                return end_of(n), True
        n += 1
    if n == count:
        return walk, True
    # No description fits. What the chunk left as it was under the old guess is taken to pass through.
    end_at, end = pieces[_END, _FROM_GUESS]
    onward = [old if v == g else v for v, g, old in zip(end, guess, own)]
    return SourceState(fields, rules, state.at if end_at == guess_at else end_at, onward), False


def _chained(chunks: Iterator[tuple[int, list[tuple]]], fields: Sequence[str], rules: SparseRules) -> Iterator[tuple]:
    """(chunk, missed, at, counters of its start) for the chunks of one history in order."""
    state = None
    for chunk, rows in chunks:
        pieces = {(kind, n): (at, values) for kind, n, at, values in rows}
        if state is None:
            at, values = pieces[_GUESS, 0]
            state = SourceState(fields, rules, at, values if at is not None else None)
        start, (state, fits) = state, _next_state(state, pieces)
        yield chunk, not fits, start.at, start.values or [None] * len(fields)


def _guesses(hot: DataFrame, first: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The state before each chunk as if every row were stored; exact for the first chunk."""
    newest = {
        f: F.max(f) if f in MONOTONE else F.max_by(f, F.when(F.col(f).isNotNull(), F.col("arrival_seq"))) for f in fields
    }
    sums = hot.groupBy(*_CHUNK).agg(F.max("at_ms").alias("at_ms"), *[c.alias(f) for f, c in newest.items()])
    known = sums.unionByName(first.withColumn("_chunk", F.lit(-1).cast("long")).select(*sums.columns))
    earlier = Window.partitionBy(*_HISTORY).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return known.select(
        *_CHUNK, F.max("at_ms").over(earlier).alias("at_ms"),
        *[(F.max(f) if f in MONOTONE else F.last(f, ignorenulls=True)).over(earlier).alias(f) for f in fields],
    ).filter("_chunk >= 0")


def _placed(rows: DataFrame, block: int, rows_per_chunk: int) -> DataFrame:
    """(history, _block, _chunk) of the histories of more than one chunk; a chunk is a run of blocks of arrivals."""
    per_block = rows.groupBy(*_HISTORY, "_block").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*_HISTORY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    placed = per_block.select(*_HISTORY, "_block", F.floor(before / rows_per_chunk).cast("long").alias("_chunk"))
    several = placed.filter("_chunk > 0").select(*_HISTORY).distinct()
    return placed.join(several, _HISTORY, "left_semi").checkpoint()


def in_chunks(
    work: DataFrame, fields: Sequence[str], rules: SparseRules, *, block: int, rows_per_chunk: int, entries: int = ENTRIES,
) -> DataFrame:
    """``work`` (history, _role, arrival_seq, at_ms, counters) with ``_chunk`` and one row of state only in front of
    every chunk of a long history. A chunk has at most ``rows_per_chunk`` rows and one block of arrivals more.

    Every round settles at least one more chunk of each history; as a rule one or two are enough. The driver sees a flag a
    round. The chain streams ``3 * entries + 4`` short rows a chunk through one task for each history.
    """
    spark = work.sparkSession
    ensure_checkpoint_dir(spark)
    blocked = work.filter(F.col("_role") == EMIT).withColumn("_block", F.floor(F.col("arrival_seq") / F.lit(block)))
    placed = _placed(blocked, block, rows_per_chunk)
    if placed.isEmpty():
        return work.withColumn("_chunk", F.lit(0).cast("long"))
    long = placed.select(*_HISTORY).distinct()
    values = ["at_ms", *fields]
    hot = blocked.join(placed, [*_HISTORY, "_block"]).select(*_CHUNK, "_role", "arrival_seq", *values).checkpoint()
    first = work.filter(F.col("_role") == STATE_ONLY).join(long, _HISTORY, "left_semi")
    pieces, found = _pieces(fields), _schema(fields, ("_missed", T.BooleanType()))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            rows = _rows(batches, [*_CHUNK, "_role", *values])
            for key, group in groupby(rows, key=lambda r: r[:3]):
                for kind, n, at, counters in _described(((r[3], r[4], list(r[5:])) for r in group), fields, rules, entries):
                    yield (*key, kind, n, at, *counters)
        yield from _batches(made(), pieces)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            rows = _rows(batches, [*_CHUNK, "_kind", "_n", *values])
            for key, history in groupby(rows, key=lambda r: r[:2]):
                chunks = ((chunk, [(r[3], r[4], r[5], list(r[6:])) for r in group]) for chunk, group in groupby(history, key=lambda r: r[2]))
                for chunk, missed, at, counters in _chained(chunks, fields, rules):
                    yield (*key, chunk, missed, at, *counters)
        yield from _batches(made(), found)

    def with_starts(rows: DataFrame, starts: DataFrame) -> DataFrame:
        return rows.unionByName(starts.select(
            *_CHUNK, F.lit(STATE_ONLY).alias("_role"), F.lit(-1).cast("long").alias("arrival_seq"), *values
        ))

    known, guesses, rows = None, _guesses(hot, first, fields), hot
    while True:
        described = with_starts(rows, guesses).repartition(*_CHUNK).sortWithinPartitions(*_CHUNK, "_role", "arrival_seq")
        fresh = described.mapInArrow(describe, pieces)
        if known is not None:
            fresh = known.join(guesses.select(*_CHUNK), _CHUNK, "left_anti").unionByName(fresh)
        known = fresh.checkpoint()
        starts = (
            known.repartition(*_HISTORY).sortWithinPartitions(*_CHUNK, "_kind", "_n").mapInArrow(chain, found).checkpoint()
        )
        guesses = starts.filter("_missed").drop("_missed")
        if guesses.isEmpty():
            break
        rows = hot.join(guesses.select(*_CHUNK), _CHUNK, "left_semi")
    short = work.join(long, _HISTORY, "left_anti").withColumn("_chunk", F.lit(0).cast("long"))
    return short.unionByName(with_starts(hot, starts))
