"""Which publications are the same video: clusters, canonical records, links, overrides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.window import Window

from vidmetrics.functions.text import UNTITLED, is_blank, normal_title
from vidmetrics.operators.spread import first_rows, numbered
from vidmetrics.session import ensure_checkpoint_dir

_LONGS = pa.list_(pa.int64())
_STEPS = pa.schema({"norm_title": pa.string(), "at": pa.int64(), "opened_at": pa.int64()})
_BLOCK = {"norm_title": pa.string(), "segment": pa.int64(), "block": pa.int64()}
_MAPS = pa.schema({**_BLOCK, "below": _LONGS, "opened": _LONGS, "reference": _LONGS, "add": pa.int64(), "shift": pa.int64()})
_STATES = pa.schema({**_BLOCK, "reference": pa.int64(), "opened": pa.int64()})
_LOW, _HIGH = -(1 << 62), 1 << 62


def candidates(sv: DataFrame, v: DataFrame, *, start=None, end=None) -> DataFrame:
    """Active sources whose video is not locked, optionally published in a closed range."""
    rows = sv.filter(F.col("is_active") == 1)
    if start is not None:
        rows = rows.filter(F.col("published_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.filter(F.col("published_at") <= F.lit(end).cast("timestamp"))
    locked = v.filter(F.col("is_locked") == 1).select(F.col("id").alias("video_id"))
    return rows.join(locked, "video_id", "left_anti")


def _moved(reference: int, at: int, n: int) -> int:
    """The reference after ``n`` matches at one second: each goes half the way, rounded up."""
    while n and reference != at:
        reference = (reference + at + 1) // 2
        n -= 1
    return reference


def _walk(batches: Iterator[pa.RecordBatch], window_s: int) -> Iterator[pa.RecordBatch]:
    """Steps of blocks of seconds; a row without a second carries the state at the start of its block."""
    current, reference, opened = None, None, None
    for batch in batches:
        rows = []
        for title, segment, block, at, n, carried, carried_opened in zip(*(c.to_pylist() for c in batch.columns)):
            key = title, segment, block
            if at is None:
                current, reference, opened = key, carried, carried_opened
                continue
            if key != current or at - reference > window_s:
                current, reference, opened = key, at, at
            else:
                reference = _moved(reference, at, n)
            rows.append((title, at, opened))
        yield _batch(rows, _STEPS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


class BlockMap:
    """What a block of seconds makes of the reference ``r`` that reaches it, for every ``r`` at once.

    A lower reference breaks no later, and behind a break nothing of ``r`` is left; so the map is a few constant
    pieces in the order of ``r``, each with the second that opened its cluster (None: the one before the block),
    and, above them, references without a break. Those stay a run of numbers, ``(r + add) >> shift``, and each
    match halves it; once it holds two values it becomes pieces too.
    """

    def __init__(self, window_s: int, first: int):
        self.window_s = window_s
        self.pieces: list[list] = []  # r below this, opened, reference
        self.low, self.high, self.add, self.shift = _LOW, first, 0, 0

    def step(self, at: int, n: int) -> None:
        for piece in self.pieces:
            if at - piece[2] > self.window_s:
                piece[1] = piece[2] = at
            else:
                piece[2] = _moved(piece[2], at, n)
        if self.low <= self.high:
            self._step_run(at, n)
        if len(self.pieces) > 1:
            self.pieces = [p for p, after in zip(self.pieces, [*self.pieces[1:], None]) if after is None or p[1:] != after[1:]]

    def _step_run(self, at: int, n: int) -> None:
        kept = max(self.low, min(((at - self.window_s) << self.shift) - self.add, self.high + 1))
        if kept > self.low:
            self.pieces.append([kept, at, at])
            self.low = kept
        if self.low > self.high:
            return
        while n and (self.low + self.add) >> self.shift != at:
            self.add += (at + 1) << self.shift
            self.shift, n = self.shift + 1, n - 1
        least, most = ((r + self.add) >> self.shift for r in (self.low, self.high))
        if most - least <= 1:
            if most > least:
                self.pieces.append([(most << self.shift) - self.add, None, least])
            self.pieces.append([_HIGH, None, most])
            self.low = self.high + 1

    def columns(self) -> tuple[list, list, list, int | None, int | None]:
        """below, opened, reference of the pieces; add and shift where references without a break are left."""
        below, opened, reference = ([p[i] for p in self.pieces] for i in range(3))
        return below, opened, reference, *((self.add, self.shift) if self.low <= self.high else (None, None))


def _block_maps(batches: Iterator[pa.RecordBatch], window_s: int) -> Iterator[pa.RecordBatch]:
    current, made = None, None
    for batch in batches:
        rows = []
        for title, segment, block, at, n in zip(*(c.to_pylist() for c in batch.columns)):
            if (title, segment, block) != current:
                if made is not None:
                    rows.append((*current, *made.columns()))
                current, made = (title, segment, block), BlockMap(window_s, at)
            made.step(at, n)
        yield _batch(rows, _MAPS)
    if made is not None:
        yield _batch([(*current, *made.columns())], _MAPS)


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that reaches each block but the first of a segment, from the maps of the blocks before it."""
    current, reference, opened = None, _LOW, None
    for batch in batches:
        rows = []
        for title, segment, block, below, opened_at, made, add, shift in zip(*(c.to_pylist() for c in batch.columns)):
            if (title, segment) == current:
                rows.append((title, segment, block, reference, opened))
            else:
                current, reference, opened = (title, segment), _LOW - 1, None
            k = next((k for k, top in enumerate(below) if reference < top), None)
            if k is None:
                reference = (reference + add) >> shift
            else:
                reference, opened = made[k], opened if opened_at[k] is None else opened_at[k]
        yield _batch(rows, _STATES)


def cluster_sources(
    rows: DataFrame, *, hours: int = 48, cluster_blank_titles: bool = True, seconds_per_block: int = 200_000, keep: bool = False
) -> DataFrame:
    """Greedy clusters inside equal normalised titles around a moving reference time.

    Rows come in time order and a reference only moves on a match, so only the newest cluster of a
    title can match. All rows of one second fall into the same cluster, and the reference settles on
    that second after a few of them; so the walk sees one row per (title, second) with its count. A gap
    above the window always opens a cluster, so a title is cut at such gaps between its days. What stays
    longer than ``seconds_per_block`` is cut into blocks of days: tasks describe what each block makes of any
    reference (``BlockMap``), these short descriptions are chained, and all blocks are walked side by side from
    their true states. ``keep`` writes the steps to the shared folder, for callers that read the result twice.
    """
    dated = rows.filter(F.col("published_at").isNotNull()).withColumns({
        "norm_title": normal_title(F.col("title")), "at": F.unix_seconds("published_at"),
    }).filter(F.col("at") != 0)
    if not cluster_blank_titles:
        dated = dated.filter(F.col("norm_title") != "")
    seconds = dated.groupBy("norm_title", "at").agg(F.count("*").alias("n"))
    window_s = max(1, hours) * 3600

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _walk(batches, window_s)

    def block_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _block_maps(batches, window_s)

    day = F.floor(F.col("at") / 86_400)
    in_time = Window.partitionBy("norm_title").orderBy("day")
    in_segment = Window.partitionBy("norm_title", "segment").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    apart = F.when(F.col("first") - F.lag("last").over(in_time) > window_s, 1).otherwise(0)
    before = F.coalesce(F.sum("size").over(in_segment), F.lit(0))
    blocks = (
        seconds.groupBy("norm_title", day.alias("day"))
        .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("size"))
        .withColumn("apart", apart).select("norm_title", "day", "size", F.sum("apart").over(in_time).alias("segment"))
        .select("norm_title", "day", "segment", F.floor(before / seconds_per_block).alias("block"))
    )
    key = ["norm_title", "segment", "block"]
    long_ones = blocks.groupBy("norm_title", "segment").agg(F.max("block").alias("top")).filter("top > 0").drop("top")
    placed = seconds.withColumn("day", day).join(blocks, ["norm_title", "day"]).select(*key, "at", "n")
    maps = (
        placed.join(long_ones, ["norm_title", "segment"], "left_semi").repartition(*key).sortWithinPartitions(*key, "at")
        .mapInArrow(block_maps, from_arrow_schema(_MAPS))
    )
    states = (
        maps.repartition("norm_title", "segment").sortWithinPartitions(*key).mapInArrow(_carried, from_arrow_schema(_STATES))
    )
    none = F.lit(None).cast("long")
    steps = (
        placed.select(*key, "at", "n", none.alias("reference"), none.alias("opened"))
        .unionByName(states.select(*key, none.alias("at"), none.alias("n"), "reference", "opened"))
        .repartition(*key).sortWithinPartitions(*key, F.col("at").asc_nulls_first())
        .mapInArrow(walk, from_arrow_schema(_STEPS))
    )
    if keep:
        ensure_checkpoint_dir(rows.sparkSession)
        steps = steps.checkpoint()
    return dated.join(steps, ["norm_title", "at"])


def _place() -> Column:
    return F.struct("published_at", "id")


def _best_text(column: str) -> Column:
    """First non-blank YouTube text, else the longest non-blank one, else the longest."""
    text = F.col(column)
    tier = F.when(is_blank(text), 2).when(F.upper("platform") == "YOUTUBE", 0).otherwise(1)
    length = F.when(tier == 0, 0).otherwise(-F.length(F.coalesce(text, F.lit(""))))
    return F.min_by(F.struct(text.alias("text")), F.struct(tier, length, "published_at", "id")).getField("text")


def describe_clusters(clustered: DataFrame) -> DataFrame:
    """One row per cluster. ``cluster_id`` is the id of its first publication."""
    linked = F.col("video_id").isNotNull()
    return clustered.groupBy("norm_title", "opened_at").agg(
        F.min_by("id", _place()).alias("cluster_id"),
        F.count("*").alias("items"),
        F.min_by(F.when(linked, F.col("video_id")), F.when(linked, _place())).alias("existing_video_id"),
        F.coalesce(_best_text("title"), F.lit(UNTITLED)).alias("title"),
        F.coalesce(_best_text("description"), F.lit("")).alias("description"),
        F.min("published_at").alias("published_at"),
    )


@dataclass(frozen=True)
class Reconciliation:
    """Everything a run produces; nothing is written by the operator."""

    assignments: DataFrame  # id, cluster_id, old_video_id, new_video_id
    new_videos: DataFrame   # id, title, description, published_at, is_locked
    clusters: DataFrame

    def linked(self) -> DataFrame:
        """The sources whose link changes."""
        return self.assignments.filter(~F.col("old_video_id").eqNullSafe(F.col("new_video_id")))

    def report(self, applied_overrides: int = 0) -> DataFrame:
        """A13."""
        zero = F.lit(0)
        facts = self.clusters.select(
            F.lit(1).alias("clusters"), F.col("existing_video_id").isNull().cast("int").alias("created"), zero.alias("linked")
        ).unionByName(self.linked().select(zero.alias("clusters"), zero.alias("created"), F.lit(1).alias("linked")))
        return facts.agg(
            F.coalesce(F.sum("clusters"), zero).alias("clusters"),
            F.coalesce(F.sum("created"), zero).alias("created_videos"),
            F.coalesce(F.sum("linked"), zero).alias("linked_sources"),
            F.lit(applied_overrides).cast("long").alias("applied_overrides"),
        )

    def updated_sources(self, sv: DataFrame) -> DataFrame:
        """The source table after the run."""
        moved = self.assignments.select("id", "new_video_id")
        return (
            sv.join(moved, "id", "left")
            .withColumn("video_id", F.coalesce("new_video_id", "video_id")).select(*sv.columns)
        )


def reconcile(
    sv: DataFrame, v: DataFrame, *, hours: int = 48, start=None, end=None,
    cluster_blank_titles: bool = True,
) -> Reconciliation:
    """Q7: clusters, canonical records for those without a video, and links."""
    clustered = cluster_sources(
        candidates(sv, v, start=start, end=end), hours=hours, cluster_blank_titles=cluster_blank_titles, keep=True
    )
    clusters = describe_clusters(clustered)
    top = v.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = numbered(clusters.filter(F.col("existing_video_id").isNull()), "cluster_id", int(top), "new_id")
    videos = clusters.join(fresh.select("cluster_id", "new_id"), "cluster_id", "left").withColumn(
        "video", F.coalesce("existing_video_id", "new_id")
    )
    assignments = clustered.select("id", "norm_title", "opened_at", F.col("video_id").alias("old_video_id")).join(
        videos.select("norm_title", "opened_at", "cluster_id", F.col("video").alias("new_video_id")),
        ["norm_title", "opened_at"],
    ).select("id", "cluster_id", "old_video_id", "new_video_id")
    new_videos = fresh.select(
        F.col("new_id").alias("id"), "title", "description", "published_at", F.lit(0).alias("is_locked")
    )
    return Reconciliation(assignments, new_videos, clusters)


def dry_run_report(sv: DataFrame, v: DataFrame, *, hours: int = 48) -> DataFrame:
    """The number of clusters. Pending overrides are not consumed by a dry run."""
    return describe_clusters(cluster_sources(candidates(sv, v), hours=hours)).agg(
        F.count("*").alias("clusters")
    )


def classify_overrides(overrides: DataFrame) -> DataFrame:
    action = F.upper(F.coalesce("action", F.lit("")))
    valid = ((action == "LINK") & F.col("target_video_id").isNotNull()) | (action == "UNLINK")
    return overrides.withColumns({"action": action, "valid": F.coalesce(valid, F.lit(False))})


def apply_overrides(sv: DataFrame, overrides: DataFrame) -> DataFrame:
    """Sources after all pending overrides, taken in id order; invalid ones have no effect."""
    last = (
        classify_overrides(overrides).filter("valid").groupBy("source_video_id")
        .agg(F.max_by(F.struct("action", "target_video_id"), F.col("id")).alias("_o"))
        .select(F.col("source_video_id").alias("id"), "_o")
    )
    link = F.when(F.col("_o").isNull(), F.col("video_id")).when(
        F.col("_o.action") == "LINK", F.col("_o.target_video_id")
    )
    return sv.join(last, "id", "left").withColumn("video_id", link).select(*sv.columns)


def override_report(overrides: DataFrame) -> DataFrame:
    return classify_overrides(overrides).agg(
        F.count_if(F.col("valid")).alias("applied"), F.count_if(~F.col("valid")).alias("invalid")
    )


def register_overrides(requests: DataFrame, sv: DataFrame) -> DataFrame:
    """Every request with its outcome: ``applied``, ``unknown`` or ``invalid``."""
    action = F.upper(F.coalesce("action", F.lit("")))
    well_formed = (
        (F.coalesce("source_platform", F.lit("")) != "") & (F.coalesce("source_platform_id", F.lit("")) != "")
        & ((action == "UNLINK") | ((action == "LINK") & F.col("target_video_id").isNotNull()))
    )
    known = sv.select(
        F.col("id").alias("source_video_id"), F.col("platform").alias("source_platform"),
        F.col("platform_video_id").alias("source_platform_id"),
    )
    outcome = F.when(~well_formed, "invalid").when(F.col("source_video_id").isNull(), "unknown").otherwise("applied")
    return requests.join(known, ["source_platform", "source_platform_id"], "left").select(
        "seq", "source_platform", "source_platform_id", F.when(outcome != "invalid", F.col("source_video_id")).alias("source_video_id"),
        action.alias("action"), "target_video_id", outcome.alias("outcome"),
    )


def overrides_to_append(registered: DataFrame, start_id: int) -> DataFrame:
    """The accepted requests as new override rows, numbered in request order."""
    return numbered(registered.filter(F.col("outcome") == "applied"), "seq", start_id, "id").select(
        "id", "source_video_id", "action", "target_video_id"
    )


def check_resolutions(resolutions: DataFrame, sv: DataFrame, v: DataFrame) -> DataFrame:
    """Resolutions with a ``problem``: unknown ids, keeping what is deleted, a source named twice. Only a
    resolution without a problem of its own deletes a video for the others."""
    videos = v.select(F.col("id").alias("_vid"))
    named = resolutions.groupBy("source_id").agg(F.count("*").alias("_named"))
    own = (
        F.when(F.col("_keep").isNull() | F.col("_delete").isNull(), "unknown video")
        .when(F.col("_source").isNull(), "unknown source").when(F.col("_named") > 1, "source named twice")
    )
    known = (
        resolutions
        .join(videos.withColumnRenamed("_vid", "_keep"), F.col("keep_id") == F.col("_keep"), "left")
        .join(videos.withColumnRenamed("_vid", "_delete"), F.col("delete_id") == F.col("_delete"), "left")
        .join(sv.select(F.col("id").alias("_source")), F.col("source_id") == F.col("_source"), "left")
        .join(named, "source_id", "left")
        .select("keep_id", "delete_id", "source_id", own.alias("_own"))
    )
    deleted = known.filter(F.col("_own").isNull()).select(F.col("delete_id").alias("_gone")).distinct()
    problem = F.coalesce("_own", F.when(F.col("_gone").isNotNull(), "kept video is deleted"))
    return known.join(deleted, F.col("keep_id") == F.col("_gone"), "left").select(
        "keep_id", "delete_id", "source_id", problem.alias("problem")
    )


def resolve_duplicates(sv: DataFrame, v: DataFrame, resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, videos) after the valid resolutions (keep_id, delete_id, source_id):
    the named source moves to the kept video, the other video goes, its other links become NULL."""
    valid = check_resolutions(resolutions, sv, v).filter(F.col("problem").isNull())
    moved = valid.select(F.col("source_id").alias("id"), F.col("keep_id").alias("_keep"))
    gone = valid.select(F.col("delete_id").alias("_gone")).distinct()
    sources = (
        sv.join(moved, "id", "left").join(gone, F.col("video_id") == F.col("_gone"), "left")
        .withColumn("video_id", F.coalesce("_keep", F.when(F.col("_gone").isNull(), F.col("video_id"))))
        .select(*sv.columns)
    )
    videos = v.join(gone, v["id"] == gone["_gone"], "left_anti")
    return sources, videos
