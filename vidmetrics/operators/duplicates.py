"""Closest pairs of publications that may be the same video."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vidmetrics.operators.enrich import ratio
from vidmetrics.operators.spread import first_rows
from vidmetrics.session import ensure_checkpoint_dir

_FIRST_RADII = (0, 60, 900, 3600, 6 * 3600)


def _narrow(sv: DataFrame) -> DataFrame:
    return sv.filter(F.col("published_at").isNotNull()).select(
        "id", "video_id", F.unix_seconds("published_at").alias("at"), "duration_seconds",
    )


def _interchangeable_cut(rows: DataFrame, limit: int) -> DataFrame:
    """Drops rows that cannot be part of the ``limit`` first pairs in (distance, id, id) order.

    Rows with the same second, length and video meet exactly the same partners at the same distance,
    so each row is beaten by the lower ids of its class: ``limit + 1`` of them are enough (one of
    them may be the partner). With the video left open, at most ``limit + 1`` remaining rows share
    the partner's video, so twice as many per (second, length) are enough. Copies and hot instants
    shrink to a constant before anything is joined; the answer stays exact.
    """
    by_id = [F.col("id").asc()]
    linked = rows.filter(F.col("video_id").isNotNull())
    free = rows.filter(F.col("video_id").isNull())
    kept = first_rows(linked, ["at", "duration_seconds", "video_id"], by_id, limit + 1)
    return first_rows(kept.unionByName(free), ["at", "duration_seconds"], by_id, 2 * (limit + 1))


def _length_cells(rows: DataFrame, tol_s: int) -> DataFrame:
    """Rows with a ``length_cell`` inside which any two lengths match; unknown lengths are one cell."""
    if tol_s == 0:  # no two known lengths differ by less than nothing
        rows = rows.filter(F.col("duration_seconds").isNull())
    return rows.withColumn("length_cell", F.floor(F.col("duration_seconds") / F.lit(max(1, tol_s))))


def _radius(rows: DataFrame, window_s: int, tol_s: int, limit: int) -> int:
    """The smallest radius proven to hold ``limit`` pairs.

    Two rows of one (time cell, length cell) are closer than the cell is wide in both directions, so
    the pairs of different videos inside cells are a lower bound of the pairs within the radius. They
    are counted from cell sizes; no pair is built.
    """
    radii = [r for r in _FIRST_RADII if r < window_s]
    cells = _length_cells(rows, tol_s).select(
        "video_id", "length_cell",
        F.explode(F.array(*[
            F.struct(F.lit(r).alias("radius"), F.floor(F.col("at") / (r + 1)).alias("time_cell")) for r in radii
        ])).alias("c"),
    )
    pairs = F.col("n") * (F.col("n") - 1) / 2
    same_video = F.when(F.col("video_id").isNotNull(), pairs).otherwise(0.0)
    counted = (
        cells.groupBy("c.radius", "c.time_cell", "length_cell", "video_id").agg(F.count("*").alias("n"))
        .withColumn("same", same_video)
        .groupBy("radius", "time_cell", "length_cell").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
        .groupBy("radius").agg(F.sum(pairs - F.col("same")).alias("pairs"))
    )
    enough = counted.filter(F.col("pairs") >= limit).agg(F.min("radius")).first()[0]
    return window_s if enough is None else int(enough)


def _first_id_bound(rows: DataFrame, tol_s: int, limit: int) -> int | None:
    """For pairs of equal instants: a first id that the ``limit``-th pair cannot exceed.

    Neighbours by id inside one (second, length cell) are pairs of their own; the ``limit``-th of
    them, in id order, bounds the true one. It keeps a hot instant from meeting itself as a whole.
    """
    cell = Window.partitionBy("at", "length_cell").orderBy("id")
    last = (
        _length_cells(rows, tol_s)
        .withColumns({"next_id": F.lead("id").over(cell), "next_video": F.lead("video_id").over(cell)})
        .filter(
            F.col("next_id").isNotNull()
            & F.coalesce(F.col("video_id") != F.col("next_video"), F.lit(True))
        )
        .select("id", "next_id").orderBy("id", "next_id").offset(limit - 1).limit(1).first()
    )
    return None if last is None else int(last[0])


def candidate_pairs(
    rows: DataFrame, radius_s: int, tol_s: int, *, first_id_up_to: int | None = None
) -> DataFrame:
    """|time difference| <= radius and |length difference| < tolerance (unknown length passes),
    different or missing video, ``s1_id < s2_id``.

    An equi-join on (time cell, length cell): one side visits its neighbour cells, so only rows
    close in both directions meet. Rows of unknown length meet all others on the time cell alone.
    """
    base = rows.withColumn("tc", F.floor(F.col("at") / max(1, radius_s)))
    known = base.filter(F.col("duration_seconds").isNotNull()).withColumn(
        "lc", F.floor(F.col("duration_seconds") / max(1, tol_s)).cast("long")
    )
    unknown = base.filter(F.col("duration_seconds").isNull())
    columns = ("id", "video_id", "at", "duration_seconds")
    around_time = (-1, 0, 1) if radius_s else (0,)

    def meet(first: DataFrame, second: DataFrame, **cells: tuple[int, ...]) -> DataFrame:
        if first_id_up_to is not None:
            first = first.filter(F.col("id") <= first_id_up_to)
        left = first.select(*[F.col(c).alias(f"a_{c}") for c in columns], *cells)
        right = second.select(*[F.col(c).alias(f"b_{c}") for c in columns], *cells)
        for cell, steps in cells.items():
            right = right.withColumn(cell, F.explode(F.array(*[F.col(cell) + s for s in steps])))
        return left.join(right, list(cells)).filter(F.col("a_id") < F.col("b_id")).drop(*cells)

    pairs = meet(unknown, unknown, tc=around_time)
    for first, second in ((known, unknown), (unknown, known)):
        pairs = pairs.unionByName(meet(first, second, tc=around_time))
    if tol_s:
        pairs = pairs.unionByName(meet(known, known, tc=around_time, lc=(-1, 0, 1)))
    distance = F.abs(F.col("a_at") - F.col("b_at"))
    alike = (
        F.col("a_duration_seconds").isNull() | F.col("b_duration_seconds").isNull()
        | (F.abs(F.col("a_duration_seconds") - F.col("b_duration_seconds")) < tol_s)
    )
    other = (
        F.col("a_video_id").isNull() | F.col("b_video_id").isNull()
        | (F.col("a_video_id") != F.col("b_video_id"))
    )
    return pairs.filter((distance <= radius_s) & alike & other).select(
        F.col("a_id").alias("s1_id"), F.col("b_id").alias("s2_id"), distance.alias("delta_s")
    )


def duplicate_report(
    sv: DataFrame, *, window_h: int = 48, tol_s: int = 60, limit: int = 200, offset: int = 0,
    show: Sequence[str] = ("video_id", "title", "published_at", "duration_seconds"),
) -> DataFrame:
    """The closest pairs, by distance and ids. Descriptive columns join the page only."""
    limit, offset = max(1, limit), max(0, offset)
    wanted = limit + offset
    window_s = max(1, window_h) * 3600
    # Read by the two proofs and by both sides of every join: written once to the shared folder.
    ensure_checkpoint_dir(sv.sparkSession)
    rows = _interchangeable_cut(_narrow(sv), wanted).checkpoint()
    tol_s = max(0, tol_s)
    radius = _radius(rows, window_s, tol_s, wanted)
    bound = _first_id_bound(rows, tol_s, wanted) if radius == 0 else None
    page = (
        candidate_pairs(rows, radius, tol_s, first_id_up_to=bound)
        .orderBy("delta_s", "s1_id", "s2_id").offset(offset).limit(limit)
    )
    for side in ("s1", "s2"):
        shown = sv.select(F.col("id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in show])
        page = page.join(shown, f"{side}_id")
    return page.withColumn("delta_h", ratio(F.col("delta_s"), F.lit(3600))).drop("delta_s")
