"""Compression of vectors to codes of four parts, with codebooks from k-means under adaptive bounds.

A vector is cut into equal parts; each part position has a codebook that Lloyd's rounds refine. A part keeps, from
round to round, its entry, the b next closest entries with a lower bound on the distance to each in rising order,
and one outer bound on the distance to all others. When the entries have moved, the bounds are lowered by the
moves. A part whose exact distance to its entry lies below all bounds stays. Else its b entries are measured, and only
if the outer bound does not clear the nearest of them all entries are. b is adapted to how deep the lists were read
and how often they did not suffice. Bounds are floats rounded to the safe side; every decision that they leave open
falls on squared distances in whole numbers, so ties are exact.

Parts and bounds live in a table of the shared folder that each round reads and writes anew; rows are never
shuffled, only sums per entry are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmetrics.llm.common import column, dropped, map_arrow, saved
from vidmetrics.llm.vectors import binary_rows, from_binary_rows, integer_vectors, matrix

#: Components are held within this, so that squared distances of parts of up to 512 components fit a long.
LIMIT = 1 << 25
#: Lengths of the lists of close entries: at first, at least, at most.
FIRST, LEAST, MOST = 8, 2, 24
#: Share of parts measured against all entries above which lists grow, below which they may shrink.
OFTEN, SELDOM = 0.1, 0.02
#: Of labels with more than this share of the rows there are at most its inverse.
HOT_SHARE = 0.001
#: Relative slack of float bounds: far above the rounding of a square root or a sum of two numbers.
SLACK = 1e-6


def part_edges(size: int, parts: int) -> list[int]:
    """Where each part begins and the last one ends; parts differ by at most one component."""
    return [0, *np.cumsum([size // parts + (i < size % parts) for i in range(parts)]).tolist()]


def _exact(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, in whole numbers."""
    reach = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * reach * reach * max(x.shape[1], 1) < 1 << 53:  # doubles are exact here
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return (x * x).sum(1)[:, None] + (entries * entries).sum(1) - 2 * np.einsum("ij,kj->ik", x, entries)


def _to_entries(x: np.ndarray, entries: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Squared distances of each row to its own chosen entries (rows x lists)."""
    out = np.empty(chosen.shape, np.int64)
    for j in range(chosen.shape[1]):
        gap = x - entries[chosen[:, j]]
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


@dataclass
class Bounds:
    """Of the parts of one position: entry, close entries, their lower bounds (rising), the outer bound."""

    entry: np.ndarray
    near: np.ndarray
    low: np.ndarray
    outer: np.ndarray


def _below(d: np.ndarray) -> np.ndarray:
    """Distances from squared ones as floats that are not above them."""
    return (np.sqrt(d.astype(float)) * (1 - SLACK)).astype(np.float32)


def measured(x: np.ndarray, entries: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
    """Bounds from the distances to all entries, and the squared distance to the nearest (ties: lower index)."""
    k = len(entries)
    d = _exact(x, entries)
    entry = d.argmin(1)
    rows = np.arange(len(x))
    best = d[rows, entry]
    d[rows, entry] = np.iinfo(np.int64).max
    b = min(b, k - 1)
    if b < k - 1:
        near = np.argpartition(d, b, axis=1)[:, :b + 1]
        order = np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        outer = _below(np.take_along_axis(d, near[:, b:], 1))[:, 0]
        near = near[:, :b]
    else:
        near = np.argsort(d, axis=1, kind="stable")[:, :b]
        outer = np.full(len(x), np.inf, np.float32)
    return Bounds(entry.astype(np.uint8), near.astype(np.uint8), _below(np.take_along_axis(d, near, 1)), outer), best


def updated(x: np.ndarray, entries: np.ndarray, moves: np.ndarray, old: Bounds, b: int) -> tuple[Bounds, np.ndarray, np.ndarray, np.ndarray]:
    """Bounds and squared distance to the nearest entry after the entries moved by ``moves`` (not below the
    moves), and per part how many of its list were in doubt and whether it was measured against all entries."""
    low = old.low.astype(float) - moves[old.near] if old.near.shape[1] else old.low.astype(float)
    outer = old.outer.astype(float) - moves.max(initial=0)
    low, outer = (v - np.minimum(np.abs(v), 1e30) * SLACK for v in (low, outer))  # none at all is infinite
    entry, near = old.entry.copy(), old.near.copy()
    best = _to_entries(x, entries, entry[:, None].astype(np.int64))[:, 0]
    upper = np.sqrt(best.astype(float)) * (1 + SLACK)
    doubt = (low <= upper[:, None]).sum(1)
    open_ = np.flatnonzero((doubt > 0) | (outer <= upper))
    full = np.zeros(len(x), bool)
    if len(open_):
        # The entry and its list, measured in whole numbers.
        chosen = np.concatenate([entry[open_, None], near[open_]], axis=1).astype(np.int64)
        d = _to_entries(x[open_], entries, chosen)
        order = np.lexsort((chosen, d), axis=1)
        chosen, d = np.take_along_axis(chosen, order, 1), np.take_along_axis(d, order, 1)
        entry[open_], near[open_], best[open_] = chosen[:, 0], chosen[:, 1:], d[:, 0]
        low[open_] = np.where(chosen[:, 1:] == chosen[:, :1], np.inf, _below(d[:, 1:]))  # an empty place stays out of reach
        full[open_] = outer[open_] <= np.sqrt(d[:, 0].astype(float)) * (1 + SLACK)
    # Lists stay in rising order of their bounds: the lists that were not measured moved apart.
    order = np.argsort(low, axis=1, kind="stable")
    near, low = np.take_along_axis(near, order, 1), np.take_along_axis(low, order, 1)
    width = min(b, len(entries) - 1)
    if low.shape[1] > width:  # what leaves the list counts for the outer bound
        outer = np.minimum(outer, low[:, width])
        near, low = near[:, :width], low[:, :width]
    elif low.shape[1] < width:  # a place without an entry names the part's own one, out of reach
        more = width - low.shape[1]
        near = np.concatenate([near, np.repeat(entry[:, None], more, 1)], axis=1)
        low = np.concatenate([low, np.full((len(x), more), np.inf)], axis=1)
    at = np.flatnonzero(full)
    low, outer = low.astype(np.float32), outer.astype(np.float32)
    if len(at):
        new, best[at] = measured(x[at], entries, width)
        entry[at], near[at], low[at], outer[at] = new.entry, new.near, new.low, new.outer
    return Bounds(entry, near, low, outer), best, doubt, full


class _Table:
    """The table of a round: vec_id, label, x, and the bounds of all parts as binary columns."""

    SCHEMA = "vec_id long, label string, x binary, entry binary, near binary, low binary, far binary, error long"

    def __init__(self, edges: list[int], b: int):
        self.edges, self.b = edges, b
        self.parts = len(edges) - 1

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, list[Bounds]]:
        x = from_binary_rows(batch, "x", "<i4", self.edges[-1]).astype(np.int64)
        p, b = self.parts, self.b
        entry, near = from_binary_rows(batch, "entry", "u1", p), from_binary_rows(batch, "near", "u1", p * b)
        low, far = from_binary_rows(batch, "low", "<f4", p * b), from_binary_rows(batch, "far", "<f4", p)
        return x, [Bounds(entry[:, i], near[:, i * b:i * b + b], low[:, i * b:i * b + b], far[:, i]) for i in range(p)]

    @staticmethod
    def columns(bounds: list[Bounds], best: list[np.ndarray]) -> dict:
        return {
            "entry": binary_rows(np.stack([k.entry for k in bounds], 1)), "near": binary_rows(np.concatenate([k.near for k in bounds], 1)),
            "low": binary_rows(np.concatenate([k.low for k in bounds], 1)), "far": binary_rows(np.stack([k.outer for k in bounds], 1)),
            "error": sum(best),
        }


def _first_table(vectors: DataFrame, books: list[np.ndarray], edges: list[int], b: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x = matrix(batch, "x", edges[-1])
            found = [measured(x[:, s:e], book, b) for s, e, book in zip(edges, edges[1:], books)]
            yield {c: column(batch, c) for c in ("vec_id", "label")} | {"x": binary_rows(x.astype("<i4"))} | _Table.columns(*map(list, zip(*found)))

    return map_arrow(vectors, work, _Table.SCHEMA)


def _next_table(table: DataFrame, was: _Table, books: list[np.ndarray], moves: list[np.ndarray], b: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x, old = was.read(batch)
            found = [updated(x[:, s:e], book, move, k, b) for s, e, book, move, k in zip(was.edges, was.edges[1:], books, moves, old)]
            yield {
                **{c: column(batch, c) for c in ("vec_id", "label", "x")}, **_Table.columns([f[0] for f in found], [f[1] for f in found]),
                "depth": sum(np.minimum(f[2], MOST) for f in found), "full": sum(f[3].astype(np.int64) for f in found),
            }

    return map_arrow(table, work, f"{_Table.SCHEMA}, depth long, full long")


def _means(table: DataFrame, edges: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) per part, entry and place: summed by task, then by Spark."""
    parts, size = len(edges) - 1, edges[-1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts, sums = np.zeros((parts, k), np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            x, entry = from_binary_rows(batch, "x", "<i4", size).astype(np.int64), from_binary_rows(batch, "entry", "u1", parts)
            for p, (s, e) in enumerate(zip(edges, edges[1:])):
                counts[p] += np.bincount(entry[:, p], minlength=k)
                order = np.argsort(entry[:, p], kind="stable")
                found, first = np.unique(entry[order, p], return_index=True)
                if e > s and len(found):
                    sums[found, s:e] += np.add.reduceat(x[order, s:e], first, axis=0)
        total = np.concatenate([counts.ravel(), sums.ravel()])
        at = np.flatnonzero(total)
        yield {"i": at, "y": total[at]}

    flat = np.zeros(parts * k + k * size, np.int64)
    for r in map_arrow(table.select("x", "entry"), work, "i long, y long").groupBy("i").agg(F.sum("y").alias("y")).collect():
        flat[r["i"]] = r["y"]
    return flat[:parts * k].reshape(parts, k), flat[parts * k:].reshape(k, size)


def adapted(b: int, depth: float, full: float) -> int:
    """The length of the lists for the next round, from the mean number of list entries in doubt and the share of
    parts that were measured against all entries."""
    if full > OFTEN:
        return min(2 * b, MOST)
    if full < SELDOM and depth < b / 4:
        return max(b // 2, LEAST)
    return b


@dataclass
class Codes:
    """Vectors in codes: ``table`` has vec_id, label, entry (an index per part, as bytes) and error."""

    books: list[np.ndarray]
    table: DataFrame
    lists: list[int]
    measured: list[float]

    @property
    def sha256(self) -> str:
        return sha256(",".join(str(v) for book in self.books for v in book.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, size: int, *, entries: int = 256, parts: int = 4, rounds: int = 4, b: int = FIRST) -> Codes | None:
    """Codebooks of ``vectors`` (vec_id, label, x array<long> of ``size``) and the parts' entries.

    Codebooks begin as the parts of the rows of the smallest vec_ids (equal ids: smaller x first; null last), in that
    order. Each round assigns every part to the nearest entry (ties: lower index) and replaces each entry that has
    parts by their floored mean. Finally parts are assigned again. None without vectors.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index is a byte: 1 to 256 entries")
    start = vectors.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()
    if not start:
        return None
    edges = part_edges(size, parts)
    whole = np.array([r["x"] for r in start], np.int64)
    k = len(whole)
    books = [whole[:, s:e] for s, e in zip(edges, edges[1:])]
    b = min(b, k - 1)
    shape, table = _Table(edges, b), saved(_first_table(vectors, books, edges, b), "vector-codes")
    lists, shares = [b], [1.0]
    for _ in range(rounds):
        counts, sums = _means(table, edges, k)
        new = []
        for p, (s, e) in enumerate(zip(edges, edges[1:])):
            used = counts[p][:, None]
            new.append(np.where(used > 0, sums[:, s:e] // np.maximum(used, 1), books[p]))
        moves = [np.sqrt(((n - o) ** 2).sum(1).astype(float)) * (1 + SLACK) for n, o in zip(new, books)]
        books, before = new, table
        b = min(b, k - 1)
        table = saved(_next_table(before, shape, books, moves, b), "vector-codes")
        dropped(before)
        shape = _Table(edges, b)
        told = table.agg(F.avg("depth"), F.avg("full")).first()
        lists.append(b)
        shares.append(told[1] / parts)
        b = adapted(b, told[0] / parts, told[1] / parts)
    return Codes(books, table, lists, shares)


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` (label, error, ...) with label_error, the sum of error over equal labels, nulls together.

    Labels with over a thousandth of the rows are at most a thousand and are broadcast; the rest meet their sums in a
    shuffle in which no label has more rows than that.
    """
    # All nulls are one group: the label that a join can compare has a flag beside it.
    rows = rows.withColumn("no_label", F.col("label").isNull()).withColumn("label", F.coalesce("label", F.lit("")))
    sums = saved(rows.groupBy("no_label", "label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "label-errors")
    many = sums.agg(F.sum("rows")).first()[0] or 0
    key, hot = ["no_label", "label"], sums.filter(F.col("rows") > many * HOT_SHARE).drop("rows")
    cold = sums.filter(F.col("rows") <= many * HOT_SHARE).drop("rows")
    out = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key)
    return out.unionByName(rest).withColumn("label", F.when(~F.col("no_label"), F.col("label"))).drop("no_label")


def vector_codes(embeddings: DataFrame, *, entries: int = 256, parts: int = 4, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each row of ``embeddings`` (vec_id, embedding, label).

    Components become floor(scale * component), held within +-2^25. code: the parts' entries, two hex digits each;
    error: squared distances of the parts to them; label_error: error summed over equal labels, nulls together;
    codebooks_sha256: of all entries' components by part, entry and place, comma-joined.

    Dropped: null and empty vectors, vectors with null or non-finite components, and vectors of another dimension than most.
    Fewer rows than entries: as many entries as rows. A dimension that parts do not divide gives the first parts one
    component more. Repeated rows and null ids are kept; a table without vectors gives no rows. Other columns are ignored.
    """
    vectors, size = integer_vectors(embeddings, scale=scale, limit=LIMIT, vec_id="long", label="string")
    codes = compress(vectors, size, entries=entries, parts=parts, rounds=rounds) if size else None
    if codes is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows = codes.table.select("vec_id", "label", F.lower(F.hex("entry")).alias("code"), "error")
    return with_label_error(rows).select("vec_id", "code", "error", "label_error", F.lit(codes.sha256).alias("codebooks_sha256"))
