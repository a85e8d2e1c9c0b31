"""Removal of long repeats with a logarithmic family of sparse suffix arrays.

Anchors: every stretch of ``least`` bytes has an anchor, the place of its smallest scrambled 8-byte gram, which
depends on its bytes alone. Neighbouring suffixes that share an anchor form a run, and an array has one
entry per run: a name of the bytes from the run's first suffix to ``least`` bytes after its last one. Arrays
are ordered by name, which is all that finding equal stretches asks of an order.

Family: each batch of documents gets its array, which is merge-joined with the levels that exist; equal
entries are repeats as a whole, new ones go to a level of their own, and levels of equal size merge. A
name lives in one level, so a batch meets every earlier entry once.

Edges: runs that are not equal may still share a stretch. Then they share at least half of it on one side
of the anchor, which the family's entries are joined on; of those few runs the bytes are fetched, cut
into blocks of neighbouring suffixes, and a block goes on to its single suffixes only if the bytes that
they all share repeat while the bytes of all of them do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmetrics.llm.common import column, dropped, id_and_text, map_arrow, of_keys, saved, utf8
from vidmetrics.llm.names import GRAM, Names, sliding_minimum

#: Suffixes of a block; bytes whose runs are found together.
BLOCK, BYTES_AT_ONCE = 16, 4 << 20
#: Of names with more than this share of the rows there are at most its inverse.
HOT_SHARE = 1e-4
RUN = ("key", "s", "n", "o")
NAME = ("h1", "h2")


def runs_of(texts: list[bytes], least: int) -> dict[str, np.ndarray]:
    """Runs of all texts: text number, s (first suffix), n (suffixes), o (anchor - s), the name (h1, h2) of
    the run's bytes, and of the half stretch right (r) and left (l) of the anchor, 0 where no stretch has it."""
    buffer = b"".join(texts)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    names = Names(buffer)
    anchor = sliding_minimum(names.grams, least - GRAM + 1)
    first = np.arange(len(anchor))
    text = np.searchsorted(starts, first, side="right") - 1
    whole = first + least <= starts[text + 1]
    change = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
    s = np.flatnonzero(np.concatenate((np.ones(min(len(anchor), 1), bool), change)))
    e = np.append(s[1:], len(anchor)) - 1
    s, e = s[whole[s]], e[whole[s]]
    q, half = anchor[s], least // 2
    h1, h2 = names.of(s, e + least)
    right = q - e <= half  # some stretch has its anchor in the first half
    left = q - s > half
    r = np.where(right, names.of(q, np.where(right, q + least - half, q + GRAM))[0], 0)
    l = np.where(left, names.of(np.where(left, q - half, q), np.where(left, q, q + GRAM))[0], 0)
    return {"text": text[s], "s": s - starts[text[s]], "n": e - s + 1, "o": q - s, "h1": h1, "h2": h2, "r": r, "l": l}


class SuffixFamily:
    """Levels of suffix arrays. ``add`` takes the runs of a batch; ``repeated`` has the names of runs that
    occur more than once so far, ``entries`` one run of each name."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.arrays: list[DataFrame] = []

    def add(self, runs: DataFrame) -> None:
        entry = [*RUN, "r", "l"]
        array = runs.groupBy(*NAME).agg(F.count("*").alias("times"), F.min(F.struct(*entry)).alias("entry"))
        array = array.select(*NAME, "times", *[F.col(f"entry.{c}") for c in entry])
        if self.levels:
            known = self.entries().select(*NAME, F.lit(True).alias("known"))
            array = array.join(known, [*NAME], "left").withColumn("known", F.coalesce("known", F.lit(False)))
        else:
            array = array.withColumn("known", F.lit(False))
        array = saved(array.sortWithinPartitions(*NAME), "suffix-array")
        self.arrays.append(array)
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, saved(a.unionByName(b).repartition(*NAME).sortWithinPartitions(*NAME), "suffix-level")))
        self.levels.append((0, array.filter(~F.col("known")).select(*NAME, *entry)))

    def entries(self) -> DataFrame:
        out = self.levels[0][1]
        for _, level in self.levels[1:]:
            out = out.unionByName(level)
        return out

    def repeated(self) -> DataFrame:
        """(name, times: about how many runs have it) of the repeated names; the first of a batch's runs may miss."""
        parts = [a.filter("times > 1 or known").select(*NAME, "times") for a in self.arrays]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy(*NAME).agg(F.sum("times").alias("times"))


def _repeating(rows: DataFrame, *name: str) -> DataFrame:
    """The rows whose name at least two rows have."""
    return _named(rows, rows.groupBy(*name).agg(F.count("*").alias("times")).filter("times > 1"), *name)


def _named(rows: DataFrame, names: DataFrame, *name: str) -> DataFrame:
    """The rows whose name is one of ``names`` (name, times: rows that have it).

    A name may belong to a third of all rows. Names of more than a share of the rows are few, by that share, and sent to
    all tasks: their rows are known without a join, and go through it under keys of their own, so no task gets
    the rows of one such name.
    """
    names = saved(names.select(*name, "times"), "names")
    most = (names.agg(F.sum("times")).first()[0] or 0) * HOT_SHARE
    hot = names.filter(F.col("times") > most).select(*name, F.lit(True).alias("hot"))
    cold = names.filter(F.col("times") <= most).select(*name, F.xxhash64(*name).alias("at"), F.lit(True).alias("cold"))
    marked = rows.join(F.broadcast(hot), [*name], "left")
    marked = marked.withColumn("at", F.when(F.col("hot"), F.xxhash64(*rows.columns)).otherwise(F.xxhash64(*name)))
    return marked.join(cold, [*name, "at"], "left").filter("hot or cold").select(*rows.columns)


def _packed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, z): compressed bytes of each text under a key of its own."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield {c: column(batch, c) for c in ("key", "doc_id")} | {"z": [press.compress(t) for t in utf8(batch)]}

    return map_arrow(id_and_text(docs).withColumn("key", F.monotonically_increasing_id()), work, "key long, doc_id long, z binary")


def _unpacked(batch: pa.RecordBatch, open_: zstandard.ZstdDecompressor) -> list[bytes]:
    return [open_.decompress(z) for z in column(batch, "z").to_pylist()]


def _portions(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BYTES_AT_ONCE:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, texts[start:]


def _runs(packed: DataFrame, least: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            keys = column(batch, "key").to_numpy()
            for first, texts in _portions(_unpacked(batch, open_)):
                found = runs_of(texts, least)
                out = {"key": keys[first + found.pop("text")], **found}
                yield {c: x.astype(np.int32) if c in ("s", "n", "o") else x for c, x in out.items()}

    return map_arrow(
        packed.select("key", "z"), work, "key long, s int, n int, o int, h1 long, h2 int, r long, l long"
    )


def _run_bytes(packed: DataFrame, runs: DataFrame, least: int) -> DataFrame:
    """(key, s, n, o, z): the bytes of the given runs."""
    lists = runs.groupBy("key").agg(F.collect_list(F.struct("s", "n", "o")).alias("runs"))  # no more than the text has bytes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        open_, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in (*RUN, "z")}
            for key, text, found in zip(column(batch, "key").to_pylist(), _unpacked(batch, open_), column(batch, "runs").to_pylist()):
                for x in found:
                    part = text[x["s"]:x["s"] + x["n"] - 1 + least]
                    for c, v in zip(out, (key, x["s"], x["n"], x["o"], press.compress(part))):
                        out[c].append(v)
            yield out

    texts = of_keys(packed.select("key", "z"), lists.select("key"), "key", "left_semi")
    return map_arrow(texts.join(lists, "key"), work, "key long, s int, n int, o int, z binary")


def _laid_out(batch: pa.RecordBatch, open_: zstandard.ZstdDecompressor):
    """(names of the batch's bytes laid end to end, where each run begins, s, n, o, key)."""
    texts = _unpacked(batch, open_)
    base = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[:-1]
    s, n, o = (column(batch, c).to_numpy().astype(np.int64) for c in ("s", "n", "o"))
    return Names(b"".join(texts)), base, s, n, o, column(batch, "key").to_numpy()


def _blocks(run_bytes: DataFrame, least: int) -> DataFrame:
    """Blocks of the runs: those suffixes whose distance to the anchor is in one multiple of ``BLOCK``. Names
    of the bytes that all suffixes of a full block share (c1, c2) and of the bytes of all that are here
    (u1, u2); w and m: first suffix and number of suffixes."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            names, base, s, n, o, key = _laid_out(batch, open_)
            low, high = (o - n + 1) // BLOCK, o // BLOCK
            count = high - low + 1
            row = np.repeat(np.arange(len(s)), count)
            block = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]
            first = o[row] - np.minimum(o[row], block * BLOCK + BLOCK - 1)
            last = o[row] - np.maximum((o - n + 1)[row], block * BLOCK)
            core = base[row] + o[row] - block * BLOCK
            c1, c2 = names.of(core, core - BLOCK + 1 + least)
            u1, u2 = names.of(base[row] + first, base[row] + last + least)
            yield {
                "key": key[row], "s": s[row].astype(np.int32), "w": (s[row] + first).astype(np.int32),
                "m": (last - first + 1).astype(np.int32), "c1": c1, "c2": c2, "u1": u1, "u2": u2,
            }

    return map_arrow(run_bytes, work, "key long, s int, w int, m int, c1 long, c2 int, u1 long, u2 int")


def _single(run_bytes: DataFrame, blocks: DataFrame, least: int) -> DataFrame:
    """(key, w, h1, h2): the suffixes of the given blocks by the name of their first bytes."""
    lists = blocks.groupBy("key", "s").agg(F.collect_list(F.struct("w", "m")).alias("blocks"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            names, base, s, _, _, key = _laid_out(batch, open_)
            row, w = [], []
            for i, found in enumerate(column(batch, "blocks").to_pylist()):
                for x in found:
                    row += [i] * x["m"]
                    w += range(x["w"], x["w"] + x["m"])
            row, w = np.array(row, np.int64), np.array(w, np.int64)
            at = base[row] + w - s[row]
            h1, h2 = names.of(at, at + least)
            yield {"key": key[row], "w": w.astype(np.int32), "h1": h1, "h2": h2}

    return map_arrow(run_bytes.join(lists, ["key", "s"]), work, "key long, w int, h1 long, h2 int")


def repeats(docs: DataFrame, *, least: int = 400, batches: int = 3) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>>, kept), one row per document row.

    spans: maximal runs of bytes that are covered by a string of ``least`` bytes which also starts
    elsewhere, in any document or the same one; strings do not cross documents. kept: the other bytes, in
    order. Null is the empty text. Equal names of 96 bits count as equal strings.
    """
    if least < 2 * (GRAM + BLOCK):
        raise ValueError(f"strings of at least {2 * (GRAM + BLOCK)} bytes are needed")
    packed = saved(_packed(docs), "packed-texts")
    runs = saved(_runs(packed, least), "runs")
    family = SuffixFamily()
    for b in range(batches):
        family.add(runs.filter(F.pmod(F.xxhash64("key"), F.lit(batches)) == b))
    stretch = F.col("n") - 1 + least
    spans = [_named(runs, family.repeated(), *NAME).select("key", F.col("s").alias("a"), (F.col("s") + stretch).alias("b"))]
    spans[0] = saved(spans[0], "whole-runs")
    dropped(runs)

    halves = family.entries().select(*RUN, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("r").alias("name")), F.struct(F.lit(1).alias("side"), F.col("l").alias("name")),
    )).alias("half")).filter("half.name <> 0").select(*RUN, "half.side", "half.name")
    edges = _repeating(halves, "side", "name").select(*RUN).distinct()
    edge_bytes = saved(_run_bytes(packed, saved(edges, "edge-runs"), least), "edge-bytes")
    dropped(*family.arrays, *[level for rank, level in family.levels if rank])
    blocks = saved(_repeating(_blocks(edge_bytes, least), "c1", "c2"), "blocks")
    full = saved(_repeating(blocks, "u1", "u2"), "full-blocks")
    spans.append(full.select("key", F.col("w").alias("a"), (F.col("w") + F.col("m") - 1 + least).alias("b")))
    # Single suffixes: of the blocks that do not repeat as a whole, and of one of each kind of block that
    # does and that shares bytes with such a block.
    core = ["c1", "c2"]
    open_ = blocks.join(full.select("key", "w"), ["key", "w"], "left_anti")
    partners = full.join(open_.select(*core).distinct(), core, "left_semi").groupBy("u1", "u2").agg(
        F.min(F.struct("key", "s", "w", "m")).alias("first")
    ).select("first.*")
    looked_at = open_.select("key", "s", "w", "m").unionByName(partners)
    singles = _repeating(saved(_single(edge_bytes, looked_at, least), "suffixes"), "h1", "h2")
    spans.append(singles.select("key", F.col("w").alias("a"), (F.col("w") + least).alias("b")))

    every = spans[0].unionByName(spans[1]).unionByName(spans[2])
    lists = saved(every.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("found")), "spans")
    keys = lists.select("key")
    hit = of_keys(packed, keys, "key", "left_semi").join(lists, "key")
    clean = of_keys(packed, keys, "key", "left_anti").withColumn("found", F.array().cast("array<struct<a: int, b: int>>"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            texts, out = _unpacked(batch, unpack), {"spans": [], "kept": []}
            for text, found in zip(texts, column(batch, "found").to_pylist()):
                merged: list[list[int]] = []
                for x in found:
                    if merged and x["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["b"])
                    else:
                        merged.append([x["a"], x["b"]])
                edges = [0, *(x for span in merged for x in span), len(text)]
                out["spans"].append([{"start": a, "end": b} for a, b in merged])
                out["kept"].append(b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])]) if merged else text)
            yield {"doc_id": column(batch, "doc_id"), "n_bytes": [len(t) for t in texts], **out}

    found = hit.select("doc_id", "z", "found").unionByName(clean.select("doc_id", "z", "found"))
    return map_arrow(found, work, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
