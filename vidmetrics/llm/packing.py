"""Best-fit packing of tokenised documents by exact complements.

The packing is decided on the histogram of piece lengths, which has no more entries than a sequence
has tokens. A sequence is opened with the longest piece left; its gap is looked up among the single
lengths, the sums of two and the sums of three that are still available, and a combination that fills
it exactly is consumed as often as the counts allow. What no combination fills goes to best fit,
longest first. The outcome is a short list of recipes (lengths of a sequence, how many such
sequences); Spark numbers the pieces of each length and reads place and sequence off the recipes.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vidmetrics.llm.common import column, id_and_text, map_arrow, saved, utf8

CAPACITY = 2048
END_ID = 0
#: Words whose ids a task remembers before it starts over.
REMEMBERED_WORDS = 400_000
#: Pieces of one length that are numbered together, roughly.
ROWS_PER_GROUP = 4096


# --- fixed value: how the vocabulary splits a lower-case word -----------------
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# ------------------------------------------------------------------------------
#: Characters that are composed already and whose lower case stands alone.
PLAIN = re.compile(r"[!-~\xa1-\u012f]+")


class WordIds:
    """Little-endian ids of a text, looked up by word.

    The vocabulary drops white space before its merges, so what stands between ASCII white space has ids
    of its own. A new word of plain characters is lowered and split here and only its parts go through the
    merges; every other word goes through the whole tokenizer.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer, pre_tokenizers

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are written as native unsigned 32-bit integers, little end first")
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.merge = self.tokenizer.model.tokenize
        self.written = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.split = regex.compile(SPLIT).findall
        self.known = _Made(self._word)
        self.parts = _Made(self._part)

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() else self.written(part)[0][0]
        return array("I", [t.id for t in self.merge(letters)]).tobytes()

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode()
        if not PLAIN.fullmatch(word) or "<|" in word:
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        word = word.lower()
        return self.parts[word] if word.isalpha() else b"".join([self.parts[p] for p in self.split(word)])

    def of(self, text: bytes) -> bytes:
        for memory in (self.known, self.parts):
            if len(memory) > REMEMBERED_WORDS:
                memory.clear()
        known = self.known
        return b"".join([known[w] for w in text.split()])


class _Made(dict):
    """Values that are made when they are first asked for."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


def pieces(docs: DataFrame, tokenizer_file: str, *, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each text and an end id, cut at ``capacity``."""
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the size of a vocabulary file

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = WordIds(shared.value)
        end = np.array([END_ID], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), utf8(batch)):
                data = ids.of(text) + end
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at:at + step]
                    for c, x in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        out[c].append(x)
            yield out

    return map_arrow(id_and_text(docs), work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Recipes (lengths, times) that use up ``counts`` (index: length, up to the capacity)."""
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    recipes: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> bool:
        sizes, need = np.unique(lengths, return_counts=True)
        times = int((left[sizes] // need).min())
        if times:
            left[sizes] -= need * times
            recipes.append((lengths, times))
        return times > 0

    def pair(gap: int, most: int) -> tuple[int, int] | None:
        """The two available lengths of this sum, the longer one as long as can be."""
        if gap < 2:
            return None
        have = left[: gap + 1] > 0
        both = have[1:gap] & have[gap - 1:0:-1]
        ys = np.flatnonzero(both[(gap + 1) // 2 - 1:]) + (gap + 1) // 2
        for y in ys[::-1].tolist():
            if y <= most and (2 * y != gap or left[y] > 1):
                return y, gap - y
        return None

    def filler(a: int) -> tuple[int, ...] | None:
        """What fills the gap beside one piece of length a (already taken out of ``left``)."""
        gap = capacity - a
        if gap == 0:
            return ()
        if left[gap] > 0:
            return (gap,)
        if found := pair(gap, a):
            return found
        for x in np.flatnonzero(left[: min(a, gap - 2) + 1] > 0)[::-1].tolist() if gap > 2 else ():
            if 3 * x < gap:
                break  # x is the longest of the three
            left[x] -= 1
            found = pair(gap - x, x)
            left[x] += 1
            if found:
                return x, *found
        return None

    rest = np.zeros_like(left)
    for a in range(capacity, 0, -1):
        while left[a]:
            left[a] -= 1
            fill = filler(a)
            left[a] += 1
            if fill is None or not take((a, *fill)):
                rest[a], left[a] = left[a], 0
    return recipes + best_fit(rest)


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: equal sequences are kept as one entry with a number."""
    capacity = len(counts) - 1
    open_: dict[int, list[list]] = {}  # gap -> [lengths, times]
    for a in range(capacity, 0, -1):
        n = int(counts[a])
        while n:
            gap = min((g for g in open_ if g >= a), default=None)
            lengths, times = open_[gap].pop() if gap is not None else ((), n)
            if gap is not None and not open_[gap]:
                del open_[gap]
            gap = capacity if gap is None else gap
            each = min(gap // a, n)
            filled = min(times, n // each)
            open_.setdefault(gap - each * a, []).append([(*lengths, *[a] * each), filled])
            if lengths and times > filled:
                open_.setdefault(gap, []).append([lengths, times - filled])
            n -= filled * each
    return [(tuple(lengths), times) for g in sorted(open_) for lengths, times in open_[g]]


def places(recipes: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: rows sorted by (length, first rank)."""
    rows, used, base = [], {}, 0
    for lengths, times in recipes:
        at = 0
        sizes, need = np.unique(lengths, return_counts=True)
        for size, k in sorted(zip(sizes.tolist(), need.tolist()), reverse=True):
            rows.append((size, used.get(size, 0), base, k, at))
            used[size] = used.get(size, 0) + k * times
            at += size * k
        base += times
    rows.sort()
    names = ("length", "rank", "sequence", "copies", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T))


def pack(docs: DataFrame, tokenizer_file: str, *, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with their sequence_id and offset, as few sequences as the plan finds.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur. No rows
    give no rows. The driver sees counts by length: ``capacity`` numbers.
    """
    cut = saved(pieces(docs, tokenizer_file, capacity=capacity), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    groups = 1 + int(counts.sum()) // ROWS_PER_GROUP
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    before = salted.groupBy("length", "salt").count().select(
        "length", "salt",
        (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"),
    )
    numbered = salted.withColumn(
        "number", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    )
    ranked = numbered.join(before, ["length", "salt"]).select(*cut.columns, (F.col("number") + F.col("before")).alias("rank"))
    where = places(plan(counts))
    shift = 1 << 44  # more pieces of one length than any corpus has

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        keys = where["length"] * shift + where["rank"]
        for batch in batches:
            length, rank = (column(batch, c).to_numpy() for c in ("length", "rank"))
            row = np.searchsorted(keys, length * shift + rank, side="right") - 1
            nth = rank - where["rank"][row]
            copies = where["copies"][row]
            yield {c: column(batch, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {
                "sequence_id": where["sequence"][row] + nth // copies,
                "offset": where["offset"][row] + nth % copies * length,
            }

    return map_arrow(
        ranked, work,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
