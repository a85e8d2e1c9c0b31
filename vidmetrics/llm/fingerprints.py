"""Document fingerprints: SimHash of weighted terms, and a search of all fingerprints within a radius.

Terms are words and word shingles. Each term's hash votes on all bits of the fingerprint with the term's weight,
for 1 or for 0; the heavier side is the bit. Votes are summed bit-sliced: three hashes of one weight become
their sum and their carry of twice the weight until few are left to be unpacked.

The search cuts fingerprints into more blocks than bits may differ, so ``spare`` blocks at least agree between two
that are near. There is one table per choice of ``spare`` blocks, in which the fingerprints lie with these blocks in
front; a query meets, in each table, those that begin alike, and the differing bits decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidmetrics.llm.common import BROADCAST_KEYS, column, id_and_text, map_arrow, saved, utf8

#: 64-bit lanes of a fingerprint; words of a shingle; weights of a word and of a shingle.
LANES, SHINGLE, WEIGHTS = 4, 3, (1, 2)
BITS = 64 * LANES
#: Words whose hashes a task remembers; hashes of one weight from which on they are added bit-sliced.
REMEMBERED, SLICED = 1 << 18, 64
#: Parts into which the fingerprints that begin alike are dealt.
SALTS = 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """XXH64 of words, remembered up to a number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def weighted_terms(words: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, weight) of each distinct word and shingle; fewer words than a shingle are one shingle. A term that occurs
    2, 4, 8... times weighs 2, 3, 4... times as much as one that occurs once."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(words))
    row = np.full(len(h) - k + 1, np.uint64(k))
    for j in range(k):
        row = _mixed(row * _STEP + h[j:len(h) - k + 1 + j])
    found = [np.unique(x, return_counts=True) for x in (h, row)]
    weight = [w * (np.log2(c).astype(np.int64) + 1) for (_, c), w in zip(found, WEIGHTS)]
    return np.concatenate([x for x, _ in found]), np.concatenate(weight)


def votes(hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weight of the hashes (rows of lanes) that have each bit."""
    total, carried, level = np.zeros(64 * hashes.shape[1], np.int64), [], 0
    while carried or (weight >> level).any():
        rows = np.concatenate([hashes[(weight >> level) & 1 == 1], *carried])
        carried = []
        while len(rows) > SLICED:
            m = len(rows) // 3
            a, b, c = rows[:m], rows[m:2 * m], rows[2 * m:3 * m]
            odd = a ^ b
            carried.append((a & b) | (odd & c))
            rows = np.concatenate([odd ^ c, rows[3 * m:]])
        bits = np.unpackbits(rows.view(np.uint8).reshape(len(rows), 8 * hashes.shape[1]), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64) << level
        level += 1
    return total


def fingerprint(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The lanes of a text's fingerprint; without a word all bits are 0."""
    words = text.lower().split()  # bytes: only A-Z is lowered, only ASCII white space splits
    if not words:
        return np.zeros(LANES, np.uint64)
    terms, weight = weighted_terms(words, hashes)
    lanes = np.stack([_mixed(terms + np.uint64(i + 1) * _STEP) if i else terms for i in range(LANES)], axis=1)
    bits = 2 * votes(lanes, weight) > weight.sum()
    return np.packbits(bits, bitorder="little").view("<u8")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the bits in which two fingerprints agree."""
    return 1 - int(np.bitwise_count(a ^ b).sum()) / BITS


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by the first as many characters of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


FINGERPRINT = [f"f{i}" for i in range(LANES)]
EDITED = [f"e{i}" for i in range(LANES)]
_ROW = ", ".join(["doc_id long", "n_chars long", "edited_sha256 string", *[f"{c} long" for c in FINGERPRINT + EDITED], "near_edited double", "near_next double"])
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


class _Rows:
    """Finished rows of documents whose next one is known."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, text: str, fp: np.ndarray, following: str, next_fp: np.ndarray, hashes: WordHashes) -> None:
        other = edited(text, following).encode()
        edited_fp = fingerprint(other, hashes)
        self.rows.append((
            doc_id, len(text), sha256(other).hexdigest(), *fp.view(np.int64).tolist(), *edited_fp.view(np.int64).tolist(),
            likeness(fp, edited_fp), likeness(fp, next_fp),
        ))

    def columns(self) -> dict:
        made = dict(zip(_NAMES, map(list, zip(*self.rows)))) if self.rows else {c: [] for c in _NAMES}
        self.rows = []
        return made


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, f0.., e0.., near_edited, near_next), one row per document row: lanes of the
    fingerprints of each text and of its edited text, and their likeness.

    The next document follows by descending doc_id, the first one after the last; equal ids by the hash of
    their texts, null ids last. Null is the empty text; one row alone is its own next one. Texts are shuffled once,
    compressed, by ranges of ids; only the first and last text of a range meet another task's.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = utf8(batch)
            tie = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)
            yield {"doc_id": column(batch, "doc_id"), "tie": tie, "z": [press.compress(t) for t in texts]}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes, unpack, done = WordHashes(), zstandard.ZstdDecompressor(), _Rows()
        part = TaskContext.get().partitionId()

        def out(kind: int, more: int = 0, **given) -> dict:
            made = done.columns()
            n = len(made["doc_id"])
            return {c: v + [None] * more for c, v in made.items()} | {"kind": [0] * n + [kind] * more, "part": [part] * (n + more)} | {
                "z": [None] * n + given.get("z", [])} | ({"doc_id": made["doc_id"] + given["doc_id"]} if more else {})

        last = None
        for batch in batches:
            for doc_id, z in zip(column(batch, "doc_id").to_pylist(), column(batch, "z").to_pylist()):
                data = unpack.decompress(z)
                now = (doc_id, data.decode(), fingerprint(data, hashes))
                if last is None:
                    yield out(1, 1, doc_id=[doc_id], z=[z])
                else:
                    done.add(*last, *now[1:], hashes)
                last = now
            yield out(0)
        if last is not None:
            yield out(2, 1, doc_id=[last[0]], z=[zstandard.compress(last[1].encode())])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes, unpack, done = WordHashes(), zstandard.ZstdDecompressor(), _Rows()
        for batch in batches:
            for doc_id, *both in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "z", "first"))):
                text, following = (unpack.decompress(z) for z in both)
                done.add(doc_id, text.decode(), fingerprint(text, hashes), following.decode(), fingerprint(following, hashes), hashes)
            yield done.columns()

    packed = map_arrow(id_and_text(docs), pack, "doc_id long, tie long, z binary").withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("row")]  # equal ids spread over ranges as well
    ranged = packed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "z")
    made = saved(map_arrow(ranged, compare, f"{_ROW}, kind int, part int, z binary"), "compared")
    heads = made.filter("kind = 1").select("part", F.col("z").alias("first"))
    parts = sorted(r["part"] for r in heads.select("part").collect())  # a number per range
    follows = made.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "before int, part int")
    ends = made.filter("kind = 2").select(F.col("part").alias("before"), "doc_id", "z").join(F.broadcast(follows), "before").join(heads, "part")
    return made.filter("kind = 0").select(*_NAMES).unionByName(map_arrow(ends.select("doc_id", "z", "first"), close, _ROW))


def as_hex(lanes: list[str]) -> Column:
    """A fingerprint as lowercase hex digits, 16 a lane."""
    return F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in lanes])


def _block(digits: Column, i: int, blocks: int) -> Column:
    size = BITS // 4
    start = i * size // blocks
    return F.substring(digits, start + 1, (i + 1) * size // blocks - start)


def within_radius(queries: DataFrame, index: DataFrame, *, radius: int, spare: int = 1) -> DataFrame:
    """(f0.., near) for each distinct fingerprint of ``queries`` (f0..): rows of ``index`` (f0..) whose fingerprints differ
    from it in at most ``radius`` bits, counted. Queries with none near are left out.

    All of them are found: of ``radius + spare`` blocks ``spare`` agree. Equal fingerprints are counted once with
    their number. Query keys are sent to the index where a count finds them few, else both are shuffled, the index
    in ``SALTS`` parts.
    """
    blocks = radius + spare
    if not 1 <= spare <= blocks <= BITS // 4:
        raise ValueError("more blocks than hex digits, or none to agree")
    tables = list(combinations(range(blocks), spare))

    def keyed(rows: DataFrame) -> DataFrame:
        digits = as_hex(FINGERPRINT)
        keys = [F.struct(F.lit(t).alias("table"), F.concat(*[_block(digits, i, blocks) for i in chosen]).alias("key")) for t, chosen in enumerate(tables)]
        return rows.select("*", F.explode(F.array(*keys)).alias("k")).select(*rows.columns, "k.*")

    asked = saved(keyed(queries.select(*FINGERPRINT).distinct()), "asked")
    asked = asked.select("table", "key", *[F.col(c).alias(f"q{c}") for c in FINGERPRINT])
    held = keyed(index.groupBy(*FINGERPRINT).agg(F.count("*").alias("n")))
    on = ["table", "key"]
    if asked.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        met = held.join(F.broadcast(asked), on)
    else:
        asked = asked.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        met = held.withColumn("salt", F.pmod(F.xxhash64(*FINGERPRINT), F.lit(SALTS)).cast("int")).join(asked, [*on, "salt"])
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"q{c}"))) for c in FINGERPRINT), F.lit(0))
    # A pair that agrees in several tables counts in the first of them.
    mine, theirs = as_hex(FINGERPRINT), as_hex([f"q{c}" for c in FINGERPRINT])
    same = [_block(mine, i, blocks) == _block(theirs, i, blocks) for i in range(blocks)]
    first = F.lit(None)
    for t, chosen in reversed(list(enumerate(tables))):
        agree = same[chosen[0]]
        for i in chosen[1:]:
            agree = agree & same[i]
        first = F.when(agree, t).otherwise(first)
    near = met.filter((differ <= radius) & (first == F.col("table")))
    return near.groupBy(*[F.col(f"q{c}").alias(c) for c in FINGERPRINT]).agg(F.sum("n").alias("near"))


def document_fingerprints(docs: DataFrame, *, radius: int = 7, spare: int = 1, every: int = 100) -> DataFrame:
    """``fingerprints`` with hex digits for lanes, and n_near: for each document whose id is divisible by ``every``, how
    many other documents' fingerprints lie within ``radius`` bits; null for other documents, which are not asked for.

    Equal texts have equal fingerprints; texts without a word have fingerprint zero and are near one another. Null ids are
    not asked for. No documents: no rows. Repeated rows count as documents of their own; other columns are ignored.
    """
    rows = saved(fingerprints(docs), "fingerprints")
    asked = rows.filter(F.col("doc_id") % every == 0)
    near = saved(within_radius(asked, rows, radius=radius, spare=spare), "near")
    few = near.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    asked = asked.join(F.broadcast(near) if few else near, FINGERPRINT).withColumn("n_near", F.col("near") - 1)
    rest = rows.filter((F.col("doc_id") % every != 0) | F.col("doc_id").isNull()).withColumn("n_near", F.lit(None).cast("long"))
    out = asked.select(*rest.columns).unionByName(rest)
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(FINGERPRINT).alias("fingerprint"), as_hex(EDITED).alias("edited_fingerprint"),
        "near_edited", "near_next", "n_near",
    )
