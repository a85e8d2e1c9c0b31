"""Quality rules by compression: bands of zstandard ratios for whole documents and fixed chunks."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmetrics.llm.common import column, id_and_text, map_arrow, of_keys, utf8

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Accepted compressed / raw sizes, ends included.

    ``whole``: (largest size in bytes, lowest, highest) by ascending size. Short texts pay for the frame's
    header and long ones find more to copy, so the band falls with the size. Below the band a text
    repeats itself or is a listing, above it is noise. ``chunk`` is the band of a whole chunk of
    ``chunk_bytes``; a document fails if over ``bad_chunks`` of its whole chunks are outside.
    """

    whole: tuple[tuple[float, float, float], ...] = (
        (64, 0.0, 9.0), (128, 0.60, 1.40), (256, 0.54, 1.10), (512, 0.53, 0.90), (1024, 0.51, 0.80),
        (2048, 0.475, 0.72), (4096, 0.448, 0.66), (8192, 0.424, 0.62), (16384, 0.404, 0.60),
        (float("inf"), 0.385, 0.60),
    )
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (0.42, 0.70)
    bad_chunks: float = 0.25
    level: int = 3


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found at least twice."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    key = ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    for k in range(1, width):
        if k > 1 and int(key.max()) >= (1 << 62) // len(seen):
            key = np.unique(key, return_inverse=True)[1]
        key = key[: n - k] * len(seen) + ids[k:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(n + 1, np.int64)
    edges[:-width] += twice
    edges[width:] -= twice
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def compression_rules(docs: DataFrame, *, bands: Bands = Bands()) -> DataFrame:
    """One row per document row: doc_id, counts, ratios, base_failed and kept.

    Words are runs of anything but ASCII white space. ratio is compressed / raw bytes of the whole text,
    bad_chunks the share of its whole chunks outside their band (0 without a whole chunk). A null or
    empty text has no words, ratio null and fails the base rule. Every text is read to its end.
    """
    limits = [b[0] for b in bands.whole]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        compress = zstandard.ZstdCompressor(level=bands.level).compress
        low, high = bands.chunk
        for batch in batches:
            out: dict[str, list] = {c: [] for c in (
                "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks",
            )}
            for text in utf8(batch):
                words = text.split()
                chars = sum(map(len, words)) if text.isascii() else len(b"".join(words).decode())
                repeats = repeated_words(words)
                failed = len(words) < 50 or 100 * repeats > 50 * len(words)
                ratio = len(compress(text)) / len(text) if text else None
                whole = range(0, len(text) - bands.chunk_bytes + 1, bands.chunk_bytes)
                sizes = [len(compress(text[i:i + bands.chunk_bytes])) / bands.chunk_bytes for i in whole]
                bad = sum(not low <= r <= high for r in sizes) / len(sizes) if sizes else 0.0
                ok = ratio is not None and bad <= bands.bad_chunks
                if ok:
                    _, lowest, highest = bands.whole[bisect_left(limits, len(text))]
                    ok = lowest <= ratio <= highest
                for c, x in zip(out, (
                    len(words), chars, sum(text.count(s) for s in SYMBOLS), duplicate_lines(text), repeats, failed,
                    ok and not failed, ratio, bad,
                )):
                    out[c].append(x)
            yield {"doc_id": column(batch, "doc_id"), **out}

    return map_arrow(
        id_and_text(docs), work,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, ratio double, bad_chunks double",
    )


def keep_compressible(docs: DataFrame, *, bands: Bands = Bands()) -> DataFrame:
    """The documents whose id has no row that fails; rows without an id go."""
    failed = compression_rules(docs, bands=bands).filter(~F.col("kept")).select("doc_id").distinct()
    return of_keys(docs.filter("doc_id is not null"), failed, "doc_id", "left_anti")
