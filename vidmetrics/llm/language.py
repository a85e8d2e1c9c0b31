"""Language identification of mixed text: scripts narrow the candidates, Viterbi labels the words.

A word's letters give its script, and only languages that were seen in that script are candidates.
Character n-grams give the word a log posterior per candidate. Over the words of a text the best
sequence of languages is found where each change of language costs a penalty, so a foreign word stays
inside its sentence and a foreign passage becomes a span of its own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmetrics.llm.common import column, fold_of, map_arrow, strings

UNKNOWN = "und"
BINS = 1 << 15
#: Log posterior of a language that a word's script rules out: more than any number of switches would save.
RULED_OUT = -1e4
#: Words a task remembers before it starts over.
REMEMBERED_WORDS = 300_000
# --- fixed values: first and last code points of scripts -----------------------
SCRIPTS = (
    ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul_jamo", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
# -------------------------------------------------------------------------------
SCRIPT_NUMBER = {name: i for i, (name, _, _) in enumerate(SCRIPTS)}
LATIN = len(SCRIPTS)  # and whatever else has letters
LETTERS = re.compile(r"[^\W\d_]+")


def letters_of(token: str) -> str:
    token = token.lower()
    return token if token.isalpha() else "".join(LETTERS.findall(token))


def script_of(letters: str) -> int:
    """The script of most letters; the first one in a tie."""
    if letters.isascii() or max(letters) < chr(SCRIPTS[0][1]):
        return LATIN
    found: Counter = Counter()
    for c in letters:
        code = ord(c)
        found[next((i for i, (_, a, b) in enumerate(SCRIPTS) if a <= code <= b), LATIN)] += 1
    return found.most_common(1)[0][0]


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the n-grams (2 to 4 bytes, the ends of a word marked) of all words and of each word as a
    whole, and the number of the word that each belongs to."""
    raw = [f"<{w}>".encode() for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), size)
    end = np.repeat(np.cumsum(size), size)
    bins = [np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % BINS]
    owners = [np.arange(len(raw))]
    code = data.copy()
    for n in (2, 3, 4):
        code = (code[:-1] << np.uint64(8)) | data[n - 1:]
        inside = np.flatnonzero(np.arange(len(code)) + n <= end[: len(code)])
        mixed = (code[inside] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        bins.append((mixed >> np.uint64(40)).astype(np.int64) % BINS)
        owners.append(owner[inside])
    return np.concatenate(bins), np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_share: np.ndarray  # (BINS, languages): log of the smoothed share of an n-gram
    scripts: np.ndarray  # (scripts, languages): whether the language is a candidate

    def words(self, tokens: list[str], damp: float, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(log posteriors (tokens, languages), letters) of tokens; zeros where there is nothing to tell. ``floor`` bounds
        the posteriors of candidates; what the script rules out is far below."""
        letters = [letters_of(t) for t in tokens]
        bins, owner = ngrams(letters)
        log = np.stack([np.bincount(owner, self.log_share[bins, k], len(tokens)) for k in range(len(self.languages))], axis=1)
        size = np.fromiter(map(len, letters), np.int64, len(letters))
        candidates = self.scripts[np.array([script_of(x) if x else LATIN for x in letters], np.int64)]
        told = (size > 0) & candidates.any(1)
        log = np.where(candidates & told[:, None], damp * log, -np.inf)
        log[~told] = 0
        log -= log.max(1, keepdims=True)
        log = np.maximum(log - np.log(np.exp(log).sum(1, keepdims=True)), floor)
        log[~candidates] = RULED_OUT
        log[~told] = 0
        return log.astype(np.float32), size


def train(docs: DataFrame, *, folds: int, held_out: int, smooth: float = 0.5, least_share: float = 0.001) -> Model:
    """Counts over all rows with a language outside the held-out fold.

    Each task counts the n-grams of its words, Spark adds them up, and the driver gets at most ``BINS``
    counts per language. A language is a candidate for a script that at least
    ``least_share`` of its words have.
    """
    rows = docs.filter("lang is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    ).filter(fold_of(F.col("doc_id"), folds) != held_out)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: dict[str, Counter] = {}
        total: dict[str, np.ndarray] = {}

        def count() -> None:
            for lang, words in seen.items():
                letters = [letters_of(w) for w in words]
                n = np.fromiter(words.values(), np.float64, len(words))
                n[[not x for x in letters]] = 0
                bins, owner = ngrams(letters)
                scripts = np.array([script_of(x) if x else LATIN for x in letters], np.int64)
                part = np.concatenate([np.bincount(bins, n[owner], BINS), np.bincount(scripts, n, LATIN + 1)])
                total[lang] = total.get(lang, 0) + part
            seen.clear()

        for batch in batches:
            for lang, text in zip(column(batch, "lang").to_pylist(), strings(batch)):
                seen.setdefault(lang, Counter()).update(text.lower().split())
            if sum(map(len, seen.values())) > REMEMBERED_WORDS:
                count()
        count()
        for lang, bins in total.items():
            at = np.flatnonzero(bins)
            yield {"lang": [lang] * len(at), "bin": at, "n": bins[at].astype(np.int64)}

    bins = map_arrow(rows, grams, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    table = bins.toPandas()
    languages = tuple(sorted(table["lang"].unique()))
    counts = np.zeros((BINS + LATIN + 1, len(languages)))
    counts[table["bin"], [languages.index(x) for x in table["lang"]]] = table["n"]
    n, scripts = counts[:BINS], counts[BINS:]
    share = (n + smooth) / (n.sum(0) + smooth * BINS)
    return Model(languages, np.log(share).astype(np.float32), scripts >= np.maximum(least_share * scripts.sum(0), 1))


def best_path(s: np.ndarray, penalty: float) -> list[tuple[int, int, int]]:
    """Spans (first row, end, column) of the path through ``s`` with the largest sum, less ``penalty`` for
    each change of column; in a tie a column is kept, else the first is taken."""
    best = int(s.sum(0).argmax())
    gain = np.vstack([np.zeros((1, s.shape[1])), np.cumsum(s - s[:, best:best + 1], axis=0, dtype=np.float64)])
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty / 2:
        return [(0, len(s), best)]  # no stretch gains enough elsewhere to pay for leaving or coming back
    value = s[0].astype(np.float64).tolist()
    moved: list[tuple[int, list[bool]]] = []
    for row in s[1:].astype(np.float64).tolist():
        top = max(value)
        least = top - penalty
        moved.append((value.index(top), [v < least for v in value]))
        value = [(least if v < least else v) + x for v, x in zip(value, row)]
    at, end, spans = value.index(max(value)), len(s), []
    for i in range(len(moved) - 1, -1, -1):
        source, changed = moved[i]
        if changed[at]:
            spans.append((i + 1, end, at))
            end, at = i + 1, source
    spans.append((0, end, at))
    return spans[::-1]


def identify(
    docs: DataFrame, model: Model, *, penalty: float = 12.0, damp: float = 0.5, floor: float = -6.0,
) -> DataFrame:
    """(doc_id, lang, score, spans array<struct<first, end, lang>>), one row per document row.

    Spans count words between white space, end exclusive, and cover all words of the text from the first
    to the last; lang is the language of most letters (the first by name in a tie), ``und`` without any
    letter or any learned language. score is the share of letters in spans of lang, times the mean
    posterior of lang over the words of those spans.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known: dict[str, int] = {}
        width = len(model.languages)
        scores = np.zeros((1 << 12, width), np.float32)
        sizes = np.zeros(1 << 12, np.int64)

        def learn(tokens: set[str]) -> None:
            nonlocal scores, sizes
            if len(known) > REMEMBERED_WORDS:
                known.clear()
            new = [t for t in tokens if t not in known]
            if not new:
                return
            first = len(known)
            known.update((t, first + i) for i, t in enumerate(new))
            while len(known) > len(sizes):
                scores, sizes = np.concatenate([scores, np.zeros_like(scores)]), np.concatenate([sizes, np.zeros_like(sizes)])
            scores[first:len(known)], sizes[first:len(known)] = model.words(new, damp, floor)

        for batch in batches:
            langs, marks, spans = [], [], []
            texts = [text.split() if width else [] for text in strings(batch)]
            learn({t for tokens in texts for t in tokens})
            for tokens in texts:
                at = np.array([known[t] for t in tokens], np.int64)
                letters = sizes[at]
                where = np.flatnonzero(letters)
                if not len(where):
                    langs.append(UNKNOWN), marks.append(0.0), spans.append([])
                    continue
                s = scores[at[where]]
                path = best_path(s, penalty)
                total, sure, words = np.zeros(width), np.zeros(width), np.zeros(width)
                for a, b, k in path:
                    total[k] += letters[where[a:b]].sum()
                    sure[k] += np.exp(s[a:b, k]).sum()
                    words[k] += b - a
                k = int(total.argmax())
                langs.append(model.languages[k])
                marks.append(float(total[k] / total.sum() * sure[k] / words[k]))
                edges = [0, *(int(where[a]) for a, _, _ in path[1:]), len(tokens)]
                spans.append([{"first": a, "end": b, "lang": model.languages[p[2]]} for a, b, p in zip(edges, edges[1:], path)])
            yield {"doc_id": column(batch, "doc_id"), "lang": langs, "score": np.minimum(marks, 1.0), "spans": spans}

    return map_arrow(rows, work, "doc_id long, lang string, score double, spans array<struct<first: long, end: long, lang: string>>")


def language_of(docs: DataFrame, *, folds: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_spans) with a model of the documents outside the fold."""
    found = identify(docs, train(docs, folds=folds, held_out=held_out))
    return found.select(
        "doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), F.col("lang").alias("lang_pred"), "score",
        F.size("spans").alias("n_spans"),
    )
