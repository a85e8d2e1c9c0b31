"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class gets a mean and a covariance that is shrunk towards the pooled covariance and then towards
its own mean variance. The score is the difference of the two log densities, computed as Mahalanobis
distances through Cholesky factors that are made once. Spark gathers the moments of all labelled
rows; the driver sees two sums, two vectors and two matrices.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmetrics.llm.common import column, fold_of, id_and_text, map_arrow, saved, strings
from vidmetrics.llm.compression import duplicate_lines, repeated_words

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "distinct_words", "commonest_word", "repeated_words",
    "duplicate_lines", "log_words_per_line", "upper", "digits", "symbols", "marks", "spaces", "non_ascii", "odd_words",
    "initial_capitals", "log_words_per_sentence", "compressed", "compressed_tail",
)
ODD = re.compile(r"[A-Za-z][#*$%&|<>!]{2}|(?<!\S)\|(?!\S)")
SYMBOL = re.compile(r"[#*$%&|<>{}=+/\\^~@_]")
MARK = re.compile(r"[.,;:!?]")
CAPITAL = re.compile(r"(?<!\S)[^\W\d_a-z]\w*")
SENTENCE = re.compile(r"[.!?]+(?=\s|$)")


def _logit(share: float) -> float:
    share = min(max(share, 0.0), 1.0)
    return float(np.log((share + 0.002) / (1.002 - share)))


def statistics(text: str, compress) -> list[float]:
    """The transformed statistics of a text: shares as logits, sizes as logarithms."""
    raw = text.encode()
    words = raw.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    sizes = np.array([len(w) for w in words] or [0], float)
    often: dict[bytes, int] = {}
    for w in words:
        often[w] = often.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = sum(map(str.isupper, text)) if not raw.isupper() else chars
    half = raw[len(raw) // 2:]
    return [
        np.log1p(len(text)), np.log1p(len(words)), float(sizes.mean()) / 4, float(sizes.std()) / 4,
        _logit(len(often) / n), _logit(max(often.values(), default=0) / n), _logit(repeated_words(words) / n),
        _logit(duplicate_lines(raw) / max(len(lines), 1)), np.log1p(len(words) / max(len(lines), 1)),
        _logit(upper / chars), _logit(sum(raw.count(d) for d in b"0123456789") / chars),
        _logit(len(SYMBOL.findall(text)) / chars), _logit(len(MARK.findall(text)) / chars),
        _logit((len(raw) - sum(map(len, words))) / max(len(raw), 1)), _logit((len(raw) - len(text)) / chars),
        _logit(len(ODD.findall(text)) / n), _logit(len(CAPITAL.findall(text)) / n),
        np.log1p(len(words) / (1 + len(SENTENCE.findall(text)))),
        4 * len(compress(raw)) / max(len(raw), 64), 4 * len(compress(half)) / max(len(half), 64),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array<double>), one row per document row; null is the empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield {"doc_id": column(batch, "doc_id"), "stats": [statistics(t, compress) for t in strings(batch)]}

    return map_arrow(id_and_text(docs), work, "doc_id long, stats array<double>")


@dataclass(frozen=True)
class Discriminant:
    """``factors``: lower Cholesky factors of the two covariances, inverted once."""

    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    offsets: tuple[float, float]
    temper: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Near 1: class 1 likelier. Log densities are tempered, so that far points keep an order."""
        log = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return 0.5 + 0.5 * np.tanh((log[1] - log[0]) / (2 * self.temper))


def moments(rows: DataFrame, size: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """{label: (rows, sum, sum of outer products)} of ``rows`` (label, stats), summed by Spark."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            labels = column(batch, "label").to_numpy()
            x = np.array(column(batch, "stats").to_pylist(), float).reshape(-1, size)
            one = np.hstack([np.ones((len(x), 1)), x])
            for k in np.unique(labels).tolist():
                part = one[labels == k]
                total[k] = total.get(k, 0) + part.T @ part
        if total:
            yield {"label": list(total), "m": [t.ravel() for t in total.values()]}

    parts = map_arrow(rows, work, "label int, m array<double>").select("label", F.posexplode("m"))
    out: dict[int, np.ndarray] = {}
    for label, at, value in parts.groupBy("label", "pos").agg(F.sum("col")).collect():  # 2 * (size + 1)^2 rows
        out.setdefault(label, np.zeros((size + 1) ** 2))[at] = value
    square = {k: m.reshape(size + 1, size + 1) for k, m in out.items()}
    return {k: (m[0, 0], m[0, 1:], m[1:, 1:]) for k, m in square.items()}


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], *, pool: float = 0.05, ridge: float = 0.02, temper: float = 6.0) -> Discriminant:
    """``pool``: weight of the pooled covariance, ``ridge``: weight of the mean variance on the diagonal."""
    if set(sums) != {0, 1}:
        raise ValueError("the quality classifier needs labelled rows of both classes")
    n = {k: s[0] for k, s in sums.items()}
    mean = {k: s[1] / s[0] for k, s in sums.items()}
    own = {k: s[2] / s[0] - np.outer(mean[k], mean[k]) for k, s in sums.items()}
    pooled = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])
    factors, offsets = [], []
    for k in (0, 1):
        # Few rows of a class lean more on what both share.
        lean = min(1.0, pool + len(pooled) / (n[k] + len(pooled)))
        c = (1 - lean) * own[k] + lean * pooled
        c = (1 - ridge) * c + ridge * np.trace(c) / len(c) * np.eye(len(c)) + 1e-9 * np.eye(len(c))
        root = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(root))
        offsets.append(float(np.log(n[k] / (n[0] + n[1])) - np.log(np.diag(root)).sum()))
    return Discriminant((mean[0], mean[1]), tuple(factors), tuple(offsets), temper)


def quality_scores(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held_out: int = 1, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document row.

    Learns from labelled documents outside the fold; rows with a null id or label teach nothing and are
    scored like any other. Without labelled rows of both classes all scores are the share of label 1: 1 or 0
    where one class is all there is, 0.5 without labels.
    """
    rows = saved(document_statistics(docs), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.filter((fold_of(F.col("doc_id"), folds) != held_out) & F.col("label").isin(0, 1))
    sums = moments(rows.join(known, "doc_id").select("label", "stats"), len(STATISTICS))
    model = fit(sums) if set(sums) == {0, 1} else None
    share = float(1 in sums) if sums else 0.5

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x = np.array(column(batch, "stats").to_pylist(), float).reshape(-1, len(STATISTICS))
            score = model.scores(x) if model else np.full(len(x), share)
            ids = column(batch, "doc_id")
            held = [i is not None and zlib.crc32(str(i).encode()) % folds == held_out for i in ids.to_pylist()]
            yield {"doc_id": ids, "held_out": held, "score": score, "predicted": (score >= threshold).astype(np.int32)}

    return map_arrow(rows, work, "doc_id long, held_out boolean, score double, predicted int")
