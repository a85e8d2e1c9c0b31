"""Toxicity: a support vector machine on sentences with a gap-weighted subsequence kernel.

Two words are alike by the letter subsequences they share, each weighted down by the letters it skips, so
an insult with inserted or skipped characters stays close to the insult. Two sentences are alike by the
sum over their words. Nyström landmarks, words that labels favour and words that they do not, span the
space; a squared-hinge machine is trained on labelled sentences. A document has one label for all its
sentences, so sentences of toxic documents that look clean leave the training in later rounds. The
machine is linear in the kernel with its landmarks, which folds into one weight per subsequence: a word is
scored without meeting the landmarks again. A document counts by its worst sentences.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmetrics.llm.common import column, fold_of, id_and_text, map_arrow, map_rows, saved, strings
from vidmetrics.llm.vectors import binary_rows, from_binary_rows

#: Letters per subsequence, letters it may skip in all, and the weight of a skipped letter.
ORDER, GAPS, DECAY = 4, 3, 0.5
#: Letters of a piece of a word, and steps between pieces.
PIECE, STEP = 12, 6
SYMBOLS = 48
#: Words of a sentence; longer stretches without an end are cut.
SENTENCE_WORDS = 24
#: A sentence counts by its strongest words, a document by its worst sentences.
WORST_WORDS, WORST_SENTENCES = 2, 3
REMEMBERED_WORDS = 300_000
#: Tasks that make the features of the drawn sentences.
FEATURE_TASKS = 24

LETTERS = re.compile(r"[^\W_]+")
END = re.compile(r"[.!?]+(?=\s|$)|\n")
SPELLED = re.compile(r"(?<!\S)(?:\w[ .*_-]){3,}\w(?!\w)")


@lru_cache(maxsize=None)
def _picks(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Index tuples of the subsequences of a piece, and their weights, scaled by the piece's length only."""
    at = [p for p in combinations(range(length), ORDER) if p[-1] - p[0] < ORDER + GAPS]
    at = np.array(at, np.int64).reshape(-1, ORDER)
    weight = DECAY ** (at[:, -1] - at[:, 0] + 1.0 - ORDER)
    return at, (weight / np.sqrt((weight * weight).sum())).astype(np.float32)


def _symbols(pieces: list[str]) -> np.ndarray:
    """A small number for each character of equally long pieces: letters a-z of their own, others hashed."""
    code = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    other = 27 + (code * 2654435761 >> 7) % (SYMBOLS - 27)
    return np.where((code >= 97) & (code <= 122), code - 96, other).reshape(len(pieces), -1)


def subsequences(pieces: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of the pieces: (their positions, codes (pieces, subsequences), weights of a piece).

    Pieces shorter than a subsequence have none.
    """
    by_length: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        by_length.setdefault(len(p), []).append(i)
    for length, where in by_length.items():
        if length < ORDER:
            continue
        at, weight = _picks(length)
        for k in range(0, len(where), 4096):
            rows = where[k:k + 4096]
            letters = _symbols([pieces[i] for i in rows])
            codes = letters[:, at[:, 0]]
            for j in range(1, ORDER):
                codes = codes * SYMBOLS + letters[:, at[:, j]]
            yield np.array(rows), codes, weight


def pieces_of(token: str) -> list[str]:
    """The letters and digits of a token in pieces that overlap by half."""
    letters = "".join(LETTERS.findall(token))
    if len(letters) <= PIECE:
        return [letters]
    return [letters[i:i + PIECE] for i in range(0, len(letters) - PIECE + STEP, STEP)]


def sentences(text: str) -> list[list[str]]:
    """Lower-case tokens by sentence; letters spelled out one by one are also one token of their own."""
    lowered = text.lower()
    out = []
    for part in END.split(lowered):
        tokens = part.split()
        out += [tokens[i:i + SENTENCE_WORDS] for i in range(0, len(tokens), SENTENCE_WORDS)]
    spelled = ["".join(LETTERS.findall(m)) for m in SPELLED.findall(lowered)]
    return out + [[s] for s in spelled]


class Kernel:
    """The kernel with fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        parts = list(subsequences(landmarks))
        self.codes = np.unique(np.concatenate([c.ravel() for _, c, _ in parts] or [np.zeros(0, np.int64)]))
        self.weights = np.zeros((len(self.codes) + 1, len(landmarks)), np.float32)
        for rows, codes, w in parts:
            at = np.searchsorted(self.codes, codes)
            np.add.at(self.weights, (at, np.repeat(rows[:, None], codes.shape[1], 1)), w[None, :])

    def with_landmarks(self, pieces: list[str]) -> np.ndarray:
        out = np.zeros((len(pieces), len(self.landmarks)), np.float32)
        for rows, codes, w in subsequences(pieces):
            at = np.searchsorted(self.codes, codes)
            at[self.codes[np.minimum(at, len(self.codes) - 1)] != codes] = len(self.codes)
            for k in range(0, len(rows), 256):
                out[rows[k:k + 256]] = np.einsum("t,ntm->nm", w, self.weights[at[k:k + 256]])
        return out


@dataclass(frozen=True)
class Machine:
    """``codes`` and ``weights`` of the subsequences, ``bias`` of a sentence; ``slope`` and ``shift`` of
    the logistic curve from a document's decision to its probability."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def table(self) -> np.ndarray:
        dense = np.zeros(SYMBOLS ** ORDER, np.float32)
        dense[self.codes] = self.weights
        return dense

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 0.5 + 0.5 * np.tanh((self.slope * decision + self.shift) / 2)


class Judge:
    """Scores texts with a machine; remembers the words it has met."""

    def __init__(self, machine: Machine):
        self.machine, self.table, self.known = machine, machine.table(), {}

    def learn(self, tokens: set[str]) -> None:
        """What each token adds to the decision of its sentence; a long one counts by its strongest piece."""
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        new = [t for t in tokens if t not in self.known]
        pieces, owner = [], []
        for i, t in enumerate(new):
            for p in pieces_of(t):
                pieces.append(p)
                owner.append(i)
        value = np.zeros(len(pieces))
        for rows, codes, w in subsequences(pieces):
            value[rows] = self.table[codes] @ w
        out = np.full(len(new), -np.inf)
        np.maximum.at(out, owner, value)
        self.known.update(zip(new, out.tolist()))

    def decisions(self, texts: list[str]) -> np.ndarray:
        parts = [sentences(t) for t in texts]
        tokens = {t for s in parts for x in s for t in x}
        self.learn(tokens)
        if not tokens <= self.known.keys():  # cleared meanwhile
            self.learn(tokens)
        value, bias, out = self.known, self.machine.bias, np.full(len(texts), WORST_SENTENCES * self.machine.bias)
        for i, s in enumerate(parts):
            worst = sorted((_strongest([value[t] for t in x]) for x in s), reverse=True)[:WORST_SENTENCES]
            out[i] += sum(worst)
        return out


def _strongest(values: list[float]) -> float:
    return sum(sorted(values)[-WORST_WORDS:])


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, *, rounds: int = 30) -> np.ndarray:
    """Weights (the last one the bias) of a linear machine with squared hinge loss, by Newton steps."""
    w = np.zeros(x.shape[1] + 1)
    damp = np.ones(len(w))
    damp[-1] = 1e-3
    for _ in range(rounds):
        gradient, hessian = damp * w, np.diag(damp)
        for i in range(0, len(x), 4096):  # small parts: no second copy of the features
            part, yi, ci = np.hstack([x[i:i + 4096], np.ones((len(x[i:i + 4096]), 1), x.dtype)]), y[i:i + 4096], cost[i:i + 4096]
            slack = 1 - yi * (part @ w)
            active = slack > 0
            xa, ca = part[active], ci[active]
            gradient -= 2 * xa.T @ (ca * yi[active] * slack[active])
            hessian += 2 * (xa * ca[:, None]).T @ xa
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w


class Features:
    """Nyström features of sentences: kernel values with the landmarks, times the root of the landmarks' own."""

    def __init__(self, landmarks: list[str]):
        self.kernel = Kernel(landmarks)
        values, vectors = np.linalg.eigh(self.kernel.with_landmarks(landmarks).astype(np.float64))
        good = values > 1e-4 * values.max()
        self.root = vectors[:, good] / np.sqrt(values[good])

    def of(self, texts: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(texts), self.root.shape[1]), np.float32)
        for i in range(0, len(texts), 512):
            out[i:i + 512] = _features(self.kernel, self.root, texts[i:i + 512])
        return out


def _features(kernel: Kernel, root: np.ndarray, texts: list[list[str]]) -> np.ndarray:
    tokens = sorted({t for s in texts for t in s})
    number = {t: i for i, t in enumerate(tokens)}
    pieces, owner = [], []
    for i, t in enumerate(tokens):
        for p in pieces_of(t):
            pieces.append(p)
            owner.append(i)
    by_token = np.zeros((len(tokens), len(kernel.landmarks)), np.float32)
    np.maximum.at(by_token, owner, kernel.with_landmarks(pieces))
    x = np.zeros((len(texts), root.shape[1]), np.float32)
    by_token = (by_token @ root).astype(np.float32)
    for i, s in enumerate(texts):
        x[i] = by_token[[number[t] for t in s]].sum(0)
    return x


def train(texts: list[list[str]], toxic: np.ndarray, landmarks: list[str], **given) -> Machine:
    """A machine from labelled sentences (lists of tokens); see ``machine_of``."""
    features = Features(landmarks)
    return machine_of(features, features.of(texts), toxic, **given)


def machine_of(features: Features, x: np.ndarray, toxic: np.ndarray, *, rounds: int = 3, keep: float = 0.15, cost: float = 20.0) -> Machine:
    """A machine from the features of labelled sentences; ``keep``: share of the sentences with a toxic label
    that count as toxic after the first round."""
    kernel, root = features.kernel, features.root
    use = np.ones(len(x), bool)
    for _ in range(rounds):
        y = np.where(toxic[use], 1.0, -1.0)
        weight = np.where(y > 0, cost / max((y > 0).sum(), 1), cost / max((y < 0).sum(), 1)) * 100
        w = svm(x[use], y, weight)
        decision = x @ w[:-1] + w[-1]
        use = ~toxic | (decision >= np.quantile(decision[toxic], 1 - keep))
    alpha = root @ w[:-1]
    return Machine(kernel.codes, (kernel.weights[:-1] @ alpha).astype(np.float32), float(w[-1]))


def logistic(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic curve through (decision, label), by damped Newton steps."""
    targets = np.where(y > 0, 1 - 1e-3, 1e-3)
    centre, scale = f.mean(), f.std() + 1e-9
    x = np.stack([(f - centre) / scale, np.ones(len(f))], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 0.5 + 0.5 * np.tanh(x @ w / 2)
        gradient = x.T @ (weight * (p - targets)) + 1e-6 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1] - w[0] * centre / scale)


def _counts(rows: DataFrame) -> DataFrame:
    """(piece, n, toxic): in how many documents of each label a piece of a word occurs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            n: Counter = Counter()
            bad: Counter = Counter()
            for text, label in zip(strings(batch), column(batch, "label").to_pylist()):
                found = {p for s in sentences(text) for t in s for p in pieces_of(t) if len(p) >= ORDER}
                n.update(found)
                if label:
                    bad.update(found)
            yield {"piece": list(n), "n": list(n.values()), "toxic": [bad[p] for p in n]}

    counted = map_arrow(rows, work, "piece string, n long, toxic long")
    return counted.groupBy("piece").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def _sentence_rows(rows: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = [(x, label) for text, label in zip(strings(batch), column(batch, "label").to_pylist()) for x in sentences(text)]
            yield {"tokens": [x for x, _ in out], "label": [y for _, y in out]}

    return map_arrow(rows, work, "tokens array<string>, label int")


def _machine(sample: DataFrame, landmarks: list[str]) -> Machine:
    """A machine from ``sample`` (tokens, label). Tasks make the features; the driver holds them as one
    matrix of four bytes an entry, sentences x landmarks, and nothing else of the sample."""
    features = Features(landmarks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"label": column(batch, "label"), "x": binary_rows(features.of(column(batch, "tokens").to_pylist()))}

    parts = sample.repartition(FEATURE_TASKS, F.xxhash64("tokens"), F.col("label"))
    made = saved(map_arrow(parts, work, "label int, x binary"), "sentence-features").toArrow()
    width = features.root.shape[1]
    x = np.concatenate([from_binary_rows(b, "x", "<f4", width) for b in made.to_batches()] or [np.zeros((0, width), np.float32)])
    return machine_of(features, x, made.column("label").to_numpy() == 1)


def fit(
    docs: DataFrame, labels: DataFrame, *, folds: int = 4, held_out: int = 2, documents_per_label: int = 3000,
    sentences_per_label: int = 15_000, landmarks: int = 256,
) -> Machine | None:
    """A calibrated machine from a bounded sample of labelled rows outside the held-out fold.

    Per label ``documents_per_label`` documents are drawn by the hash of their ids; a fifth of them fits
    the logistic curve, with the labels' true shares, and the others give ``landmarks`` and up to
    ``sentences_per_label`` sentences per label. None if a label has no document.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.filter((fold_of(F.col("doc_id"), folds) != held_out) & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))  # of contradicting labels the toxic one
    share = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    if set(share) != {0, 1}:
        return None
    known = known.withColumn("h", F.xxhash64("doc_id"))
    drawn = [known.filter(F.col("label") == y).orderBy("h", "doc_id").limit(documents_per_label) for y in (0, 1)]
    drawn = drawn[0].unionByName(drawn[1]).select("doc_id", "label", (F.pmod("h", F.lit(5)) == 0).alias("curve"))
    # At most 2 * documents_per_label ids.
    rows = saved(id_and_text(docs).join(F.broadcast(drawn), "doc_id").filter("text is not null"), "labelled")
    learn = rows.filter(~F.col("curve"))
    counts = saved(_counts(learn), "pieces-of-words")
    size = {r["label"]: r["count"] for r in learn.groupBy("label").count().collect()}
    if set(size) != {0, 1}:
        return None
    p = size[1] / (size[0] + size[1])
    z = (F.col("toxic") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p) + 1)
    chosen = [
        r["piece"] for order, n in ((z.desc(), landmarks // 2), (F.col("n").desc(), landmarks // 4), (F.xxhash64("piece"), landmarks // 4))
        for r in counts.orderBy(order, "piece").limit(n).collect()
    ]
    if not chosen:
        return None
    sample = _sentence_rows(learn)
    drawn_rows = [sample.filter(F.col("label") == y).orderBy(F.xxhash64("tokens"), "tokens").limit(sentences_per_label) for y in (0, 1)]
    machine = _machine(drawn_rows[0].unionByName(drawn_rows[1]), list(dict.fromkeys(chosen)))
    curve = decisions(rows, machine, keep=("label", "curve")).filter("curve").select("decision", "label").toPandas()
    f, y = curve["decision"].to_numpy(), curve["label"].to_numpy()
    if len(np.unique(y)) < 2:
        return machine
    weight = np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum())
    slope, shift = logistic(f, y, weight / (share[0] + share[1]))
    return Machine(machine.codes, machine.weights, machine.bias, slope, shift)


def decisions(docs: DataFrame, machine: Machine | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, decision, score) of whole texts. Without a machine the decision and the score are 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        judge = Judge(machine) if machine else None
        for batch in batches:
            decision = judge.decisions(strings(batch)) if judge else np.zeros(batch.num_rows)
            yield {c: column(batch, c) for c in ("doc_id", *keep)} | {
                "decision": decision, "score": machine.probability(decision) if machine else decision,
            }

    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return map_arrow(rows, work, f"doc_id long{extra}, decision double, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document row.

    A null or empty text has no sentence and gets the score of nothing bad. Labels that lack a class give
    no machine, and all scores are 0. Rows with a null id or label teach nothing.
    """
    scored = decisions(docs, fit(docs, labels, folds=folds, held_out=held_out))
    return scored.select(
        "doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; columns and other rows as they are.

    The rows pass through the scoring step itself, so nothing is joined or shuffled.
    """
    machine = fit(docs, labels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        judge = Judge(machine) if machine else None
        for batch in batches:
            if judge:
                good = machine.probability(judge.decisions(strings(batch))) < threshold
                batch = batch.filter(pa.array(good))
            yield dict(zip(batch.schema.names, batch.columns))

    return map_rows(docs, work)
