"""Language-model scoring with a small causal self-attention model, trained in numpy on subword ids.

Words are spelled in subwords, the last of which has an id that ends the word. So no word's ids begin another's, and
the product of their probabilities is one of the word. The score mixes it with the word's smoothed count: with share s,
p(word | before) = s p(ids | before) + (1 - s) p(word). A word that no training text holds has the first part only. A text's
probability is the mean over ``SHARES``, so a text picks the share that fits it.

The model reads and predicts subword ids, numbered by falling corpus count (ranks). What is read is a vector of
the id's class plus one of the id itself, a hashed row. The output has two steps that both see the text before:
p(id | before) = p(class | before) p(id | class, before); classes are runs of ranks of about equal mass and at
most ``MEMBERS`` ids. Ids that no training text holds are one class more and equally likely in it. Without
learning both steps give the smoothed counts. A text is cut into windows that
overlap: each window scores only the ids behind its first ``context`` ids, which give it sight, so each id is
scored once. Windows run in batches under one causal mask.

Spark counts words, deals training windows and averages the weights that the tasks learn side by side. For
scoring, each task's texts become a segment: its distinct words, numbered, and its texts as numbers. Corpus
counts join the words of a segment, not its running text, and meet the texts again by segment.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vidmetrics.llm.common import column, fold_of, id_and_text, map_arrow, saved, utf8

#: Bytes of text of a segment, unless a single text is longer.
SEGMENT_BYTES = 8 << 20
WIDTH, WINDOW, CONTEXT = 16, 48, 12
#: Classes of equal mass before long ones are cut, most ids of a class, hashed rows of ids.
CLASSES, MEMBERS, ROWS = 64, 512, 1024
#: Shares of the attention in the probability of a word.
SHARES = (0.95, 0.75, 0.5, 0.25, 0.05)
#: Training words of a task that learns, at least: a task that sees a few windows only would hold the average near the first weights.
WORDS_PER_TASK = 1_000_000
#: Logits beyond this are held there while texts are scored, so that no sum overflows.
CEILING = np.float32(60)


class Coded:
    """Subword ids of many words, end to end: word k has ``ids[start[k]:start[k] + size[k]]``."""

    def __init__(self, ids: np.ndarray, size: np.ndarray):
        self.ids, self.size, self.start = ids, size, np.cumsum(size) - size

    def text(self, words: np.ndarray, end: int) -> np.ndarray:
        """Ids of a text of these words, the end id last."""
        size = self.size[words]
        at = np.repeat(self.start[words] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.append(self.ids[at], np.int32(end))


class Subwords:
    """Ids of words by a byte-level vocabulary; a word is coded with the space before it."""

    def __init__(self, ranks_text: bytes, pattern: str):
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_text.splitlines() if line)}
        self.size = max(ranks.values()) + 2
        self.end = self.size - 1  # one more id ends a text
        self.line_end = ranks[b"\n"]
        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def of(self, words: list[bytes]) -> Coded:
        """All words in one call, a line each: no word holds a line end, and words whose own white space
        could join it are coded by themselves."""
        texts = [w.decode() for w in words]
        odd = [i for i, t in enumerate(texts) if not t.isascii() and not t.isprintable()]
        apart = {i: np.array(self.coder.encode_ordinary(" " + texts[i]), np.int32) for i in odd}
        for i in odd:
            texts[i] = "x"
        flat = np.array(self.coder.encode_ordinary("".join([f" {t}\n" for t in texts])), np.int32)
        ends = np.flatnonzero(flat == self.line_end)
        size = np.diff(np.concatenate(([-1], ends))) - 1
        ids = flat[flat != self.line_end]
        if odd:
            parts = np.split(ids, np.cumsum(size)[:-1])
            for i, own in apart.items():
                parts[i] = own
            ids, size = np.concatenate(parts), np.array([len(p) for p in parts])
        return Coded(ids, size)

    def text(self, text: bytes) -> np.ndarray:
        """Ids of a text, the end id last."""
        words = words_of(text)
        return np.append(self.of(words).ids if words else np.zeros(0, np.int32), np.int32(self.end))


class Units:
    """Ids of words: their subwords' ids, the last of a word being another one, which ends it."""

    def __init__(self, subwords: Subwords):
        self.subwords, self.end = subwords, 2 * subwords.size
        self.size = self.end + 1

    def of(self, words: list[bytes]) -> Coded:
        coded = self.subwords.of(words)
        coded.ids[coded.start + coded.size - 1] += self.subwords.size
        return coded

    def text(self, text: bytes) -> np.ndarray:
        """Ids of a text, the end id last."""
        words = words_of(text)
        return np.append(self.of(words).ids if words else np.zeros(0, np.int32), np.int32(self.end))


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered."""
    return text.lower().split()


@dataclass(frozen=True)
class Ranks:
    """Ids by falling count. By rank: ``class_of`` and ``row_of``, with one entry more for what stands before a
    text, and ``log_share``, log p(id | class) by counts. ``start``: first rank of each class, and their end.
    ``seen``: first rank that no training text holds."""

    rank_of: np.ndarray
    class_of: np.ndarray
    row_of: np.ndarray
    log_share: np.ndarray
    start: np.ndarray
    log_class: np.ndarray
    seen: int

    @property
    def none(self) -> int:
        """What stands before a text."""
        return len(self.log_share)


@dataclass(frozen=True)
class Model:
    """The ids' ranks and classes; weights of the attention by name."""

    ranks: Ranks
    weights: dict[str, np.ndarray]


def ranks_of(counts: np.ndarray, *, smooth: float = 0.05) -> Ranks:
    """Classes of about equal mass, cut where they have more than ``MEMBERS`` ids, and one of the ids without a count.
    The ids of a class have neighbouring ranks, so their hashed rows are a run of rows, but for the last class, which has no use of rows."""
    n, seen = len(counts), int((counts > 0).sum())
    order = np.argsort(-counts, kind="stable")
    rank_of = np.empty(n, np.int64)
    rank_of[order] = np.arange(n)
    mass = counts[order] + smooth
    band = ((np.cumsum(mass) - mass / 2) / mass.sum() * CLASSES).astype(np.int64)
    band[seen:] = CLASSES
    first = np.flatnonzero(np.diff(band, prepend=-1))
    lengths = np.diff(np.append(first, n))
    inside = np.arange(n) - np.repeat(first, lengths)
    cut = (inside == 0) | (((inside % MEMBERS == 0) | (np.arange(n) % ROWS == 0)) & (band < CLASSES))
    start = np.append(np.flatnonzero(cut), n)
    class_of = np.cumsum(cut) - 1
    total = np.add.reduceat(mass, start[:-1])
    return Ranks(
        rank_of, np.append(class_of, len(total)), np.append(np.arange(n) % ROWS, ROWS), np.log(mass / total[class_of]).astype(np.float32),
        start, np.log(total / total.sum()).astype(np.float32), seen,
    )


def first_weights(ranks: Ranks, seed: int = 7) -> dict[str, np.ndarray]:
    """``seen`` and ``known``: vectors of read classes and ids; ``out`` and ``own``: output of classes and ids, which
    begins with the counts."""
    pick, n = np.random.default_rng(seed), len(ranks.log_class)
    made = lambda *shape: (pick.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    return {
        "seen": made(n + 1, WIDTH) * 3, "known": made(ROWS + 1, WIDTH) * 3, "place": made(WINDOW, WIDTH), "q": made(WIDTH, WIDTH), "k": made(WIDTH, WIDTH),
        "v": made(WIDTH, WIDTH), "mix": made(WIDTH, WIDTH), "out": np.zeros((2 * WIDTH, n), np.float32), "bias": ranks.log_class.copy(),
        "own": np.zeros((ROWS, 2 * WIDTH), np.float32),
    }


def counts_only(model: Model) -> Model:
    """The model whose output ignores the text before it."""
    w = model.weights
    return replace(model, weights={**w, "out": np.zeros_like(w["out"]), "own": np.zeros_like(w["own"]), "bias": model.ranks.log_class.copy()})


def windows_of(ids: np.ndarray, none: int, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(input ids, target ids, whether the target counts) of a text's windows, by rank.

    The input of a target is the id before it; ``none`` stands before the first. A window begins
    ``context`` ids before the ids that it scores; without a context windows only touch.
    """
    n, step = len(ids), WINDOW - context
    before = np.concatenate(([none], ids[:-1]))
    first = np.array([0, *range(step, max(n - context, 0), step)], np.int64) if n > WINDOW else np.zeros(1, np.int64)
    at = first[:, None] + np.arange(WINDOW)
    real = at < n
    at = np.minimum(at, n - 1)
    counts = real & ((np.arange(WINDOW) >= context) | (first == 0)[:, None])
    return np.where(real, before[at], none), ids[at], counts


_PAST = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def forward(w: dict[str, np.ndarray], ranks: Ranks, x: np.ndarray) -> dict[str, np.ndarray]:
    """Logits of the classes at every place of a batch of windows, and what the way back needs.

    The output sees the id just before and what attention gathers from all before it.
    """
    h = w["seen"][ranks.class_of[x]] + w["known"][ranks.row_of[x]] + w["place"]
    q, k, v = h @ w["q"], h @ w["k"], h @ w["v"]
    a = q @ k.transpose(0, 2, 1)
    a *= np.float32(WIDTH ** -0.5)
    np.exp(np.minimum(a, CEILING, out=a), out=a)
    a *= _PAST
    a /= a.sum(2, keepdims=True)
    g = a @ v
    t = np.tanh(g @ w["mix"])
    f = np.concatenate([h, t], axis=2)
    z = f.reshape(-1, 2 * WIDTH) @ w["out"]
    z += w["bias"]
    return {"h": h, "q": q, "k": k, "v": v, "a": a, "g": g, "t": t, "f": f, "z": z.reshape(*x.shape, -1)}


def by_class(ranks: Ranks, y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """(an order of ``y`` by class, and of each class of several ids, seen in training, that has targets: its first
    place in the order, its last, its first rank, the end of its ranks)."""
    c = ranks.class_of[y]
    order = np.argsort(c, kind="stable")
    c = c[order]
    ends = np.flatnonzero(np.diff(c, append=-1)) + 1
    begin = np.append(0, ends)[:-1]
    runs = zip(begin, ends, ranks.start[c[begin]], ranks.start[c[begin] + 1])
    return order, [r for r in runs if r[3] - r[2] > 1 and r[2] < ranks.seen]


def within(w: dict[str, np.ndarray], ranks: Ranks, f: np.ndarray, first: int, end: int) -> tuple[np.ndarray, slice]:
    """(logits of p(id | class, before) of the class with these ranks, a row per row of ``f``; rows of its ids)."""
    rows = slice(first % ROWS, first % ROWS + end - first)
    z = f @ w["own"][rows].T
    z += ranks.log_share[first:end]
    return z, rows


def unseen(ranks: Ranks, y: np.ndarray) -> np.ndarray:
    """What the second step gives to ids that no training text holds; 0 for all others."""
    return np.where(y >= ranks.seen, ranks.log_share[y], np.float32(0))


def pull(z: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of each row's target, gradient of its negative), from logits, which are used up."""
    at = np.arange(len(z)), target
    z -= z.max(1, keepdims=True)
    hit = z[at].copy()
    np.exp(z, out=z)
    total = z.sum(1, keepdims=True)
    z /= total
    z[at] -= 1
    return hit - np.log(total[:, 0]), z


def log_likelihoods(w: dict[str, np.ndarray], ranks: Ranks, x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Both steps without what only learning needs: log probabilities of the targets that count, in order."""
    h = w["seen"][ranks.class_of[x]] + w["known"][ranks.row_of[x]] + w["place"]
    v = np.ones((*x.shape, WIDTH + 1), np.float32)  # the last column sums the attention's weights
    np.matmul(h, w["v"], out=v[:, :, :WIDTH])
    a = (h @ (w["q"] * np.float32(WIDTH ** -0.5))) @ (h @ w["k"]).transpose(0, 2, 1)
    np.exp(np.minimum(a, CEILING, out=a), out=a)
    a *= _PAST
    g = (a @ v)[counts]
    f = np.concatenate([h[counts], np.tanh((g[:, :WIDTH] / g[:, WIDTH:]) @ w["mix"])], axis=1)
    z = f @ w["out"]
    z += w["bias"]
    np.minimum(z, CEILING, out=z)
    y = y[counts]
    hit = z[np.arange(len(z)), ranks.class_of[y]] + unseen(ranks, y)
    hit -= np.log(np.exp(z, out=z).sum(1))
    order, runs = by_class(ranks, y)
    f, y = f[order], y[order]
    for i, j, first, end in runs:
        own, _ = within(w, ranks, f[i:j], first, end)
        np.minimum(own, CEILING, out=own)
        of_target = own[np.arange(j - i), y[i:j] - first]
        hit[order[i:j]] += of_target - np.log(np.exp(own, out=own).sum(1))
    return hit


def gradients(w: dict[str, np.ndarray], ranks: Ranks, x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Mean gradient and loss over the targets that count."""
    m = forward(w, ranks, x)
    n = max(int(counts.sum()), 1)
    b, t = np.nonzero(counts)
    target, f = y[b, t], m["f"][b, t]
    flat = lambda e: e.reshape(-1, e.shape[-1])
    hit, dz = pull(m["z"][b, t], ranks.class_of[target])
    gain = float(hit.sum()) + float(unseen(ranks, target).sum())
    g = {"out": f.T @ dz, "bias": dz.sum(0) / n, "own": np.zeros_like(w["own"])}
    g["out"] /= n
    moved = dz @ w["out"].T
    order, runs = by_class(ranks, target)
    f, target, inner = f[order], target[order], np.zeros_like(moved)
    for i, j, first, end in runs:
        logits, rows = within(w, ranks, f[i:j], first, end)
        hit, dz = pull(logits, target[i:j] - first)
        gain += float(hit.sum())
        g["own"][rows] += dz.T @ f[i:j]
        np.matmul(dz, w["own"][rows], out=inner[i:j])
    moved[order] += inner
    g["own"] /= n
    loss = -gain / n
    df = np.zeros_like(m["f"])
    df[b, t] = moved
    df /= n
    dt = df[:, :, WIDTH:] * (1 - m["t"] ** 2)
    g["mix"] = flat(m["g"]).T @ flat(dt)
    dg = dt @ w["mix"].T
    da = dg @ m["v"].transpose(0, 2, 1)
    ds = m["a"] * (da - (da * m["a"]).sum(2, keepdims=True)) * np.float32(WIDTH ** -0.5)
    parts = {"q": ds @ m["k"], "k": ds.transpose(0, 2, 1) @ m["q"], "v": m["a"].transpose(0, 2, 1) @ dg}
    dh = df[:, :, :WIDTH].copy()
    for name, d in parts.items():
        g[name] = flat(m["h"]).T @ flat(d)
        dh += d @ w[name].T
    g["place"] = dh.sum(0)
    for name, read in (("seen", ranks.class_of[x]), ("known", ranks.row_of[x])):
        g[name] = np.zeros_like(w[name])
        order = np.argsort(read, axis=None, kind="stable")
        of = read.ravel()[order]
        begin = np.flatnonzero(np.diff(of, prepend=-1))
        g[name][of[begin]] = np.add.reduceat(flat(dh)[order], begin)
    return g, loss


def learn(w: dict[str, np.ndarray], ranks: Ranks, x: np.ndarray, y: np.ndarray, counts: np.ndarray, *, rate: float, batch: int = 32, seed: int = 1) -> dict[str, np.ndarray]:
    """One pass over the windows with Adam, in shuffled batches, the rate falling to a tenth."""
    w = {k: v.copy() for k, v in w.items()}
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    order = np.random.default_rng(seed).permutation(len(x))
    steps = -(-len(x) // batch)
    for i in range(steps):
        at = order[i * batch:(i + 1) * batch]
        g, _ = gradients(w, ranks, x[at], y[at], counts[at])
        now = rate * (1 - 0.9 * i / steps)
        for k in w:
            mean[k] = 0.9 * mean[k] + 0.1 * g[k]
            square[k] = 0.99 * square[k] + 0.01 * g[k] ** 2
            w[k] -= (now * mean[k] / (1 - 0.9 ** (i + 1)) / (np.sqrt(square[k] / (1 - 0.99 ** (i + 1))) + 1e-6)).astype(np.float32)
    return w


def log10_texts(
    model: Model, texts: list[np.ndarray], words: list[tuple[np.ndarray, np.ndarray]] | None = None, batch: int = 128,
) -> np.ndarray:
    """log10 of the model's probability of each text (ids, the end id last).

    ``words``: of each text the number of ids of its words, and their log probability by counts (-inf: none), the end
    last; the words' probabilities are then mixtures of both."""
    out = np.zeros(len(texts))
    xs, ys, cs, owner = [], [], [], []
    held = 0

    def flush() -> None:
        nonlocal held
        if not xs:
            return
        x, y, c, o = np.concatenate(xs), np.concatenate(ys), np.concatenate(cs), np.array(owner)
        # Windows follow the texts and score each id once, so these are the ids of the texts, end to end.
        got = np.concatenate([
            log_likelihoods(model.weights, model.ranks, x[i:i + batch], y[i:i + batch], c[i:i + batch]) for i in range(0, len(x), batch)
        ]).astype(np.float64)
        if words is None:
            parts = np.array([len(texts[i]) for i in owner])
            total = np.add.reduceat(got, np.cumsum(parts) - parts)
        else:
            size, counted = (np.concatenate([words[i][k] for i in owner]) for k in (0, 1))
            spelled = np.add.reduceat(got, np.cumsum(size) - size)
            parts = np.array([len(words[i][0]) for i in owner])
            total = np.logaddexp.reduce([
                np.add.reduceat(np.logaddexp(np.log(s) + spelled, np.log1p(-s) + counted), np.cumsum(parts) - parts) for s in SHARES
            ]) - np.log(len(SHARES))
        out[o] = total / np.log(10)
        for part in (xs, ys, cs, owner):
            part.clear()
        held = 0

    for i, ids in enumerate(texts):
        x, y, c = windows_of(model.ranks.rank_of[ids], model.ranks.none)
        xs.append(x), ys.append(y), cs.append(c), owner.append(i)
        held += len(x)
        if held >= 4096:
            flush()
    flush()
    return out


def _segments(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    """Rows of three kinds: texts (segment, doc_id, learns, z: word numbers), one dictionary per segment
    (segment, words: its words, one a line) and words (segment, number, word, n: times in training texts)."""
    rows = id_and_text(docs).withColumn("learns", fold_of(F.col("doc_id"), folds) != held_out)
    names = ("segment", "doc_id", "learns", "z", "words", "number", "word", "n")

    def made(rows_made: int, **given) -> dict:
        return {c: given.get(c, [None] * rows_made) for c in names}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        press = zstandard.ZstdCompressor(level=1)
        numbers: dict[bytes, int] = {}
        times: list[np.ndarray] = []
        segment, size = uuid.uuid4().int >> 65, 0

        def closed() -> Iterator[dict]:
            n = len(numbers)
            total = np.bincount(np.concatenate(times), minlength=n) if times else np.zeros(n, np.int64)
            yield made(1, segment=[segment], words=[press.compress(b"\n".join(numbers))])
            yield made(n, segment=[segment] * n, number=np.arange(n), word=list(numbers), n=total)

        for batch in batches:
            ids, learns, texts = column(batch, "doc_id").to_pylist(), column(batch, "learns").to_pylist(), utf8(batch)
            at = 0
            while at < len(texts):
                first, packed = at, []
                while at < len(texts) and size < SEGMENT_BYTES:
                    line = np.array([numbers.setdefault(w, len(numbers)) for w in words_of(texts[at])], np.int32)
                    if learns[at]:
                        times.append(line)
                    packed.append(press.compress(line.tobytes()))
                    size += len(texts[at])
                    at += 1
                n = at - first
                yield made(n, segment=[segment] * n, doc_id=pa.array(ids[first:at], pa.int64()), learns=learns[first:at], z=packed)
                if size >= SEGMENT_BYTES:
                    yield from closed()
                    numbers.clear(), times.clear()
                    segment, size = uuid.uuid4().int >> 65, 0
        if numbers:
            yield from closed()

    return map_arrow(
        rows, work, "segment long, doc_id long, learns boolean, z binary, words binary, number int, word binary, n long"
    )


def _subword_counts(counts: DataFrame, coder, end_count: int) -> np.ndarray:
    """How often each subword id occurs in the training texts: from the counts of distinct words."""
    size, make = coder

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        subwords = make()
        total = np.zeros(size, np.int64)
        for batch in batches:
            coded = subwords.of(column(batch, "word").to_pylist())
            total += np.bincount(coded.ids, np.repeat(column(batch, "c").to_numpy(), coded.size), size).astype(np.int64)
        at = np.flatnonzero(total)
        yield {"id": at, "c": total[at]}

    out = np.zeros(size)
    for i, c in map_arrow(counts, work, "id int, c long").groupBy("id").agg(F.sum("c")).collect():  # a vocabulary's ids
        out[i] = c
    out[-1] += end_count
    return out


def _trained(docs: DataFrame, folds: int, held_out: int, model: Model, coder, rounds: int, rate: float, tasks: int) -> Model:
    """Rounds of learning side by side: each task starts from the common weights and passes over its share
    of the training texts, in windows that touch, so each id is learned once a round; their weights are averaged by windows seen, so they depend a little on how rows are
    dealt to tasks, ``tasks`` at most. Where nothing trains, the output ignores the text before it and leaves the counts."""
    _, make = coder
    names = sorted(model.weights)
    rows = id_and_text(docs).filter(fold_of(F.col("doc_id"), folds) != held_out).coalesce(tasks)
    for turn in range(rounds):
        now = model

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            subwords = make()
            weights, seen = now.weights, 0
            parts: list[tuple] = []

            def step() -> None:
                nonlocal weights, seen
                x, y, c = (np.concatenate(p) for p in zip(*parts))
                weights = learn(weights, now.ranks, x, y, c, rate=rate / (1 + turn), seed=turn)
                seen += len(x)
                parts.clear()

            for batch in batches:
                for text in utf8(batch):
                    parts.append(windows_of(now.ranks.rank_of[subwords.text(text)], now.ranks.none, context=0))
                    if sum(len(p[0]) for p in parts) >= 20_000:
                        step()
            if parts:
                step()
            if seen:
                flat = np.concatenate([weights[k].ravel() for k in names]).astype(np.float64)
                yield {"at": np.arange(len(flat) + 1), "v": np.append(flat * seen, seen)}

        summed = map_arrow(rows, work, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # one row a weight
        if not summed:
            return counts_only(model)
        flat = np.zeros(len(summed))
        for r in summed:
            flat[r["at"]] = r["v"]
        flat, made, at = flat[:-1] / flat[-1], {}, 0
        for k in names:
            shape = model.weights[k].shape
            made[k] = flat[at:at + int(np.prod(shape))].reshape(shape).astype(np.float32)
            at += made[k].size
        model = replace(model, weights=made)
    return model


def text_scores(
    docs: DataFrame, ranks_file: str, pattern: str, *, folds: int = 10, held_out: int = 0, rounds: int = 1, rate: float = 0.02,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document row.

    Tokens are the words, A-Z lowered, and an end. base_score: log10 of smoothed unigrams of the training
    texts (those outside the fold; a null id is none of the fold). score: log10 probability of the text
    under the attention model over subwords, mixed word by word with the counts. A null or empty text is the end alone. Counts and attention learn from
    all training texts; without any the score is that of the smoothed counts.
    """
    with open(ranks_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the size of a vocabulary file
    coder = (Units(Subwords(shared.value, pattern)).size, lambda: Units(Subwords(shared.value, pattern)))

    parts = saved(_segments(docs, folds, held_out), "segments")
    texts = parts.filter("z is not null or words is not null").select("segment", "doc_id", "learns", "z", "words")
    words = parts.filter("word is not null").select("segment", "number", "word", "n")
    # One row per word and segment of 8 MB; the rows of a word are as many as there are segments at most.
    of_word = Window.partitionBy("word")
    known = saved(words.select(
        "segment", "number", F.sum("n").over(of_word).alias("c"),
        F.when(F.row_number().over(of_word.orderBy("segment")) == 1, F.col("word")).alias("word"),
    ), "word-counts")
    counts = known.filter("word is not null and c > 0").select("word", "c")
    ends = texts.filter("learns").count()
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + ends, v + (ends > 0)

    ranks = ranks_of(_subword_counts(counts, coder, ends))
    model = Model(ranks, first_weights(ranks))
    model = _trained(docs, folds, held_out, model, coder, rounds, rate, max(1, n // WORDS_PER_TASK))

    known = known.select(F.col("segment").alias("part"), F.col("number").alias("at"), "c")
    make, schema = coder[1], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = [x.split()[0] for x in schema.split(", ")]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        subwords, unpack = make(), zstandard.ZstdDecompressor()
        number = right.column("at").to_numpy()
        c = np.zeros(len(number), np.int64)
        c[number] = right.column("c").to_numpy()
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        held = [unpack.decompress(w) for w in left.column("words").to_pylist() if w is not None]
        coded_words = subwords.of(held[0].split(b"\n")) if held else Coded(np.zeros(0, np.int32), np.zeros(0, np.int64))
        end_base = np.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        by_count = np.append(np.where(c > 0, base, -np.inf), end_base if ends else -np.inf) * np.log(10)
        rows: dict[str, list] = {x: [] for x in names}
        coded, of_words = [], []
        for doc_id, learns, z in zip(*(left.column(x).to_pylist() for x in ("doc_id", "learns", "z"))):
            if z is None:
                continue
            line = np.frombuffer(unpack.decompress(z), np.int32)
            for x, value in zip(names, (
                doc_id, not learns, len(line) + 1, int((c[line] > 0).sum()) + (ends > 0), n, float(base[line].sum() + end_base), 0.0,
            )):
                rows[x].append(value)
            coded.append(coded_words.text(line, subwords.end))
            of_words.append((np.append(coded_words.size[line], 1), np.append(by_count[line], by_count[-1])))
        rows["score"] = log10_texts(model, coded, of_words).tolist()
        return pa.table({x: pa.array(rows[x], type=t) for x, t in zip(names, (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2))})

    return texts.groupBy("segment").cogroup(known.groupBy("part")).applyInArrow(score, schema)
