import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest

from vidmetrics.llm import attention
from vidmetrics.llm.queries import op10_attention_scores

SMALL = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def check_base(docs, rows, folds):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % folds == 0
    counts = Counter(t for i, text in docs if not held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, text in docs:
        found = tokens(text)
        base = sum(log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in found)
        want[i, held(i), len(found), sum(counts[t] > 0 for t in found), n, round(base, 4)] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows)
    assert got == want


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = op10_attention_scores(spark, SMALL).collect()
    check_base(docs, rows, 10)
    assert all(r.score < 0 for r in rows)
    # Attention knows more than the shares of the subwords alone.
    with open(RANKS, "rb") as f:
        subwords = attention.Subwords(f.read(), public_tokenizers.PATTERN)
    coded = {i: subwords.text((t or "").encode()).astype(int) for i, t in docs}
    held = {r.doc_id: r.score for r in rows if r.held_out}
    counts = np.bincount(np.concatenate([c for i, c in coded.items() if i not in held]), minlength=subwords.size) + 0.05
    unigram = sum(np.log10(counts[coded[i]] / counts.sum()).sum() for i in held)
    ids = sum(len(coded[i]) for i in held)
    print("held out, log10 a subword:", sum(held.values()) / ids, "unigrams:", unigram / ids)
    assert sum(held.values()) > 0.97 * unigram


def plain_log_probability(w, ranks, ids):
    """Log probability of each id (by rank) of a text shorter than a window, place by place."""
    out, seen = [], [ranks.none, *ids[:-1]]
    h = np.array([w["seen"][ranks.class_of[c]] + w["known"][ranks.row_of[c]] + w["place"][i] for i, c in enumerate(seen)], np.float64)
    log_softmax = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
    for i, target in enumerate(ids):
        q = h[i] @ w["q"]
        s = np.array([q @ (h[j] @ w["k"]) for j in range(i + 1)]) / attention.WIDTH ** 0.5
        a = np.exp(s - s.max())
        g = sum(x * (h[j] @ w["v"]) for j, x in enumerate(a / a.sum()))
        f = np.concatenate([h[i], np.tanh(g @ w["mix"])])
        mine = ranks.class_of[target]
        members = [r for r in range(ranks.none) if ranks.class_of[r] == mine]
        inner = np.array([ranks.log_share[r] + (f @ w["own"][ranks.row_of[r]] if r < ranks.seen else 0) for r in members])
        out.append(log_softmax(f @ w["out"] + w["bias"])[mine] + log_softmax(inner)[members.index(target)])
    return np.array(out)


def small_model(seed=0, ids=500):
    """Counts with a long tail, so that classes are cut and hashed rows are shared, and ids that never occur."""
    pick = np.random.default_rng(seed)
    ranks = attention.ranks_of(np.where(np.arange(ids) < 300, pick.integers(0, 50_000, ids), np.arange(ids) % 5 > 0).astype(float))
    w = {k: v + pick.normal(size=v.shape).astype(np.float32) * np.float32(0.1) for k, v in attention.first_weights(ranks).items()}
    return attention.Model(ranks, w)


def test_short_text_against_plain_attention():
    model = small_model(ids=3000)
    assert attention.ROWS < model.ranks.seen < 2700
    ids = np.random.default_rng(1).integers(0, 3000, 40)
    want = plain_log_probability(model.weights, model.ranks, model.ranks.rank_of[ids].tolist()).sum() / np.log(10)
    assert attention.log10_texts(model, [ids, ids[:1]])[0] == pytest.approx(want, abs=1e-3)


def test_classes_are_runs_of_ranks_with_distinct_rows():
    ranks = small_model(ids=3000).ranks
    assert sorted(ranks.rank_of) == list(range(3000)) and ranks.start[0] == 0 and ranks.start[-1] == 3000
    for c, (first, end) in enumerate(zip(ranks.start, ranks.start[1:])):
        assert 0 < end - first <= (attention.MEMBERS if first < ranks.seen else 3000) and set(ranks.class_of[first:end]) == {c}
        assert len(set(ranks.row_of[first:end])) == end - first
        assert (end <= ranks.seen) or (first == ranks.seen and end == 3000)
        assert np.exp(ranks.log_share[first:end]).sum() == pytest.approx(1, abs=1e-4)
    assert np.exp(ranks.log_class).sum() == pytest.approx(1, abs=1e-4)


def test_words_coded_together_equal_words_coded_alone():
    with open(RANKS, "rb") as f:
        subwords = attention.Subwords(f.read(), public_tokenizers.PATTERN)
    words = [w.encode() for w in ("a", "it's", "x\xa0", "\xa0\u3000", "né", "12ab", "...", "\x1d", "\x85y", "全角", "<|endoftext|>", "z")]
    coded = subwords.of(words)
    for k, w in enumerate(words):
        alone = subwords.coder.encode_ordinary(" " + w.decode())
        assert coded.ids[coded.start[k]:coded.start[k] + coded.size[k]].tolist() == alone
    assert coded.text(np.array([3, 0, 3]), 7).tolist() == [*coded.text(np.array([3]), 0)[:-1], *coded.text(np.array([0]), 0)[:-1], *coded.text(np.array([3]), 7)]
    assert coded.text(np.zeros(0, np.int64), 7).tolist() == [7]


@pytest.mark.parametrize("n", [1, 2, 47, 48, 49, 59, 60, 61, 83, 84, 85, 120, 121, 1000])
def test_each_id_is_scored_once_with_context(n):
    ids = np.arange(n) % 64
    x, y, counts = attention.windows_of(ids, 64)
    assert counts.sum() == n
    assert np.array_equal(np.sort(y[counts]), np.sort(ids))
    for row in range(1, len(x)):
        assert not counts[row, : attention.CONTEXT].any()
    _, y, counts = attention.windows_of(ids, 64, context=0)
    assert np.array_equal(y[counts], ids)


def test_probabilities_sum_to_one():
    model = small_model(3)
    ranks = model.ranks
    m = attention.forward(model.weights, ranks, np.array([[ranks.none, *range(attention.WINDOW - 1)]]))
    log_softmax = lambda z: z - np.log(np.exp(z).sum(1, keepdims=True))
    inner = [log_softmax(attention.within(model.weights, ranks, m["f"][0], a, b)[0]) for a, b in zip(ranks.start, ranks.start[1:]) if a < ranks.seen]
    inner.append(np.tile(ranks.log_share[ranks.seen:], (attention.WINDOW, 1)))
    each = np.exp(log_softmax(m["z"][0])[:, ranks.class_of[:-1]] + np.concatenate(inner, axis=1))
    assert each.shape == (attention.WINDOW, 500) and each.sum(1) == pytest.approx(np.ones(attention.WINDOW), abs=1e-3)


def test_ids_of_one_class_are_told_apart_by_the_text_before():
    """Two ids of equal count, so of one class, that always follow different words: counts alone give each a half."""
    pick = np.random.default_rng(6)
    text = np.concatenate([[a, a + 2] for a in pick.integers(0, 2, 40_000)])
    ranks = attention.ranks_of(np.concatenate([np.full(4, 2000.0), np.zeros(300)]))
    ranks = attention.replace(ranks, class_of=np.append(np.zeros(304, np.int64), 1), start=np.array([0, 304]), log_class=np.zeros(1, np.float32),
                              log_share=np.log(np.full(304, 1 / 304)).astype(np.float32), seen=304)
    w = attention.first_weights(ranks)
    x, y, c = attention.windows_of(text, ranks.none)
    for turn in range(3):
        w = attention.learn(w, ranks, x, y, c, rate=0.03, seed=turn)
    # A pair has one bit, its first id; the second follows from it. Without sight a pair of known ids has two.
    assert attention.gradients(w, ranks, x, y, c)[1] < 0.45


def test_gradients_against_differences():
    model = small_model(2)
    ranks = attention.replace(model.ranks, log_share=model.ranks.log_share.astype(np.float64))
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    pick = np.random.default_rng(4)
    x, y, c = attention.windows_of(pick.integers(0, 500, 100), ranks.none)
    g, _ = attention.gradients(w, ranks, x, y, c)
    for name in w:
        moving = [tuple(a) for a in np.argwhere(g[name])]
        for at in [moving[i] for i in pick.integers(0, len(moving), 6)]:
            moved = []
            for d in (1e-4, -1e-4):
                v = {k: a.copy() for k, a in w.items()}
                v[name][at] += d
                moved.append(attention.gradients(v, ranks, x, y, c)[1])
            assert g[name][at] == pytest.approx((moved[0] - moved[1]) / 2e-4, abs=2e-5)


def test_learning_lowers_the_loss():
    pick = np.random.default_rng(5)
    text = np.concatenate([[a, (a * 7 + 3) % 64] for a in pick.integers(0, 64, 6000)])
    ranks = attention.ranks_of(np.ones(64))
    x, y, c = attention.windows_of(text, ranks.none)
    w = attention.first_weights(ranks)
    before = attention.gradients(w, ranks, x, y, c)[1]
    for turn in range(4):
        w = attention.learn(w, ranks, x, y, c, rate=0.03, seed=turn)
    assert attention.gradients(w, ranks, x, y, c)[1] < before - 0.5


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "Ä É ABC abc \t\n x"), (4, "wort " * 30_000), (5, "gleich"), (5, "gleich"), (None, "ohne id"), (10, "neu 全角 <|endoftext|>")]
    frame = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, score int, word string")
    rows = attention.text_scores(frame, RANKS, public_tokenizers.PATTERN, folds=3).collect()
    check_base(docs, rows, 3)
    assert all(np.isfinite(r.score) for r in rows)
    assert attention.text_scores(frame.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_without_training_texts_the_counts_alone_score(spark):
    """One fold, held out: nothing is learned, and texts score as unigrams of equal counts do, whatever their order."""
    frame = spark.createDataFrame([(1, "a b c"), (2, "c b a"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in attention.text_scores(frame, RANKS, public_tokenizers.PATTERN, folds=1).collect()}
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in rows.values())
    assert rows[1].score == pytest.approx(rows[2].score, abs=1e-4)


def test_mixture_of_words_place_by_place():
    model = small_model(8)
    pick = np.random.default_rng(9)
    texts = [pick.integers(0, 500, n) for n in (1, 7, 130)]
    sizes = [np.array([1]), np.array([2, 4, 1]), np.array([60, 1, 68, 1])]
    counted = [np.array([-2.0]), np.array([-np.inf, -3.0, -1.0]), np.array([-5.0, -np.inf, -300.0, -2.0])]
    got = attention.log10_texts(model, texts, list(zip(sizes, counted)))
    for ids, size, by_count, value in zip(texts, sizes, counted, got):
        x, y, c = attention.windows_of(model.ranks.rank_of[ids], model.ranks.none)
        each = attention.log_likelihoods(model.weights, model.ranks, x, y, c).astype(float)
        spelled = [part.sum() for part in np.split(each, np.cumsum(size)[:-1])]
        by_share = [sum(np.logaddexp(np.log(s) + a, np.log(1 - s) + b) for a, b in zip(spelled, by_count)) for s in attention.SHARES]
        want = max(by_share) + np.log(np.mean(np.exp(np.array(by_share) - max(by_share))))
        assert value == pytest.approx(want / np.log(10), rel=1e-5)


def test_no_words_ids_begin_another_words():
    with open(RANKS, "rb") as f:
        units = attention.Units(attention.Subwords(f.read(), public_tokenizers.PATTERN))
    words = [b"a", b"ab", b"abc", b"wort", b"worthing", "x\xa0".encode(), b"..."]
    coded = units.of(words)
    ids = [coded.ids[s:s + n].tolist() for s, n in zip(coded.start, coded.size)]
    assert all(a == b or a != b[:len(a)] for a in ids for b in ids)
    assert units.text(b" Wort  ab").tolist() == [*ids[3], *ids[1], units.end]


def test_held_out_scores_in_many_partitions_are_not_far_below_the_base(spark):
    """A task sees a few texts only here; words are of several subwords, and nothing but their counts is to be known."""
    pick = np.random.default_rng(10)
    syllables = [a + b for a in ("kr", "zu", "mo", "fl", "pe", "wa") for b in ("ix", "ong", "arb", "el", "und", "isch")]
    words = ["".join(pick.choice(syllables, 4)) for _ in range(200)]
    share = 1 / np.arange(1, 201)
    docs = [(i, " ".join(pick.choice(words, 60, p=share / share.sum()))) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(40)
    held = [r for r in attention.text_scores(frame, RANKS, public_tokenizers.PATTERN).collect() if r.held_out]
    assert len(held) > 20 and all(np.isfinite(r.score) for r in held)
    assert sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held)
