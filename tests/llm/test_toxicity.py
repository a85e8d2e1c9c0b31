import zlib
from itertools import combinations

import numpy as np
import pytest

from vidmetrics.llm import toxicity
from vidmetrics.llm.queries import op5_subsequence_toxicity

SMALL = "/root/testdata/sf0.1"


def auc(scores, y):
    rank = np.empty(len(scores))
    rank[np.argsort(scores, kind="stable")] = np.arange(len(scores))
    return (rank[y == 1].mean() - rank[y == 0].mean()) / len(y) + 0.5


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = op5_subsequence_toxicity(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    test = [r for r in rows if r.held_out and r.doc_id in labels]
    y = np.array([labels[r.doc_id] for r in test])
    guess = np.array([r.predicted for r in test])
    print("auc", auc(np.array([r.score for r in test]), y), "recall", guess[y == 1].mean(), "precision", y[guess == 1].mean(), "fpr", guess[y == 0].mean())
    assert auc(np.array([r.score for r in test]), y) > 0.9
    assert guess[y == 1].mean() > 0.75 and guess[y == 0].mean() < 0.05


def brute_kernel(a, b):
    """Sum over common subsequences of the product of their weights, each word scaled by its length."""
    def spread(w):
        found, size = {}, 0
        for p in combinations(range(len(w)), toxicity.ORDER):
            gaps = p[-1] - p[0] + 1 - toxicity.ORDER
            if gaps <= toxicity.GAPS:
                u = "".join(w[i] for i in p)
                found[u] = found.get(u, 0) + toxicity.DECAY ** gaps
                size += toxicity.DECAY ** (2 * gaps)
        return found, size ** 0.5

    (x, nx), (y, ny) = spread(a), spread(b)
    return sum(x[u] * y.get(u, 0) for u in x) / (nx * ny) if x and y else 0.0


def test_kernel_against_all_subsequences():
    words = ["idiot", "idxiot", "iddiot", "banana", "anab", "abc", "worthless", "w0rthless", "achlichkeite"]
    got = toxicity.Kernel(words[:7]).with_landmarks(words)
    want = [[brute_kernel(a, b) for b in words[:7]] for a in words]
    assert got == pytest.approx(np.array(want), abs=1e-5)
    assert got[1, 0] > 0.3 > 0.1 > got[3, 0]  # an inserted letter leaves the word close, another word is far


def test_folded_machine_equals_kernel_expansion():
    texts = [["du", "idiot"], ["so", "ein", "idioot"], ["guten", "morgen"], ["schöner", "abend", "morgen"]]
    machine = toxicity.train(texts, np.array([True, True, False, False]), ["idiot", "morgen", "abend"], rounds=1)
    judge = toxicity.Judge(machine)
    judge.learn({"idiot", "id.iot", "morgen", "xy", "idiotenhaftigkeit"})
    assert judge.known["idiot"] == judge.known["id.iot"] > 0.3 > judge.known["morgen"]
    assert judge.known["xy"] == 0 and judge.known["idiotenhaftigkeit"] > 0.2


def test_sentences():
    assert toxicity.sentences("Ein Satz. Noch\neiner! i d i o t") == [["ein", "satz"], ["noch"], ["einer"], ["i", "d", "i", "o", "t"], ["idiot"]]
    assert toxicity.pieces_of("a" * 13) == ["a" * 12, "a" * 7] and toxicity.pieces_of("--") == [""]
    assert toxicity.sentences("") == []


def test_edge_cases(spark):
    clean, bad = "ein schöner tag heute im garten", "du bist ein dummer idiot heute"
    rows = [(i, f"{clean} {i % 7}. {bad if i % 4 == 0 else clean}.", "x", 1.0) for i in range(400)]
    more = [(1000, None, None, None), (1001, "", "x", 0.0), (1002, bad, "x", 0.0), (1003, "dum.mer idxiot", "x", 1.0), (1004, (clean + ". ") * 5000, "x", 1.0), (None, clean, "x", 1.0), (1005, clean, "x", 1.0), (1005, clean, "x", 1.0)]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, label string, score double")
    marks = [(i, int(i % 4 == 0), None) for i in range(400)] + [(None, 1, 0), (1001, None, 0), (9999, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, text int")
    got = {}
    for r in toxicity.toxicity_scores(docs, labels).collect():
        got.setdefault(r.doc_id, []).append(r.predicted)
    assert sum(map(len, got.values())) == len(rows) + len(more)
    assert got[1002] == [1] and got[1003] == [1] and got[1004] == [0] and got[1005] == [0, 0] and got[None] == [0] and got[1000] == [0] == got[1001]
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) == {i for i, x in got.items() if x[0] == 0} and ids.count(1005) == 2
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()} == {0.0}
