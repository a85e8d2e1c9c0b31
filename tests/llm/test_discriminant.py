import zlib

import numpy as np
import pytest

from vidmetrics.llm import discriminant
from vidmetrics.llm.queries import op6_quadratic_quality

SMALL = "/root/testdata/sf0.1"


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    y = np.array(labels)[:]
    return (rank[y == 1].mean() - rank[y == 0].mean()) / len(y) + 0.5


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = op6_quadratic_quality(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    test = [r for r in rows if r.held_out and r.doc_id in labels]
    truth = [labels[r.doc_id] for r in test]
    assert auc([r.score for r in test], truth) > 0.93
    assert np.mean([r.predicted == y for r, y in zip(test, truth)]) > 0.93
    bad = [r.predicted for r, y in zip(test, truth) if y == 0]
    assert np.mean(bad) < 0.25


def test_scores_against_plain_densities():
    pick = np.random.default_rng(3)
    size = 4
    rows = {k: pick.normal(k, 1 + k, (200, size)) @ pick.normal(size=(size, size)) for k in (0, 1)}
    sums = {k: (len(x), x.sum(0), x.T @ x) for k, x in rows.items()}
    model = discriminant.fit(sums, pool=0.0, ridge=0.1, temper=1.0)
    pooled = sum(np.cov(x.T, bias=True) * len(x) for x in rows.values()) / 400
    x = pick.normal(size=(50, size))
    density = {}
    for k, own in rows.items():
        lean = size / (200 + size)
        c = (1 - lean) * np.cov(own.T, bias=True) + lean * pooled
        c = 0.9 * c + 0.1 * np.trace(c) / size * np.eye(size)
        d = x - own.mean(0)
        density[k] = np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)) / np.sqrt(np.linalg.det(c))
    assert model.scores(x) == pytest.approx(density[1] / (density[0] + density[1]), abs=1e-6)


def test_edge_cases(spark):
    good = "Ein guter Satz steht hier, und er hat ein Ende. "
    docs = [(i, good * (3 + i % 5) + f"Wort{i}", 0.5, "x") for i in range(40)]
    docs += [(100 + i, f"BAD!! " * (20 + i), 0.5, "x") for i in range(40)]
    docs += [(500, None, None, None), (501, "", None, None), (None, good, None, None), (1, docs[1][1], 0.5, "x"), (502, "lang " * 50_000, 0.1, "x")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, score double, stats string")
    labels = [(i, 1, None) for i in range(40)] + [(100 + i, 0, 1) for i in range(40)] + [(None, 1, 1), (2, None, None), (999, 0, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, text int")
    rows = discriminant.quality_scores(docs, labels).collect()
    assert len(rows) == 85 and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r.predicted for r in rows}
    assert all(by_id[i] == 1 for i in range(40)) and all(by_id[100 + i] == 0 for i in range(40))
    assert discriminant.quality_scores(docs.limit(0), labels).count() == 0
    assert {(r.score, r.predicted) for r in discriminant.quality_scores(docs, labels.limit(0)).collect()} == {(0.5, 1)}
    for label in (0, 1):
        one = labels.filter(f"quality = {label}")
        assert {(r.score, r.predicted) for r in discriminant.quality_scores(docs, one).collect()} == {(label, label)}
