import math
import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from vidmetrics.llm import codebooks
from vidmetrics.llm.queries import op12_adaptive_codebooks

SMALL = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, entries=256, parts=4, rounds=4):
    """Plain Lloyd in whole numbers over rows (vec_id, vector, label)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * c) for c in r[1]]))
    x = np.array([[math.floor(1024 * c) for c in r[1]] for r in rows])
    cut = np.cumsum([len(p) for p in np.array_split(range(x.shape[1]), parts)])[:-1]
    x = np.split(x, cut, axis=1)
    books = [p[:entries].copy() for p in x]

    def nearest(p, book):
        d = np.stack([((p - e) ** 2).sum(1) for e in book], 1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for p, book in zip(x, books):
            at, _ = nearest(p, book)
            for e in set(at.tolist()):
                book[e] = p[at == e].sum(0) // (at == e).sum()
    found = [nearest(p, book) for p, book in zip(x, books)]
    error = sum(d for _, d in found)
    of_label = defaultdict(int)
    for r, e in zip(rows, error):
        of_label[r[2]] += int(e)
    told = sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    codes = ["".join(f"{at[i]:02x}" for at, _ in found) for i in range(len(rows))]
    return sorted(((r[0], c, int(e), of_label[r[2]], told) for r, c, e in zip(rows, codes, error)), key=str)


def ordered(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_table_against_plain_rounds(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert ordered(op12_adaptive_codebooks(spark, SMALL)) == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_bounds_keep_every_entry_and_tie(seed):
    """Rounds on a coarse grid, where ties abound, with lists that grow and shrink."""
    pick = np.random.default_rng(seed)
    x, book = pick.integers(-6, 7, (800, 3)), pick.integers(-6, 7, (40, 3))
    kept, best = codebooks.measured(x, book, 4)
    work = 0
    for b in (4, 9, 2, 5, 40, 1, 0, 3):
        new = book + pick.integers(-1, 2, book.shape) * (pick.random(40) < 0.3)[:, None]
        moves = np.sqrt(((new - book) ** 2).sum(1)) * (1 + 1e-6)
        book = new
        kept, best, _, full = codebooks.updated(x, book, moves, kept, b)
        d = ((x[:, None] - book) ** 2).sum(2)
        assert (kept.entry == d.argmin(1)).all() and (best == d.min(1)).all()
        others = np.ones(d.shape, bool)
        np.put_along_axis(others, np.concatenate([kept.entry[:, None], kept.near], 1).astype(int), False, 1)
        true = np.sqrt(np.take_along_axis(d, kept.near.astype(int), 1))
        assert ((kept.low <= true) | np.isinf(kept.low)).all() and (kept.low[:, 1:] >= kept.low[:, :-1]).all()
        assert (kept.outer <= np.sqrt(np.where(others, d, np.inf).min(1)) + 1e-9).all()
        work += full.sum()
    assert work < 8 * len(x)


def test_settled_entries_need_no_distances():
    pick = np.random.default_rng(1)
    book = pick.integers(-10_000, 10_000, (50, 4))
    x = book[pick.integers(0, 50, 500)] + pick.integers(-5, 6, (500, 4))
    kept, _ = codebooks.measured(x, book, 8)
    _, _, doubt, full = codebooks.updated(x, book + 1, np.full(50, 2.001), kept, 8)
    assert not full.any() and doubt.mean() < 0.1


def test_lists_adapt():
    assert codebooks.adapted(8, 4.0, 0.5) == 16 and codebooks.adapted(20, 4.0, 0.5) == codebooks.MOST
    assert codebooks.adapted(8, 1.0, 0.0) == 4 and codebooks.adapted(8, 3.0, 0.01) == 8 and codebooks.adapted(2, 0.1, 0.0) == 2


def test_edges(spark):
    pick = random.Random(2)
    good = [(i, [pick.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(6)], pick.choice([1, 2, None])) for i in range(60)]
    hot = [(1000 + i, [0.25, 0.0, -0.0, 1.0, 1.0, -0.5], 7) for i in range(40)]
    twice = [good[0], (good[1][0], good[2][1], None), (None, good[3][1], 1)]
    bad = [(300, None, 1), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (302, [math.nan] * 6, 9), (303, [math.inf] * 6, 1), (304, [], 1), (305, [0.0], 1)]
    df = spark.createDataFrame(good + hot + twice + bad, SCHEMA).selectExpr("*", "1 as x", "2 as error", "3 as entry", "'a' as no_label").repartition(5)
    assert ordered(codebooks.vector_codes(df, entries=20)) == brute(good + hot + twice, entries=20)
    assert ordered(codebooks.vector_codes(df)) == brute(good + hot + twice)


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0, 3.0, 4.0]], [[0.5]] * 3])
def test_few_vectors(spark, vectors):
    rows = [(i, v, None) for i, v in enumerate(vectors)]
    got = ordered(codebooks.vector_codes(spark.createDataFrame(rows, SCHEMA)))
    assert got == (brute([r for r in rows if r[1]]) if any(vectors) else [])


def test_numbers_beyond_doubles(spark):
    rows = [(i, [20_000.0 + i, -30_000.0, 1.0, 2.0 * i] * 2, i % 2) for i in range(9)]
    assert ordered(codebooks.vector_codes(spark.createDataFrame(rows, SCHEMA), entries=4)) == brute(rows, entries=4)
