import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from vidmetrics.operators import similarity
from test_operators import SOURCES, random_sources


@pytest.mark.parametrize("a, b, want", [
    ("martha", "marhta", 0.9611), ("dixon", "dicksonx", 0.8133), ("dwayne", "duane", 0.84), ("", "", 1.0), ("a", "", 0.0), ("abc", "xyz", 0.0),
])
def test_published_values(a, b, want):
    assert round(similarity.jaro_winkler(a, b), 4) == want


def test_pair_scores_equal_the_formula(spark):
    rows = [r for r in random_sources(3, 30, 500_000) if r[5] is not None]
    sv = spark.createDataFrame(rows, SOURCES)
    ids = [r[0] for r in rows]
    pairs = spark.createDataFrame(list(itertools.combinations(ids, 2)), "a_id long, b_id long")
    got = {(r.a_id, r.b_id): r.score for r in similarity.score_pairs(pairs, sv).collect()}
    by_id = {r[0]: r for r in rows}

    def norm(x):
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (x or "").lower()).split())

    for (i, j), score in got.items():
        a, b = by_id[i], by_id[j]
        d = 0.0 if not norm(a[4]) or not norm(b[4]) else similarity.jaro_winkler(norm(a[4]), norm(b[4]))
        hours = int(abs((a[5] - b[5]).total_seconds()) // 3600)
        want = 0.6 * similarity.jaro_winkler(norm(a[3]), norm(b[3])) + 0.3 * d + (0.1 * (1 - hours / 72) if hours <= 72 else 0)
        assert abs(score - min(1.0, want)) < 1e-9
    assert len(got) == len(ids) * (len(ids) - 1) // 2


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_components_equal_union_find(spark, shape):
    rng = random.Random(4)
    n = 120
    edges = {
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(90)],
        "chain": [(i, i + 1) for i in range(0, n - 1) if i % 40],
        "star": [(50, i) for i in range(0, n, 2)],
    }[shape]
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = similarity.components(spark.range(n), spark.createDataFrame(edges, "a_id long, b_id long"))
    assert {r.id: r.component for r in got.collect()} == {i: root(i) for i in range(n)}
    assert got.select(F.countDistinct("component")).first()[0] == len({root(i) for i in range(n)})


def linked(df):
    return {(r.a_id, r.b_id): round(r.score, 9) for r in df.collect()}


def every_pair(spark, sv):
    ids = sorted(r.id for r in sv.select("id").collect())
    return spark.createDataFrame(list(itertools.combinations(ids, 2)), "a_id long, b_id long")


def test_no_pair_of_all_is_lost(spark, fixtures):
    sv = fixtures.catalog_source
    want = linked(similarity.similar_pairs(every_pair(spark, sv), sv))
    candidates = similarity.candidate_pairs(sv)
    assert len(want) == 641 and linked(similarity.similar_pairs(candidates, sv)) == want
    assert candidates.count() < 0.5 * sv.count() * (sv.count() - 1) / 2


@pytest.mark.parametrize("seed, threshold", [(1, 0.78), (2, 0.74)])
def test_no_pair_of_invented_texts_is_lost(spark, seed, threshold):
    """Lengths from none to very long, letters beyond the signature's depth, changed, swapped and shifted words."""
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)

    def text(size):
        return "".join(rng.choice("eeeeennniiirsstadhulcgmobwfkzpvjyxq 0123") for _ in range(size))

    def changed(t):
        t = list(t)
        for _ in range(rng.randint(0, max(1, len(t) // 4))):
            i = rng.randrange(len(t) + 1)
            t[i:i + rng.randint(0, 2)] = rng.choice(["", "e", "ab", "x", " "])
        return "".join(t)

    base = [text(n) for n in (0, 1, 2, 3, 5, 9, 14, 20, 33, 60, 120, 300)]
    rows = []
    for i in range(120):
        t, d = (changed(rng.choice(base)) for _ in range(2))
        rows.append((i, None, "X", t if rng.random() > 0.05 else None, d if rng.random() > 0.1 else None, start + dt.timedelta(hours=rng.randint(0, 700)) if rng.random() > 0.1 else None, 60, 1))
    sv = spark.createDataFrame(rows, SOURCES)
    want = linked(similarity.similar_pairs(every_pair(spark, sv), sv, threshold=threshold))
    assert len(want) > 10
    assert linked(similarity.similar_pairs(similarity.candidate_pairs(sv, threshold=threshold), sv, threshold=threshold)) == want


def test_titles_that_only_share_letters_meet_in_the_index(spark):
    titles = ["abcdefghij", "bacdefghij", "abcdefghji", "qbcdefghij", "zzzzzzzzzz", "abc", "abd", "a", ""]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    got = {(r.a, r.b) for r in similarity.title_links(df, need=0.8).collect()}
    assert got == {(a, b) for a, b in itertools.permutations(titles, 2) if a < b and similarity.jaro_winkler(a, b) >= 0.8 - 1e-9}


def test_a_hot_title_is_whole(spark):
    rows = [(i, None, "X", f"gleich titel {i % 3}", "text", None, 60, 1) for i in range(60)]
    sv = spark.createDataFrame(rows, SOURCES)
    assert similarity.candidate_pairs(sv).count() == 60 * 59 // 2


def test_thresholds_the_index_does_not_cover(spark, fixtures):
    with pytest.raises(ValueError):
        similarity.candidate_pairs(fixtures.catalog_source, threshold=0.6)
