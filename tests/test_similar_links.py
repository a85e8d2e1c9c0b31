import datetime as dt
import random
from collections import Counter

import pytest

from test_operators import SOURCES
from test_similarity import every_pair
from vidmetrics.operators import similar_links, similarity
from vidmetrics.plans.registry import QUERIES


def invented(seed):
    rng = random.Random(seed)
    titles = ["rote kanne", "rote kannen", "extrait rote kanne", "blauer topf", "blaue toepfe", "a", "", None]
    texts = ["gross marke 1", "gross marke 12", "klein marke 1", "ganz anders", "x", "", None]
    start = dt.datetime(2024, 1, 1)

    def at():
        return start + dt.timedelta(milliseconds=rng.choice([0, 1, 3_600_000, rng.randrange(900 * 3_600_000)])) if rng.random() > 0.1 else None

    rows = [(i, None, "X", rng.choice(titles), rng.choice(texts), at(), 60, 1) for i in range(150)]
    return rows + [(None, None, "X", "rote kanne", "gross marke 1", None, 60, 1)] + rows[:5]


@pytest.mark.parametrize("seed, threshold, block", [(1, 0.78, 20_000), (2, 0.74, 3), (3, 0.88, 20_000)])
def test_links_and_groups_equal_all_pairs(spark, monkeypatch, seed, threshold, block):
    monkeypatch.setattr(similar_links, "BLOCK", block)  # blocks of three rows: every title has many parts
    rows = invented(seed)
    sv, once = spark.createDataFrame(rows, SOURCES), spark.createDataFrame(rows[:150], SOURCES)
    pairs = similarity.similar_pairs(every_pair(spark, once), once, threshold=threshold).checkpoint()
    n, title, described = Counter(), Counter(), Counter()
    for r in pairs.collect():
        for x in (r.a_id, r.b_id):
            n[x] += 1
            title[x] += r.title_score
            described[x] += r.description_score
    assert len(n) > 10
    got = similar_links.source_links(sv, threshold=threshold).collect()
    assert sorted(r.id for r in got if r.id is not None) == list(range(150))
    for r in got:
        assert r.n_links == n[r.id]
        if n[r.id]:
            assert abs(r.title_score - title[r.id] / n[r.id]) < 1e-9 and abs(r.description_score - described[r.id] / n[r.id]) < 1e-9
        else:
            assert r.title_score is None and r.description_score is None
    want = {r.id: r.component for r in similarity.components(once.select("id"), pairs).collect()} | {None: None}
    groups = similar_links.similar_groups(sv, threshold=threshold).collect()
    assert {r.id: r.component for r in groups} == want and len(groups) == len(rows)


def test_copies_cost_rows_and_not_pairs(spark):
    """As pairs these 20 000 sources of two texts would be some 200 million rows."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, None, "X", "rote kanne" if i % 2 else "rote kannen", "gross marke 1", start + dt.timedelta(minutes=i), 60, 1) for i in range(20_000)]
    sv = spark.createDataFrame(rows, SOURCES)
    got = similar_links.source_links(sv)
    assert {(r.class_id, r.n_links) for r in got.collect()} == {(0, 19_999), (1, 19_999)}
    assert [r.component for r in similar_links.similar_groups(sv).select("component").distinct().collect()] == [0]


def test_queries_have_a_row_per_source(fixtures):
    assert QUERIES["similar_counts"](fixtures).columns == ["id", "class_id", "n_links", "title_score", "description_score"]
    assert QUERIES["similar_counts"](fixtures).count() == 200


def test_query_returns_the_pairs(fixtures):
    rows = QUERIES["similar_pairs"](fixtures)
    assert rows.columns == ["a_id", "b_id", "title_score", "description_score", "score"]
    got = rows.collect()
    assert len(got) == len({(r.a_id, r.b_id) for r in got}) == 641
    assert all(r.a_id < r.b_id and r.score >= 0.78 for r in got)


@pytest.mark.parametrize("seed, threshold, small", [(1, 0.78, False), (2, 0.74, True), (3, 0.88, False)])
def test_pairs_equal_all_pairs_and_repeat_as_rows_do(spark, monkeypatch, seed, threshold, small):
    if small:  # blocks and chunks of a few rows: every class of more members has many chunks
        for name, value in {"PAIR_BLOCK": 3, "PAIR_GROUP": 5, "CHUNK": 2, "PAIR_TASK": 50}.items():
            monkeypatch.setattr(similar_links, name, value)
    rows = invented(seed)
    # An id of two rows that differ, which is no pair with itself.
    rows.append((7, None, "X", "blauer topf", "klein marke 1", dt.datetime(2024, 1, 2), 60, 1))
    sv = spark.createDataFrame(rows, SOURCES)
    told = [(i, (*r[:3], r[3] or "", r[4] or "", *r[5:])) for i, r in enumerate(rows)]
    apart = spark.createDataFrame([(i, *r[1:]) for i, r in told], SOURCES)
    want = Counter()
    for r in similarity.similar_pairs(every_pair(spark, apart), apart, threshold=threshold).collect():
        a, b = rows[r.a_id][0], rows[r.b_id][0]
        if a is not None and b is not None and a != b:
            want[min(a, b), max(a, b), round(r.title_score, 9), round(r.description_score, 9), round(r.score, 9)] += 1
    got = Counter(
        (r.a_id, r.b_id, round(r.title_score, 9), round(r.description_score, 9), round(r.score, 9))
        for r in similar_links.linked_pairs(sv, threshold=threshold).collect()
    )
    assert got == want and max(want.values()) > 1 and len(want) > 100
