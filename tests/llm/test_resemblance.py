import random

import corpus_pipeline
import pytest

from vidmetrics.llm import resemblance, simhash


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_first(texts, least=0.8):
    """doc_id -> the smallest id that links reach, over all pairs."""
    sets, label = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in texts:
        for b in texts:
            x, y = sets[a], sets[b]
            if a < b and min(len(x), len(y)) >= least * max(len(x), len(y)) and jaccard(x, y) >= least and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if v == high else v for i, v in label.items()}
    return label


def test_near_copies_that_three_bits_miss(spark):
    pick = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [pick.choice(words) for _ in range(300)]
    texts = {1: " ".join(base)}
    for i, changes in enumerate((1, 2, 4, 6, 6, 25, 40), 2):
        own = list(base)
        for at in pick.sample(range(300), changes):
            own[at] = f"x{i}-{at}"
        texts[i] = " ".join(own)
    texts |= {20: None, 21: "", 22: "a b", 23: "A  b", 24: "a c"}
    want = brute_first(texts)
    assert 3 < sum(want[i] == 1 for i in range(1, 9)) < 8
    bits = [(simhash.fingerprint(texts[1].encode(), 3) ^ simhash.fingerprint(texts[i].encode(), 3)).bit_count() for i in range(2, 7)]
    assert max(bits) > 3
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()] + [(None, texts[1], "en")], "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == sorted({*want.values()}) and len(kept) == len({*want.values()}) + 1
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("turns", [0, 4])
def test_whole_table_against_all_pairs(spark, turns):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.component_id for r in resemblance.resembling(docs, turns=turns).collect()}
    assert got == brute_first({r.doc_id: r.text for r in docs.collect()})


def test_trie_links_come_first_and_a_large_group_has_few_links(spark, monkeypatch):
    """The stage's candidates come from the SimHash trie; links of a group of copies are no more than its texts."""
    pick = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [pick.choice(words) for _ in range(150)]
    texts = {}
    for i in range(1, 121):
        own = list(base)
        for at in pick.sample(range(150), 2):
            own[at] = f"x{i}-{at}"
        texts[i] = " ".join(own)
    texts |= {i: " ".join(pick.choice(words) for _ in range(60)) for i in range(200, 220)}
    calls, sizes = [], []
    links, connected = simhash.links, resemblance.connected
    monkeypatch.setattr(simhash, "links", lambda fps, **given: calls.append(given) or links(fps, **given))
    monkeypatch.setattr(resemblance, "connected", lambda edges: sizes.append(edges.count()) or connected(edges))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(brute_first(texts).values()))
    assert calls == [{"errors": 3}]
    assert max(sizes) <= len(texts)


def edited(pick, base, i, changes):
    own = list(base)
    for at in pick.sample(range(len(base)), changes):
        own[at] = f"x{i}-{at}"
    return own


@pytest.mark.parametrize("turns", [0, 4])
def test_a_group_kept_apart_by_its_changes_gives_few_pairs(spark, monkeypatch, turns):
    """Near copies that share bands and are below the threshold with one another: before, each met all others."""
    pick = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    base = [pick.choice(words) for _ in range(150)]
    made = {i: edited(pick, base, i, 5) for i in range(1, 101)}
    made |= {i: edited(pick, base, i, 2) for i in range(101, 121)}
    made |= {i: made[i - 200] + [f"y{i}-{k}" for k in range(12)] for i in range(201, 221)}  # longer copies of copies
    made |= {i: made[i - 300][:-20] for i in range(331, 351)}
    texts = {i: " ".join(t) for i, t in made.items()}
    want = brute_first(texts)
    assert 60 < len(set(want.values())) < 110 and want[205] == 5
    sizes, merged = [], resemblance._merged
    monkeypatch.setattr(resemblance, "_merged", lambda labels, pairs, *given: sizes.append(pairs.distinct().count()) or merged(labels, pairs, *given))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in resemblance.resembling(docs, turns=turns).collect()}
    assert got == want
    assert sizes[-1] <= 3 * len(texts)
