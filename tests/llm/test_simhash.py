import random
import tracemalloc
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vidmetrics.llm import simhash
from vidmetrics.llm.common import connected
from vidmetrics.llm.queries import op7_simhash_trie

SMALL = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, label int"


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [words[i:i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """{id: component} for {id: fingerprint}."""
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in fps}


def test_whole_table_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = {i: (f"{fps[i]:016x}", c) for i, c in brute_components(fps).items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op7_simhash_trie(spark, SMALL).collect()}
    assert got == want


def clustered(n, seed):
    """Distinct 64-bit values with dense clusters and chains."""
    pick = random.Random(seed)
    out = set()
    while len(out) < n:
        x = pick.getrandbits(64)
        for _ in range(pick.choice([1, 1, 2, 30])):
            out.add(x)
            for _ in range(pick.randint(1, 5)):
                x ^= 1 << pick.randrange(64)
    return sorted(out)


@pytest.mark.parametrize("split_above", [50_000, 3])
def test_links_of_clusters_and_chains(spark, split_above):
    values = clustered(700, 5) + [0, 1, 3, 7, 15, 31, 63]
    # Many values below one top block, so that it is cut into pairs of nodes.
    values = sorted(set(values) | {v & ((1 << 48) - 1) for v in values[::3]})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), split_above=split_above)
    label = {r.v: r.label for r in connected(found).collect()}
    brute = brute_components(dict(zip(signed, values)))
    ours, theirs = {}, {}
    for v in signed:
        ours.setdefault(label.get(v, v), set()).add(v)
        theirs.setdefault(brute[v], set()).add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_dense_cluster_is_walked_without_all_pairs():
    values = np.array(sorted({(a << 40) ^ b for a in range(2) for b in range(8192)}), dtype=np.uint64)
    label = simhash.trie_links(values, np.zeros(len(values), np.int64), 3, np.full(len(values), 64))
    assert set(label.tolist()) == {0}


def test_walks_are_whole_groups_of_bounded_size():
    group = np.repeat(np.arange(6), [3, 2, 9, 1, 1, 4])
    assert simhash.walks(group, at_once=5) == [(0, 5), (5, 14), (14, 16), (16, 20)]
    assert simhash.walks(group, at_once=1) == [(0, 3), (3, 5), (5, 14), (14, 15), (15, 16), (16, 20)]
    assert simhash.walks(group[:0]) == []


def test_memory_of_a_walk_does_not_follow_the_rows_of_a_task():
    pick = np.random.default_rng(5)
    fps = pick.integers(0, 1 << 63, 60_000).astype(np.uint64)
    fps = np.concatenate([fps, fps ^ (np.uint64(1) << pick.integers(0, 62, len(fps)).astype(np.uint64))])
    group = np.tile(pick.integers(0, 3000, 60_000), 2)
    order = np.lexsort((fps, group))
    fps, group, deep = fps[order], group[order], np.full(len(fps), 64)
    tracemalloc.start()
    found = simhash.group_links(fps, group, 3, deep)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 256 * len(fps)  # the bits alone were 512 bytes an entry
    assert (found == simhash.trie_links(fps, group, 3, deep)).all()
    assert (found != np.arange(len(fps))).sum() == 60_000


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.v, r.label) for r in connected(edges).collect()} == {(i, 0) for i in range(301)}


def test_edge_cases(spark):
    long_text = "wort " * 60_000
    rows = [
        (5, None, None, None, None), (3, "", "en", None, 0), (9, " \n\t", "en", "s", 3), (7, "one two", "en", "s", 7),
        (8, "ONE\ttwo ", "en", "s", 8), (1, long_text, None, "s", 1), (2, long_text, None, "s", 1), (2, long_text, None, "s", 1),
        (None, "one two", None, None, None), (11, "É two", None, None, None), (12, "é two", None, None, None),
    ]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (7, 7), (8, 7), (1, 1), (2, 1), (2, 1), (None, 7), (11, 11), (12, 12)], key=str)
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 11, 12, 3, 7, None]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.one_of_each_group(docs.limit(0)).count() == 0
