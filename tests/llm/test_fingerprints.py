import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidmetrics.llm import fingerprints as fp
from vidmetrics.llm.queries import op13_simhash_fingerprints

SMALL = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def number(text):
    lanes = fp.fingerprint((text or "").encode(), fp.WordHashes())
    return int.from_bytes(b"".join(int(x).to_bytes(8, "big") for x in lanes), "big")


def brute(rows, radius=7, every=100):
    """Rows in order of the ids, next documents by index, all pairs for the radius."""
    rows = sorted(rows, key=lambda r: -r[0])
    fps = [number(t) for _, t in rows]
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        other = text[:len(text) - half] + after[:half]
        bits = [(fps[i] ^ x).bit_count() for x in (number(other), fps[(i + 1) % len(rows)])]
        near = sum((fps[i] ^ x).bit_count() <= radius for x in fps) - 1 if doc_id % every == 0 else None
        out[doc_id] = (len(text), sha256(other.encode()).hexdigest(), f"{fps[i]:064x}", f"{number(other):064x}", 1 - bits[0] / 256, 1 - bits[1] / 256, near)
    return out


def got(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_whole_table_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = got(op13_simhash_fingerprints(spark, SMALL))
    assert found == brute(rows)
    edited, following = (np.array([r[i] for r in found.values()]) for i in (4, 5))
    assert (edited > following).mean() > 0.97


def plain(text):
    """Votes of each term, one by one."""
    words = text.lower().split()
    hashes = fp.WordHashes()
    terms, weight = fp.weighted_terms(words, hashes)
    shingles = [tuple(words[i:i + 3]) for i in range(len(words) - 2)] or [tuple(words)]
    counts = Counter(words), Counter(shingles)
    assert sorted(weight) == sorted(w * c.bit_length() for times, w in zip(counts, (1, 2)) for c in times.values())
    total = np.zeros(256)
    for h, w in zip(terms, weight):
        for lane in range(4):
            value = int(fp._mixed(np.array([h + np.uint64((lane + 1) * int(fp._STEP) % (1 << 64))], np.uint64))[0]) if lane else int(h)
            for b in range(64):
                total[64 * lane + b] += w if value >> b & 1 else -w
    return [sum(1 << b for b in range(64) if total[64 * lane + b] > 0) for lane in range(4)]


def test_weighted_votes_one_by_one():
    pick = random.Random(4)
    for size in (1, 2, 3, 50, 700):
        text = " ".join(pick.choice("abcdefghijklmnop") * pick.randint(1, 2) for _ in range(size)).encode()
        assert fp.fingerprint(text, fp.WordHashes()).tolist() == plain(text)


@pytest.mark.parametrize("radius, spare", [(3, 1), (7, 1), (5, 2), (4, 3)])
@pytest.mark.parametrize("few", [True, False])
def test_search_finds_all_within_the_radius(spark, monkeypatch, radius, spare, few):
    monkeypatch.setattr(fp, "BROADCAST_KEYS", 1 << 20 if few else 1)
    pick = random.Random(radius)
    values = [pick.getrandbits(256) for _ in range(20)]
    for _ in range(400):  # chains and clusters, copies among them
        v = pick.choice(values)
        for _ in range(pick.randint(0, 5)):
            v ^= 1 << pick.randrange(256)
        values.append(v)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    lanes = lambda v: [signed(v >> 64 * (3 - i) & (1 << 64) - 1) for i in range(4)]
    index = spark.createDataFrame([lanes(v) for v in values], ", ".join(f"f{i} long" for i in range(4)))
    asked = index.limit(50)
    want = {tuple(lanes(v)): sum((v ^ x).bit_count() <= radius for x in values) for v in values[:50]}
    assert {tuple(r[:4]): r.near for r in fp.within_radius(asked, index, radius=radius, spare=spare).collect()} == want


def test_edges(spark):
    pick = random.Random(8)
    long_ = " ".join(pick.choice("ab cd ef gh".split()) for _ in range(60_000))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "Ä"), (4, "one word"), (5, "One  WORD"), (100, "x" * 30_000), (200, long_), (300, "one word"), (7, "日本語 text 😀😀")]
    rows += [(400 + i, "the same text again and again " * 3) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as z", "2 as part", "3 as f0", "4 as n_chars").repartition(6)
    found = got(fp.document_fingerprints(df))
    assert found == brute(rows)
    assert found[0][2] == "0" * 64 and found[0][6] == 2 and found[400][6] == 29 and found[4][2] == found[300][2]


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e f"), (None, "g h"), (None, None), (None, "g h")]
    found = fp.document_fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert Counter(r.doc_id for r in found) == {1: 3, None: 3} and all(r.n_near is None for r in found)
    again = fp.document_fingerprints(spark.createDataFrame(rows[::-1], SCHEMA).repartition(1)).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))


@pytest.mark.parametrize("rows", [[], [(100, "only one text here")], [(5, "a"), (6, "b")]])
def test_few_rows(spark, rows):
    assert got(fp.document_fingerprints(spark.createDataFrame(rows, SCHEMA))) == (brute(rows) if rows else {})
