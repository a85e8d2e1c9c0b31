import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vidmetrics.llm import packing
from vidmetrics.llm.queries import op8_complement_packing

SMALL = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def check_layout(rows, capacity):
    """Gapless sequences within the capacity; returns their number."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def brute_pieces(rows, capacity):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    out = []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            out.append((doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return Counter(out)


def test_whole_table_round_trip(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = op8_complement_packing(spark, SMALL).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == brute_pieces(docs, 2048)
    used = check_layout(rows, 2048)
    assert used <= 1.01 * -(-sum(r.length for r in rows) // 2048) + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    pick = random.Random(seed)
    capacity = 40
    lengths = [pick.choice([pick.randint(1, capacity), pick.randint(1, 5), capacity]) for _ in range(pick.choice([1, 7, 400]))]
    counts = np.bincount(lengths, minlength=capacity + 1)
    recipes = packing.plan(counts)
    used = Counter()
    for sizes, times in recipes:
        assert sum(sizes) <= capacity and times > 0
        for size in sizes:
            used[size] += times
    assert used == Counter(lengths)
    assert len(recipes) <= 4 * capacity


def test_plan_fills_exactly():
    counts = np.zeros(11, np.int64)
    counts[[6, 4]] = 5, 5
    assert sum(t for _, t in packing.plan(counts)) == 5
    counts[:] = 0
    counts[[6, 3, 1]] = 7, 7, 7
    assert sum(t for _, t in packing.plan(counts)) == 7
    counts[:] = 0
    counts[[5, 2, 1]] = 3, 6, 3
    assert sum(t for _, t in packing.plan(counts)) == 3
    assert packing.plan(np.zeros(11, np.int64)) == []


def test_edge_cases(spark):
    texts = [
        (1, None), (2, ""), (3, " \t\n"), (4, "Don't <|endoftext|> stop now ΣΑΣ É é ́x"), (5, "wort " * 9000),
        (5, "wort " * 9000), (None, "ohne id"), (7, "　全角 空白 x 12345"),
    ]
    docs = spark.createDataFrame([(i, t, "z", 5) for i, t in texts], "doc_id long, text string, piece string, length int")
    rows = packing.pack(docs, VOCABULARY, capacity=64).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == brute_pieces(texts, 64)
    check_layout(rows, 64)
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0
