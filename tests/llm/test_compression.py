import re
from collections import Counter

import pytest
import zstandard

from vidmetrics.llm import compression
from vidmetrics.llm.queries import op2_compression_bands

SMALL = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = op2_compression_bands(spark, SMALL).collect()
    assert len(rows) == len(docs)
    good, bad = [], []
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(docs[r.doc_id])
        assert not (r.base_failed and r.kept)
        if not r.base_failed:
            {1: good, 0: bad}.get(labels.get(r.doc_id), []).append(r.kept)
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.3 * len(bad)


@pytest.mark.parametrize("words, want", [
    ([], 0), (list("abc"), 0), (list("abab"), 0), (list("aaaa"), 4), (list("ababa"), 5), (list("abcxabc"), 6), (list("abcabcz"), 6),
])
def test_repeated_words(words, want):
    assert compression.repeated_words([w.encode() for w in words]) == want


def test_edge_cases(spark):
    import random

    pick = random.Random(1)
    noise = " ".join("".join(chr(pick.randrange(0x4E00, 0x9FFF)) for _ in range(6)) for _ in range(900))
    prose = " ".join("".join(pick.choice("etaoinshrdlu") for _ in range(pick.randint(2, 9))) for _ in range(2500))
    texts = {1: None, 2: "", 3: " \n\n", 4: "a b\na b\n \n\x0c", 5: "gleich " * 40_000, 6: prose + "\n" + "x x\n" * 3, 7: noise}
    docs = spark.createDataFrame(
        [(i, t, True, 0.0) for i, t in texts.items()] + [(None, prose, None, None), (6, texts[6], None, None)],
        "doc_id long, text string, kept boolean, ratio double",
    )
    rows = compression.compression_rules(docs).collect()
    assert len(rows) == 9
    for r in rows:
        text = texts.get(r.doc_id, prose)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text)
        raw = (text or "").encode()
        assert r.ratio == (len(zstandard.ZstdCompressor(level=3).compress(raw)) / len(raw) if raw else None)
    kept = {r.doc_id: r.kept for r in rows}
    assert kept[6] and kept[None] and not any(kept[i] for i in (1, 2, 3, 4, 5, 7))
    left = compression.keep_compressible(docs)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [6, 6]
    assert compression.compression_rules(docs.limit(0)).count() == 0
