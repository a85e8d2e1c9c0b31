import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from vidmetrics.llm import suffixes
from vidmetrics.llm.names import Names, sliding_minimum
from vidmetrics.llm.queries import op3_suffix_repeats

SMALL = "/root/testdata/sf0.01"


def brute(texts, least):
    """Per text: (bytes, removed, spans, hash), from the counts of all strings of ``least`` bytes."""
    seen = Counter(t[i:i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - least + 1):
            if seen[t[i:i + least]] > 1:
                gone[i + 1:i + 1 + least] = True
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        out.append((len(t), int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1])), hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = brute([(d.text or "").encode() for d in docs], 400)
    assert rows_of(op3_suffix_repeats(spark, SMALL)) == Counter((d.doc_id, *w) for d, w in zip(docs, want))


@pytest.mark.parametrize("seed", range(4))
def test_shared_passages_against_brute_force(spark, seed):
    pick = random.Random(seed)
    letters = "abc" if seed == 3 else "abcdefghijklmnopqrstuvwxyz  éü"
    words = lambda n: "".join(pick.choice(letters) for _ in range(n))
    shared = [words(pick.randint(40, 200)) for _ in range(12)]
    texts = ["".join(pick.choice(shared) if pick.random() < 0.5 else words(pick.randint(0, 90)) for _ in range(pick.randint(0, 8))) for _ in range(60)]
    # Stretches just at, over and below the length, repeats within a text, and runs of one letter.
    edge = words(64).encode().decode()
    texts += [words(5) + edge[:63] + "#", edge[:63] + "$" + words(9), edge * 3, "a" * 300, "a" * 65, "ab" * 200, texts[0], texts[1], None, ""]
    ids = [None if i == 3 else i // 2 for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, texts)), "doc_id long, text string, kept string")
    want = brute([(t or "").encode() for t in texts], 64)
    got = suffixes.digest(suffixes.repeats(docs, least=64, batches=5 if seed == 1 else 2))
    assert rows_of(got) == Counter((i, *w) for i, w in zip(ids, want))


def test_names_and_minima():
    pick = random.Random(2)
    data = bytes(pick.choice(b"ab") for _ in range(400))
    names = Names(data)
    starts = np.array([i for i in range(0, 380) for _ in range(3)])
    ends = starts + np.array([8, 11, 20] * 380)
    strings = [data[a:b] for a, b in zip(starts, ends)]
    named = list(zip(*names.of(starts, ends)))
    assert len(set(named)) == len(set(strings)) == len(set(zip(named, strings)))
    again = Names(b"xyz" + data)
    assert list(zip(*again.of(starts + 3, ends + 3))) == named
    x = np.array([pick.getrandbits(64) >> 40 << 40 for _ in range(200)], np.uint64)
    x[50:80] = x[50]
    for width in (1, 7, 200, 201):
        upper = x >> np.uint64(31)
        want = [i + int(np.argmin(upper[i:i + width])) for i in range(len(x) - width + 1)]
        assert sliding_minimum(x, width).tolist() == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.repeats(docs).count() == 0
    with pytest.raises(ValueError):
        suffixes.repeats(docs, least=40)


def test_hot_names_keep_all_their_rows(spark, monkeypatch):
    """A name of most rows, names at the limit, single ones; hot or not, the rows are the same."""
    names = [7] * 500 + [8] * 40 + [9, 9, 10, 11]
    rows = spark.createDataFrame([(i, n, n % 3) for i, n in enumerate(names)], "key long, h1 long, h2 int").repartition(5)
    want = {i for i, n in enumerate(names) if names.count(n) > 1}
    for share in (1e-4, 0.05, 0.5, 1.0):
        monkeypatch.setattr(suffixes, "HOT_SHARE", share)
        got = [r.key for r in suffixes._repeating(rows, "h1", "h2").collect()]
        assert len(got) == len(want) and set(got) == want
