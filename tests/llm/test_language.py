import zlib
from itertools import product

import numpy as np
import pytest

from vidmetrics.llm import language
from vidmetrics.llm.queries import op9_viterbi_language

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op9_viterbi_language(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in docs[r.doc_id].text or ""):
            assert r.lang_pred == "und"
    test = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in test]) > 0.97


@pytest.mark.parametrize("seed", range(30))
def test_best_path_against_all_paths(seed):
    pick = np.random.default_rng(seed)
    s = np.round(pick.normal(0, 2, (6, 3)), 3).astype(np.float32)
    s[:3, 1] += 2 * (seed % 3)

    def worth(path, penalty):
        return sum(float(s[i, k]) for i, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))

    for penalty in (0.5, 2.0, 6.0):
        spans = language.best_path(s, penalty)
        path = [k for a, b, k in spans for _ in range(a, b)]
        assert len(path) == 6 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        assert worth(path, penalty) == pytest.approx(max(worth(p, penalty) for p in product(range(3), repeat=6)))


def test_spans_scripts_and_edges(spark):
    en = "the weather is nice and we went there with them this morning while they were thinking"
    de = "das wetter ist schön und wir gingen gestern mit ihnen dorthin während sie nachdachten"
    ru = "погода хорошая и мы пошли туда вместе с ними этим утром пока они думали"
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate(((en, "en"), (de, "de"), (ru, "ru")) * 12, 1000)]
    mixed = f"{en} {en} {de} {de} 42 !! {ru} {ru}"
    more = [(1, None, "en", None), (2, "", None, None), (3, "12 -- _ 7", "de", None), (4, mixed, None, None), (None, de, None, None), (5, en + " wetter", None, None), (6, "日本語", None, None), (7, (en + " ") * 2000, None, None), (7, de, None, None)]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, spans string")
    model = language.train(docs, folds=5, held_out=0)
    assert model.languages == ("de", "en", "ru")
    got = language.identify(docs.filter("doc_id is null or doc_id < 1000"), model).collect()
    found = {(r.doc_id, r.lang) for r in got}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "de"), (5, "en"), (7, "en"), (7, "de")} <= found and len(got) == 9
    spans = next([(s.first, s.end, s.lang) for s in r.spans] for r in got if r.doc_id == 4)
    assert [s[2] for s in spans] == ["en", "de", "ru"]
    assert spans[0][0] == 0 and spans[-1][1] == len(mixed.split()) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert abs(spans[0][1] - 2 * len(en.split())) <= 1
    assert len(next(r.spans for r in got if r.doc_id == 5)) == 1
    assert language.language_of(docs.limit(0)).count() == 0
    nothing = language.language_of(docs.filter("lang is null")).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and len(nothing) == 7


def test_a_script_rules_languages_out(spark):
    """A foreign word among words of another script is labelled by its script, whatever the penalty asks."""
    en, ru = "the weather is nice and we went there with them", "погода хорошая и мы пошли туда вместе с ними"
    rows = [(i, t, lang) for i, (t, lang) in enumerate(((en, "en"), (ru, "ru")) * 12, 1000)]
    docs = spark.createDataFrame([*rows, (1, f"{en} погода {en} 3 ω {en}", None), (2, f"{ru} weather", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs.filter("doc_id < 1000"), language.train(docs, folds=5, held_out=0)).collect()}
    assert [(s.first, s.end, s.lang) for s in got[1].spans] == [(0, 10, "en"), (10, 11, "ru"), (11, 33, "en")]
    assert [s.lang for s in got[2].spans] == ["ru", "en"] and got[2].lang == "ru"
