import corpus_pipeline
import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from vidmetrics.llm import templates
from vidmetrics.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.01"


def test_query_against_sql(spark):
    query = QUERIES["op1_template_leaks"](spark, SMALL)
    assert compare(query, duck(SMALL), ORACLES["op1_template_leaks"]) is None
    assert query.count() > 10


@pytest.mark.parametrize("text, want", [
    ("Am 3.5 km, dann 12kg.", "am \2 \3 dann \2\3"), ("sagte Anna Maria Meier zu Bob. Carl ging", "sagte \1 \1 \1 zu \1 carl ging"),
    ("A 5 h B | ### x", "a \2 \3 \1   x"), ("10:30 2020-01-02 7km 7kmx", "\2 \2 \2\3 \2kmx"), ("", ""),
])
def test_template_text(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(templates.template_text(F.col("t"))).first()
    assert row[0] == want


def test_window_hashes_are_windows(spark):
    rows = spark.createDataFrame([(list("abcdefgabcdefg"),), (list("abc"),), ([],)], "w array<string>")
    for size in range(1, 9):
        for (words, hashes) in rows.select("w", templates.window_hashes(F.col("w"), size)).collect():
            windows = [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]
            assert len(hashes) == len(windows) and len(set(hashes)) == len(set(windows))


QUESTION = "Tom has 5 apples and he gives 3 apples to his friend Anna. How many of the 5 apples does he keep when Anna eats 2 kg of them"


def test_reparameterised_questions_and_edges(spark):
    changed = QUESTION.replace("5", "17").replace("Anna", "Zoe").replace("2 kg", "9 lb")
    broken = QUESTION.replace("has 5", "has 8").replace("the 5", "the 11")
    filler = "ganz andere worte stehen hier in einer langen reihe ohne jede frage "
    docs = [
        (1, filler + QUESTION + ". " + filler, "x"), (2, changed, "x"), (3, broken, "x"), (4, filler * 3000, "x"), (5, None, None), (6, "", "x"),
        (None, QUESTION, "x"), (7, filler + " ".join(QUESTION.split()[:14]) + filler, None), (8, " ".join(QUESTION.split()[:8]), "x"),
        (9, "one two three", "x"), (10, QUESTION, "x"), (10, QUESTION, "x"), (11, "1 2 3 4 5 6 7 8 9", "x"),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = [(1, QUESTION, 0), (2, "one two three", 0), (3, None, 0), (None, QUESTION, 0), (4, "", 0), (5, "7 7 7 8 9 9 9", 0)]
    items = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r for r in templates.leaks(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (7, 1), (10, 1), (9, 2)}
    assert got[1, 1].n_changed == 0 < got[2, 1].n_changed == 6 and got[2, 1].covered_words == got[1, 1].item_words == 29
    assert got[1, 1].covered_words == 28  # after another word, "Tom" reads as a name
    kept = templates.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [11, 3, 4, 5, 6, 8, None]
    assert templates.leaks(docs.limit(0), items).count() == 0 and templates.leaks(docs, items.limit(0)).count() == 0


def test_passages_in_other_case_and_inside_sentences(spark, tmp_path):
    prose = "In the morning, Anna Berg walked to the große market and bought some bread, cheese and apples for the whole week"
    short = "Water boils at noon"
    docs = [(1, f"so. {prose.upper()} and"), (2, prose.title()), (3, "they said water boils at noon, then left"), (4, f"he wrote {short} there"), (5, "nothing of the kind stands here at all")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, prose), (2, short)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in templates.leaks(docs, items, any_case=True).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 2)}
    assert got[1, 1].covered_words == got[1, 1].item_words == len(prose.split())
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()] == [5]


def test_a_contradicting_slot_takes_only_its_windows(spark, tmp_path):
    item = "a farmer sold 2 apples to his old friend on the first day of the market and later 2 pears to the baker of the small town"
    docs = spark.createDataFrame([(1, item.replace("2 pears", "7 pears")), (2, item.replace("2", "9")), (3, "a farmer sold 4 apples and 5 pears")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in templates.leaks(docs, items, by_window=True).collect()}
    assert set(got) == {1, 2}
    assert (got[1].n_windows, got[1].covered_words, got[1].n_slots) == (12, 22, 0)
    assert (got[2].n_windows, got[2].covered_words, got[2].n_slots, got[2].n_changed) == (22, 27, 2, 2)
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()] == [3]


def test_only_texts_that_met_an_item_with_slots_are_split(spark, monkeypatch):
    items = {1: "plain words without any value at all in them", 2: "a box of 12 apples and other fruit stands here"}
    docs = [(i, f"before {items[1]} behind") for i in range(1, 20)] + [(50, f"so {items[2]} now"), (51, "nothing here")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    keys, of_keys = [], templates.of_keys
    monkeypatch.setattr(templates, "of_keys", lambda rows, ids, *more: keys.append(sorted(r[0] for r in ids.collect())) or of_keys(rows, ids, *more))
    found = templates.leaks(frame, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_slots) for r in found} == {(i, 1, 0) for i in range(1, 20)} | {(50, 2, 1)}
    assert keys == [[50]]
