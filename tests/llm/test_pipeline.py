from collections import Counter

import corpus_pipeline
import pytest
from compare import duck
from test_packing import brute_pieces, check_layout
from test_resemblance import brute_first
from test_secrets import brute_base

import __spark_entry__ as entry_module
from vidmetrics.llm import toxicity
from vidmetrics.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """(name, rows in, rows out, columns out) of each stage."""
    docs = corpus_pipeline.table(spark, SMALL, "documents")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.saved(stage(spark, docs, SMALL), name)
        out.append((name, docs.collect(), made.collect(), made.columns))
        docs = made
    return out


def test_registered():
    names = set(entry_module.queries())
    assert {"pipeline", *QUERIES} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES) and "pipeline" not in entry_module.oracle_sql()


def test_stages_keep_the_columns(stages):
    assert [s[0] for s in stages] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    for _, _, _, columns in stages[:-1]:
        assert columns == COLUMNS


def test_toxicity_stage(spark, stages):
    _, rows, kept, _ = stages[0]
    docs = corpus_pipeline.table(spark, SMALL, "documents")
    machine = toxicity.fit(docs, corpus_pipeline.table(spark, SMALL, "labels"))
    judge = toxicity.Judge(machine)
    good = [r for r in rows if machine.probability(judge.decisions([r.text or ""]))[0] < 0.3]
    assert Counter(map(tuple, kept)) == Counter(map(tuple, good))


def test_near_duplicate_stage(stages):
    _, rows, kept, _ = stages[1]
    first = set(brute_first({r.doc_id: r.text for r in rows}).values())
    assert Counter(map(tuple, kept)) == Counter(tuple(r) for r in rows if r.doc_id in first)
    assert len(kept) < len(rows)


def test_decontamination_stage(stages):
    _, rows, kept, _ = stages[2]
    leaked = {r[0] for r in duck(SMALL).execute(ORACLES["op1_template_leaks"]).fetchall()}
    assert Counter(map(tuple, kept)) == Counter(tuple(r) for r in rows if r.doc_id not in leaked)
    assert len(kept) < len(rows)


def test_secret_stage(stages):
    _, rows, masked, _ = stages[3]
    by_id = {r.doc_id: r for r in masked}
    assert len(by_id) == len(rows)
    for r in rows:
        if brute_base(r.text):
            assert not brute_base(by_id[r.doc_id].text) and by_id[r.doc_id].n_chars == len(by_id[r.doc_id].text)
        else:
            assert tuple(by_id[r.doc_id]) == tuple(r)


def test_packing_stage(stages):
    _, rows, pieces, _ = stages[4]
    want = brute_pieces([(r.doc_id, r.text) for r in rows], 2048)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    check_layout(pieces, 2048)


def test_run_and_edges(spark, tmp_path):
    frames = {
        "documents": spark.createDataFrame(
            [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "gut " * 20_000, "de", "s", 80_000), (4, "token=abcdefgh " * 3, None, "s", 1), (None, "ohne id", None, None, None), (5, "token=abcdefgh " * 3, None, "s", 1)],
            "doc_id long, text string, lang string, source string, n_chars long",
        ),
        "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, None)], "item_id long, text string"),
    }
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {1, 3, 4, None}
    check_layout(rows, 2048)
    spark.createDataFrame([], frames["documents"].schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
