"""Documents with further columns whose names clash with one another or with the operators' own."""

import pytest

from vidmetrics.llm import compression, resemblance, secrets, simhash, templates, toxicity

TEXT = "five plain words stand here and then some more of them follow in a row " * 5
ROWS = [(1, TEXT), (2, TEXT), (3, "token=abcdefgh12345 " * 4), (4, None), (None, TEXT), (5, "another text that is not like the others at all, it says"), (5, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr(
        "*", "1 as _key", "2 as _keep", "3 as _id", "4 as _turn", "5 as a", "6 as b", "7 as c", "8 as component_id", "9 as label", "10 as _KEY_",
    )
    return df.toDF(*["a__3" if n == "c" else "a" if n == "b" else n for n in df.columns])


def ids(df):
    return sorted((r[0] for r in df.collect()), key=str)


@pytest.mark.parametrize("keep", [resemblance.one_of_each_group, simhash.one_of_each_group])
def test_one_of_each_group(docs, keep):
    got = keep(docs)
    assert got.columns == docs.columns and ids(got) == [1, 3, 4, 5, None]
    assert [tuple(r) for r in got.collect() if r[0] == 1] == [(1, TEXT, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)]


def test_of_two_rows_with_one_id_the_same_stays(docs):
    for keep in (resemblance.one_of_each_group, simhash.one_of_each_group):
        assert len({[r[1] for r in keep(d).collect() if r[0] == 5][0] for d in (docs, docs.repartition(3), docs.coalesce(1))}) == 1


def test_filters(spark, docs):
    items = spark.createDataFrame([(1, "another text that is not like the others")], "item_id long, text string")
    got = templates.without_leaks(docs, items)
    assert got.columns == docs.columns and ids(got) == [1, 2, 3, 4, None]
    got = compression.keep_compressible(docs)
    assert got.columns == docs.columns and None not in ids(got)


def test_rows_pass_through_python(spark, docs):
    got = secrets.mask_secrets(docs)
    assert got.columns == docs.columns
    rows = {r[0]: tuple(r) for r in got.collect() if r[0] != 5}
    assert rows[1] == (1, TEXT, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10) and "abcdefgh" not in rows[3][1]
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (5, 0)], "doc_id long, toxic int")
    assert toxicity.without_toxic(docs, labels).columns == docs.columns


def test_contradicting_labels_count_as_toxic(spark, docs):
    """The same machine whichever row of a label comes first."""
    labels = [(i, y) for i in (1, 3, 5) for y in (0, 1)] + [(2, 0), (4, 0)]
    made = [toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int").coalesce(1)) for x in (labels, labels[::-1])]
    assert (made[0] is None) == (made[1] is None)


def test_long_logins_are_found(spark):
    url = f"see custom+scheme.{'x' * 40}://{'u' * 400}:{'p' * 500}@host and 9ftp://a:b@h"
    found = secrets.mask_secrets(spark.createDataFrame([(1, url)], "doc_id long, text string")).first().text
    assert "uuu" not in found and "ppp" not in found and "a:b@" not in found
