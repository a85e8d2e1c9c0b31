"""What the corpus operators share: shared-folder tables, Arrow steps, hash folds, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.window import Window

from vidmetrics.session import ensure_checkpoint_dir

ROWS_PER_BATCH = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder of the cluster and read back: lineage ends here, and a
    lost executor costs nothing that was finished."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes tables that ``saved`` wrote and that nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` where ``work`` yields a dict of column values per batch.

    Documents can be long, so batches hold few rows: the session's batch size is lowered if larger.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) <= ROWS_PER_BATCH:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, type=f.type, from_pandas=False)
                 for f, x in ((f, columns[f.name]) for f in arrow)],
                schema=arrow,
            )
        pa.default_memory_pool().release_unused()  # the worker lives on and would keep it beside the next stage's

    return df.mapInArrow(run, kind)


def fresh(names: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as no name of ``names`` has, in any case."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name


def map_rows(docs: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """``map_arrow`` over whole rows of documents, with the same columns out; further columns may share
    names with one another."""
    names = docs.columns
    own: list[str] = []
    for n in names:  # the first of equal names keeps it
        own.append(n if n not in own else fresh([*names, *own], n))
    apart = docs.toDF(*own)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in apart.schema)
    return map_arrow(apart, work, schema).toDF(*names)


#: Keys that may be sent to all executors (8 bytes each, some tens in a hash table).
BROADCAST_KEYS = 1_000_000


def of_keys(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join of ``rows`` with the distinct ``keys`` (key). Up to ``BROADCAST_KEYS`` keys, by
    count, are broadcast, so that texts stay where they are; more are joined through a shuffle."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    other = fresh(rows.columns, "_key")
    keys = keys.select(F.col(key).alias(other))
    return rows.join(F.broadcast(keys) if few else keys, rows[key] == keys[other], how)


def first_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents whose id is the component_id of their group (``groups``: doc_id, component_id), with all columns.

    Rows without an id stay. Of several rows with one id the one whose text has the smallest hash stays; only
    such rows are shuffled.
    """
    kept = groups.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    kept = saved(kept, "kept-ids")
    one = of_keys(docs, kept.filter("rows = 1"), "doc_id", "left_semi")
    more = of_keys(docs, kept.filter("rows > 1"), "doc_id", "left_semi")
    turn = fresh(docs.columns, "_turn")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.col("text"))
    more = more.withColumn(turn, F.row_number().over(first)).filter(F.col(turn) == 1).drop(turn)
    return one.union(more).union(docs.filter("doc_id is null"))


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column, without a copy through str; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def connected(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of ``edges`` (a, b): label is the smallest vertex of its component.

    Each round hooks every component to the smallest neighbouring one, jumps twice and contracts the
    edges, so long chains shrink geometrically. Labels, hooks and edges stay in tables of the shared
    folder; a hub only meets partial minima. Stops when no edge is left between components.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = saved(both.filter("a <> b").distinct(), "edges")
    labels = None
    while not both.isEmpty():
        hook = both.groupBy("a").agg(F.least("a", F.min("b")).alias("p"))
        hook = saved(hook, "hooks")
        up = hook.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        hook = saved(hook.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p")), "hooks")
        if labels is None:
            labels = hook.select(F.col("a").alias("v"), F.col("p").alias("label"))
        else:
            labels = saved(
                labels.join(hook, labels["label"] == hook["a"], "left").select("v", F.coalesce("p", "label").alias("label")),
                "labels",
            )
        ends = hook.select(F.col("a").alias("b"), F.col("p").alias("q"))
        both = saved(
            both.join(hook, "a").join(ends, "b").select(F.col("p").alias("a"), F.col("q").alias("b"))
            .filter("a <> b").distinct(),
            "edges",
        )
    if labels is None:
        return edges.sparkSession.createDataFrame([], "v long, label long")
    return labels
