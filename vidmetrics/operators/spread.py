"""Helpers that keep hot keys out of a single task.

A window partitioned by a business key puts all rows of that key into one task. The helpers here
cut each key into spans of bounded size, work inside the spans, and carry one small row per span
across: the wide rows are only ever shuffled on (key, span).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vidmetrics.session import ensure_checkpoint_dir


_PARTS = 512
_EARLY_CUT = "spark.sql.optimizer.windowGroupLimitThreshold"


def instant(as_of) -> Column:
    """A UTC clock given by the caller; operators never read the wall clock."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key. Spark cuts to ``n`` before the shuffle (window group limit).

    Spark makes no such cut above a threshold of the session; the same cut is then made on hashed parts
    of each key first, so that one key still never meets in one task as a whole.
    """
    if n > int(df.sparkSession.conf.get(_EARLY_CUT, "1000")):
        part = F.pmod(F.xxhash64(*df.columns), F.lit(_PARTS))
        parts = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", part).withColumn("_rank", F.row_number().over(parts))
            .filter(F.col("_rank") <= n).drop("_rank", "_part")
        )
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def with_previous(
    df: DataFrame, key: str, ts: str, tie: str, values: Sequence[str], span: str = "hour"
) -> DataFrame:
    """Adds ``prev_<value>``: the values of the preceding row of the key in (ts, tie) order.

    One span of one key holds at most the rows of one hour; the last row of each span is carried
    to the next one through a table with one row per (key, span).
    """
    packed = F.struct(*[F.col(v) for v in values])
    spanned = df.withColumn("_span", F.date_trunc(span, ts))
    tails = spanned.groupBy(key, "_span").agg(
        F.max_by(packed, F.struct(F.col(ts), F.col(tie))).alias("_tail")
    )
    carried = tails.select(
        key, "_span",
        F.lag("_tail").over(Window.partitionBy(key).orderBy("_span")).alias("_carried"),
    )
    inside = Window.partitionBy(key, "_span").orderBy(ts, tie)
    prev = F.coalesce(F.col("_near"), F.col("_carried"))
    return (
        spanned.withColumn("_near", F.lag(packed).over(inside))
        .join(carried, [key, "_span"], "left")
        .select(*df.columns, *[prev.getField(v).alias(f"prev_{v}") for v in values])
    )


def with_running_max(
    df: DataFrame, key: str, ts: str, tie: str, value: str, name: str, span: str = "hour"
) -> DataFrame:
    """Adds the highest ``value`` among the rows strictly before this one, per key in (ts, tie) order."""
    spanned = df.withColumn("_span", F.date_trunc(span, ts))
    before_span = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        spanned.groupBy(key, "_span").agg(F.max(value).alias("_top"))
        .select(key, "_span", F.max("_top").over(before_span).alias("_carried"))
    )
    inside = (
        Window.partitionBy(key, "_span").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        spanned.withColumn("_near", F.max(value).over(inside))
        .join(carried, [key, "_span"], "left")
        .select(*df.columns, F.greatest("_near", "_carried").alias(name))
    )


def ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds the rank (from 1) in a total ``order`` of all rows, without a task that sees all of them: rows are dealt into
    ranges of the order, ranked inside, and shifted by the counts of the ranges before."""
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    shift, rows = 0, []
    for number, count in sorted(map(tuple, ranged.groupBy("_range").count().collect())):  # one row per partition
        rows.append((number, shift))
        shift += count
    shifts = F.broadcast(df.sparkSession.createDataFrame(rows, "_range int, _shift long"))
    inside = Window.partitionBy("_range").orderBy(*order)
    return ranged.withColumn("_rank", F.row_number().over(inside)).join(shifts, "_range").select(
        *df.columns, (F.col("_shift") + F.col("_rank")).cast("long").alias(name)
    )


def numbered(df: DataFrame, id_col: str, start: Column | int, name: str) -> DataFrame:
    """Adds ``start`` + the rank of the unique long ``id_col``: dense surrogate numbers in id order.

    Rows are dealt into ranges of ids, by samples, so hash ids spread like dense ones, and kept in the
    shared folder; ranks are taken inside ranges and shifted by the row counts of the lower ranges, one
    number per range.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(id_col).withColumn("_range", F.spark_partition_id()).checkpoint()
    shift, rows = 0, []
    for number, count in sorted(map(tuple, ranged.groupBy("_range").count().collect())):  # one row per partition
        rows.append((number, shift))
        shift += count
    shifts = F.broadcast(df.sparkSession.createDataFrame(rows, "_range int, _shift long"))
    inside = Window.partitionBy("_range").orderBy(id_col)
    begin = start if isinstance(start, Column) else F.lit(start)
    return (
        ranged.withColumn("_rank", F.row_number().over(inside))
        .join(shifts, "_range")
        .select(*df.columns, (begin + F.col("_shift") + F.col("_rank")).cast("long").alias(name))
    )
