"""Embeddings as integer vectors, and fixed-width binary columns for numpy rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integer_vectors(embeddings: DataFrame, *, scale: int, limit: int, **keep: str) -> tuple[DataFrame, int]:
    """(``keep``: column=type..., x array<long>) with x = floor(scale * entry), held within +-``limit``, and the dimension.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped. All vectors of a table have one
    dimension; if not, it is the one most rows have (the greater one of two as frequent) and other rows are dropped.
    """
    entries = F.col("embedding").cast("array<double>")
    rows = embeddings.select(*[F.col(k).cast(kind).alias(k) for k, kind in keep.items()], entries.alias("embedding")).filter("size(embedding) > 0")
    rows = rows.filter(F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))  # NaN is above infinity
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = sizes[0]["size"] if sizes else 0
    whole = F.transform("embedding", lambda c: F.greatest(F.least(F.floor(c * F.lit(float(scale))), F.lit(limit)), F.lit(-limit)))
    return rows.filter(F.size("embedding") == size).select(*keep, whole.alias("x")), size


def matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """An array<long> column of ``width`` entries each as a matrix."""
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def binary_rows(values: np.ndarray) -> pa.Array:
    """Each row of a matrix as the bytes of one binary value."""
    values = np.ascontiguousarray(values)
    size = values.dtype.itemsize * values.shape[1]
    offsets = np.arange(len(values) + 1, dtype=np.int64) * size
    if offsets[-1] >= 1 << 31:
        raise ValueError("a batch of binary rows is limited to 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])


def from_binary_rows(batch: pa.RecordBatch, name: str, dtype: str, width: int) -> np.ndarray:
    """The matrix of a column that ``binary_rows`` made (``width`` numbers a row)."""
    data = b"".join(batch.column(batch.schema.get_field_index(name)).to_pylist())
    return np.frombuffer(data, dtype).reshape(batch.num_rows, width)
