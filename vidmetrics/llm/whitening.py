"""Whitening of embeddings on their leading components, found by Chebyshev-filtered subspace iteration.

The covariance is never formed. A block of directions is multiplied by it in one distributed pass over the
distinct vectors, each centred before it is multiplied. A Chebyshev polynomial of the covariance, built by its
three-term recurrence from such passes, damps the spectrum below the block's smallest Ritz value and lifts what
lies above; QR and a Rayleigh-Ritz step then give the next estimates with their residuals. The iteration ends when
the residuals of the wanted components certify them, or when they are down to rounding and no longer fall.

The driver holds the block (dimension x ``BLOCK`` numbers), never a vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmetrics.llm.common import column, map_arrow, saved
from vidmetrics.llm.vectors import binary_rows, integer_vectors, matrix

#: Directions of the block; bytes of vectors that one row of the fit table holds.
BLOCK, CHUNK_BYTES = 24, 1 << 20
#: Entries are held within this after scaling, so that sums of two halves are exact.
LIMIT = 1 << 52
#: A residual (of the largest eigenvalue) that certifies, and one that rounding explains if it no longer falls.
CERTIFIED, ROUNDING = 2e-15, 1e-11
#: Highest degree of a filter, and how much more it may lift the first direction than the last wanted one.
DEGREE, SPREAD = 20, 1e8
CYCLES = 200


@dataclass
class Whitening:
    """n distinct vectors with sums per dimension; components as columns of ``vectors``, with eigenvalues,
    the trace of the covariance and the largest entry of whitened's covariance minus the identity."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int = 0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2; null where it is no long."""
        bound = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if bound * bound * x.shape[1] < 1 << 63:
            return (((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1)).tolist()
        exact = (((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1)).tolist()
        return [v if v < 1 << 63 else None for v in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)


def _distinct(vectors: DataFrame, size: int) -> DataFrame:
    """(m, z): the distinct vectors, some thousand in a row as bytes of longs."""
    held = max(1, CHUNK_BYTES // (8 * size))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        wait: list[np.ndarray] = []
        for batch in batches:
            wait.append(matrix(batch, "x", size))
            if sum(map(len, wait)) >= held:
                yield chunk(np.concatenate(wait))
                wait = []
        if wait:
            yield chunk(np.concatenate(wait))

    def chunk(x: np.ndarray) -> dict:
        return {"m": [len(x)], "z": binary_rows(x.reshape(1, -1))}

    return map_arrow(vectors.select("x").distinct(), work, "m int, z binary")


def _summed(chunks: DataFrame, size: int, work: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all vectors of what ``work`` makes of a matrix of them: an array of fixed length, partly
    summed by each task, then by Spark per place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = None
        for batch in batches:
            for m, z in zip(column(batch, "m").to_pylist(), column(batch, "z").to_pylist()):
                part = work(np.frombuffer(z, np.int64).reshape(m, size))
                total = part if total is None else total + part
        if total is not None:
            yield {"i": np.arange(len(total), dtype=np.int32), "y": total}

    rows = map_arrow(chunks, run, f"i int, y {kind}").groupBy("i").agg(F.sum("y").alias("y")).collect()
    out = np.zeros(len(rows), float if kind == "double" else object)
    for r in rows:
        out[r["i"]] = r["y"]
    return out


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, degree: int, high: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of ``degree`` of the operator on ``q``: at most 1 on [0, ``high``] where it is as
    large as at ``top``, by the recurrence scaled so that its value at ``top`` is 1."""
    e = c = high / 2
    sigma = first = e / (top - c)
    last, y = q, (times(q) - c * q) * (sigma / e)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        last, y = y, (times(y) - c * y) * (2 * following / e) - (sigma * following) * last
        sigma = following
    return y


def fit_whitening(vectors: DataFrame, size: int, *, components: int = 4, block: int = BLOCK, seed: int = 11) -> Whitening | None:
    """Learns from the distinct x of ``vectors`` (x array<long>); None without vectors.

    There are fewer components than asked for where the covariance has fewer eigenvalues above rounding.
    """
    chunks = saved(_distinct(vectors, size), "distinct-vectors")
    n = chunks.agg(F.sum("m")).first()[0]
    if not n:
        return None
    halves = _summed(chunks, size, lambda x: np.concatenate([(x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0)]), "long")
    sums = [(int(a) << 26) + int(b) for a, b in zip(halves[:size], halves[size:])]
    mean = np.array([s / n for s in sums])
    trace = float(_summed(chunks, size, lambda x: ((x - mean) ** 2).sum(0), "double").sum() / n)
    passes = 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def work(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return (centred.T @ (centred @ q)).ravel()

        return _summed(chunks, size, work, "double").reshape(q.shape) / n

    width = min(size, max(block, 2 * components))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    before = np.inf
    for _ in range(CYCLES):
        product = times(q)
        values, turn = np.linalg.eigh((q.T @ product + product.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, product = q @ turn, product @ turn
        top = max(float(values[0]), 0.0)
        wanted = min(components, int((values > max(top, trace / size) * 1e-12).sum()))
        if not wanted:
            break
        residual = np.linalg.norm(product - q * values, axis=0)[:wanted].max() / top
        high = float(values[-1])
        done = residual <= CERTIFIED or (residual <= ROUNDING and residual > before / 2)
        if done or width == size or high <= top * 1e-13:
            break
        before = residual
        at = np.arccosh(np.maximum(2 * values[[0, wanted - 1]] / high - 1, 1 + 1e-12))
        degree = int(np.ceil(np.log(max(2 * residual / CERTIFIED, 8)) / at[1]))
        if at[0] > at[1]:
            degree = min(degree, int(np.log(SPREAD) / (at[0] - at[1])))
        q = np.linalg.qr(filtered(times, q, min(max(degree, 2), DEGREE), high, top))[0]

    model = Whitening(n, sums, q[:, :wanted], values[:wanted], trace, 0.0, passes)
    if wanted:
        def spread(x: np.ndarray) -> np.ndarray:
            w = model.whitened(x)
            return (w.T @ w).ravel()

        model.identity_error = float(np.abs(_summed(chunks, size, spread, "double").reshape(wanted, wanted) / n - np.eye(wanted)).max())
    return model


def whiten(embeddings: DataFrame, *, components: int = 4, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row of ``embeddings`` (vec_id,
    embedding) and each of the first ``components`` components.

    Vectors become x = floor(scale * entry). n, sums, mean and covariance (divisor n) are those of the distinct x.
    Components are unit eigenvectors by falling eigenvalue e, numbered from 1, either sign, the same for all rows; of equal
    eigenvalues any basis. whitened: x - mean on the component, over sqrt(e). explained: e over the trace.
    identity_error: largest entry of whitened's covariance minus the identity, over the distinct x. deviation: sum
    of (n x - S)^2, null where that is no long.

    Dropped: null and empty vectors, vectors with null or non-finite entries, and vectors of another dimension than most.
    Repeated rows and null ids are kept. A component whose eigenvalue is rounding has no rows: one vector only, or
    copies of it, give none. Other columns are ignored.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors, size = integer_vectors(embeddings, scale=scale, limit=LIMIT, vec_id="long")
    model = fit_whitening(vectors, size, components=components) if size else None
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        k = len(model.values)
        for batch in batches:
            x = matrix(batch, "x", size)
            ids = column(batch, "vec_id").take(pa.array(np.repeat(np.arange(len(x)), k)))
            deviation = pa.array(model.deviation(x), pa.int64())
            yield {
                "vec_id": ids, "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), "n": np.full(len(x) * k, model.n),
                "deviation": deviation.take(pa.array(np.repeat(np.arange(len(x)), k))), "whitened": model.whitened(x).ravel(),
                "explained": np.tile(model.values / model.trace, len(x)), "identity_error": np.full(len(x) * k, model.identity_error),
            }

    return map_arrow(vectors, work, schema)
