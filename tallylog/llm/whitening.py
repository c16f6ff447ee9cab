"""Whitening of embeddings by an exact scatter matrix from residues.

Vectors become whole numbers.  Each task multiplies the residues of its vectors modulo several primes below 2**20, a few thousand rows at
a time, so every product is exact in double arithmetic; a column of ones beside them gives the sums and the count.  The residues of all tasks are added up for each
row of the matrix, and Chinese remaindering gives its entries exactly, from which the covariance follows exactly.  Its eigenvectors are found in
double precision on the driver, which gets one number for each pair of dimensions and no vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.llm.shared import materialize

#: Parts of 1 that a unit of the whole numbers is.
SCALE = 256
#: Primes are below this; with the rows of a product, half a prime squared stays below 2**53.
PRIME_BELOW, PRODUCT_ROWS = 1 << 20, 1 << 13


def _primes(product: int) -> list[int]:
    """The largest primes below PRIME_BELOW whose product exceeds ``product``."""
    sieve = np.ones(PRIME_BELOW, dtype=bool)
    sieve[:2] = False
    for i in range(2, int(PRIME_BELOW**0.5) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    out, total = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        out.append(p)
        total *= p
        if total > product:
            return out
    raise ValueError("entries are too large")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of one length as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def _residue_products(dims: int, primes: list[int]):
    """``row, prime, residues`` of the matrix of products of a task's vectors, each with a 1 at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((dims + 1, dims + 1), np.int64) for _ in primes]
        seen = False
        for batch in batches:
            vectors = _matrix(batch.column(0), dims)
            for begin in range(0, len(vectors), PRODUCT_ROWS):
                seen = True
                block = vectors[begin : begin + PRODUCT_ROWS]
                for k, p in enumerate(primes):
                    residues = np.ones((len(block), dims + 1))
                    residues[:, :dims] = (block + p // 2) % p - p // 2 if abs(block).max(initial=0) < 1 << 62 else _centred(block, p)
                    sums[k] = (sums[k] + (residues.T @ residues).astype(np.int64)) % p
        if seen:
            for k in range(len(primes)):
                rows = pa.array(range(dims + 1), pa.int32())
                flat = pa.array(sums[k].ravel(), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(range(0, (dims + 1) ** 2 + 1, dims + 1), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([rows, pa.array([k] * (dims + 1), pa.int32()), lists], names=["row", "prime", "residues"])

    return run


def _centred(block: np.ndarray, p: int) -> np.ndarray:
    """Residues nearest to 0, of whole numbers of any size."""
    residues = block % p
    return np.where(residues > p // 2, residues - p, residues)


def _remaindered(primes: list[int]):
    """Exact entries of one row of the matrix, as texts, from the residues of all tasks."""
    whole = prod(primes)
    parts = [whole // p * pow(whole // p, -1, p) for p in primes]

    def run(table: pa.Table) -> pa.Table:
        which = table["prime"].to_numpy()
        residues = _matrix(table["residues"], len(table["residues"][0]))
        values = np.zeros(residues.shape[1], dtype=object)
        for k, (p, part) in enumerate(zip(primes, parts)):
            # tasks are far fewer than 2**43, so the sum of their residues fits
            values = values + (residues[which == k].sum(axis=0) % p).astype(object) * part
        exact = [v % whole for v in values]
        texts = [str(v - whole if v > whole // 2 else v) for v in exact]
        return pa.table({"row": table["row"].slice(0, 1), "entries": pa.array([texts], pa.list_(pa.string()))})

    return run


@dataclass
class Whitening:
    """What whitening learns: count, exact sums, and for each component a unit vector, its eigenvalue and its share of the variance."""

    n: int
    dims: int
    largest: int
    sums: list[int]
    vectors: np.ndarray  #: one column for each component
    values: np.ndarray
    explained: np.ndarray
    scale: np.ndarray  #: 1 / sqrt(eigenvalue), 0 where there is no variance

    def __call__(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ self.vectors * self.scale


def whole_numbers(embedding: Column) -> Column:
    """``floor(256 * c)`` of each entry as long, or null for vectors that have none.

    These are null, and vectors with entries that are null, not finite, or 2**63 / 256 or more.
    """
    scaled = F.transform(embedding, lambda c: c.cast("double") * SCALE)
    bad = F.exists(scaled, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(1 << 63)))
    return F.when(embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(scaled, lambda c: F.floor(c)))


def fit_whitening(fit: DataFrame, components: int) -> Whitening | None:
    """Learn from ``x`` (array<long>) of a stored table of distinct vectors; None if there are none.

    Vectors of another length than most have (the smaller one on ties) take no part.  Components that have no variance, up to the rounding of
    double precision, get the scale 0.
    """
    sizes = fit.groupBy(F.size("x").alias("dims")).agg(
        F.count("*").alias("n"), F.max(F.array_max("x")).alias("most"), F.min(F.array_min("x")).alias("least")
    )
    top = sizes.orderBy(F.desc("n"), "dims").limit(1).collect()
    if not top:
        return None
    dims, n = top[0]["dims"], top[0]["n"]
    if not dims:
        return Whitening(n, 0, 0, [], np.empty((0, 0)), np.empty(0), np.empty(0), np.empty(0))
    largest = max(abs(top[0]["most"]), abs(top[0]["least"]), 1)
    primes = _primes(2 * n * largest * largest)
    products = fit.where(F.size("x") == dims).select("x").mapInArrow(_residue_products(dims, primes), "row int, prime int, residues array<long>")
    rows = products.groupBy("row").applyInArrow(_remaindered(primes), "row int, entries array<string>").collect()
    scatter = [[int(v) for v in r["entries"]] for r in sorted(rows, key=lambda r: r["row"])]
    if scatter[dims][dims] != n:
        raise ValueError("the table of distinct vectors changed")
    sums = scatter[dims][:dims]
    # whole numbers divide to the nearest double
    cov = np.array([[(n * scatter[i][j] - sums[i] * sums[j]) / (n * n) for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1][:components], 0.0), vectors[:, ::-1][:, :components]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    total = sum(cov[i, i] for i in range(dims))
    some = values > max(values[0], 0.0) * dims * np.finfo(float).eps
    scale = np.where(some, 1 / np.sqrt(np.where(some, values, 1.0)), 0.0)
    return Whitening(n, dims, largest, sums, vectors * signs, values, values / total if total else values, scale)


def _second_moments(model: Whitening):
    """Sums of a task's whitened vectors and of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        sums = np.zeros(k + k * k)
        for batch in batches:
            w = model(_matrix(batch.column(0), model.dims))
            sums[:k] += w.sum(axis=0)
            sums[k:] += (w.T @ w).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return run


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors less the identity, over components that have variance."""
    k = len(model.values)
    parts = fit.where(F.size("x") == model.dims).select("x").mapInArrow(_second_moments(model), "sums array<double>")
    sums = {r["i"]: r["s"] for r in parts.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")).collect()}
    sums = np.array([sums[i] for i in range(k + k * k)]) / model.n
    some = model.scale > 0
    error = sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k]) - np.eye(k)
    return float(np.abs(error[np.ix_(some, some)]).max(initial=0.0))


def _whiten(model: Whitening):
    def deviations(x: np.ndarray) -> pa.Array:
        if model.dims * (2 * model.n * model.largest) ** 2 < 1 << 63:
            away = model.n * x - np.array(model.sums, np.int64)
            return pa.array((away * away).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
        away = model.n * x.astype(object) - np.array(model.sums, dtype=object)
        return pa.array([Decimal(v) for v in (away * away).sum(axis=1)], pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1), model.dims)
            away, w = deviations(x), model(x)
            for c in range(k):
                columns = [batch.column(0), pa.array([c + 1] * len(x), pa.int32()), away, pa.array(w[:, c]), pa.array([model.explained[c]] * len(x), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "deviation", "whitened", "explained"])

    return run


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """``<id_col>, component, n, deviation, whitened, explained, identity_error`` for each vector and component.

    The mean and the covariance (divisor n) are those of the distinct vectors of whole numbers, each counted once.  ``deviation``
    is the exact sum over dimensions of ``(n * x - sum) ** 2``, decimal(38,0); larger ones are an error.  ``whitened`` is the
    deviation from the mean along a component over the square root of its eigenvalue; components have falling eigenvalues from 1, and the same sign for all rows.

    Vectors that are null or have entries that are null, not finite or too large for a long are left out, and so are vectors whose length is not that of most
    distinct ones.  Repeated and null ids are rows like others.  Where all distinct vectors agree along a component (one vector, or fewer than dimensions),
    ``whitened`` is 0, and ``explained`` 0 where there is no variance at all.  Vectors without entries, and an empty table, give no rows.
    """
    numbers = rows.select(F.col(id_col).alias("id"), whole_numbers(F.col(vector_col)).alias("x")).where("x is not null")
    fit = materialize(numbers.select("x").distinct(), "vectors")
    model = fit_whitening(fit, components)
    kind = dict(rows.dtypes)[id_col]
    schema = f"id {kind}, component int, deviation decimal(38,0), whitened double, explained double"
    if model is None or not model.dims:
        out, n, error = rows.sparkSession.createDataFrame([], schema), 0, 0.0
    else:
        n, error = model.n, identity_error(fit, model)
        out = numbers.where(F.size("x") == model.dims).mapInArrow(_whiten(model), schema)
    return out.select(
        F.col("id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error")
    )
