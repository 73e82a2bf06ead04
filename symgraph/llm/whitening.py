"""Embedding whitening by upper-triangle column aggregates.

Vectors are brought to whole numbers, ``floor(64 c) + 1000000``. One aggregation counts them and sums each
dimension; a second one has a generated SQL expression for every pair of dimensions ``i <= j``, the sum of
products of centred values (``PAIRS`` expressions an aggregation at most, so wide vectors take several). Both
are summed in the tasks first: what is shuffled and sent to the driver is a row a task, and the square of the
dimension, whatever the number of vectors.

Values are centred at the whole number nearest to their mean, and the rest of the mean is put right in whole
numbers afterwards, so the covariance matrix is exact before it is rounded to doubles once. LAPACK decomposes
it (``eigh``); components come by falling eigenvalue, the entry of largest size of each positive.

Defined cases: vectors that are null or empty, or hold null or non-finite entries, are dropped, and so are
those that have not as many entries as most vectors have (of equally frequent lengths, the greater holds);
null and repeated ids are rows like others; components whose eigenvalue is below ``LEAST`` of the largest have
no variance to divide by and are left out (one vector alone, or equal ones, have no component, thus no rows);
equal eigenvalues take any basis; an empty table gives no rows; other columns are ignored. Entries so large
that a deviation does not fit in 64 bits end the job with an overflow error: no number is ever wrong.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Pair sums of one aggregation (64 dimensions have 2,080).
PAIRS = 4096
#: Part of the largest eigenvalue below which one counts as zero.
LEAST = 1e-10
#: Vectors that are projected at once.
ROWS = 2000


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: vectors, sums per dimension, components (columns), their eigenvalues, trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def whole_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, x`` of the vectors that are used, entries as whole numbers."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    fine = F.coalesce(fine, F.lit(False))
    rows = rows.where(fine).select("vec_id", F.transform("embedding", lambda c: F.floor(F.lit(float(SCALE)) * c) + F.lit(SHIFT)).alias("x"))
    top = rows.groupBy(F.size("x").alias("d")).count().agg(F.max(F.struct("count", "d"))["d"]).first()[0]  # one number
    return rows.where(F.size("x") == (top or 0))


def pair_sums(values: DataFrame, names: list[str], limit: int = PAIRS) -> np.ndarray:
    """Symmetric matrix (of Python numbers) of the sums of products of each two columns of ``values``."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    out = np.zeros((len(names), len(names)), object)
    for at in range(0, len(pairs), limit):
        some = pairs[at : at + limit]
        row = values.selectExpr(*[f"sum(`{names[i]}` * `{names[j]}`) AS s{k}" for k, (i, j) in enumerate(some)]).first()
        for (i, j), s in zip(some, row, strict=True):
            out[i, j] = out[j, i] = s
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``x`` over all of ``vectors`` (of one length), or None if there are none."""
    first = vectors.select(F.size("x").alias("d")).limit(1).collect()
    if not first:
        return None
    d = first[0]["d"]
    row = vectors.selectExpr("count(*) AS n", *[f"sum(x[{i}]) AS s{i}" for i in range(d)]).first()
    n, sums = row["n"], [row[f"s{i}"] for i in range(d)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([s - n * c for s, c in zip(sums, centre, strict=True)], object)  # sums of the centred values
    names = [f"z{i}" for i in range(d)]
    products = pair_sums(vectors.selectExpr(*[f"x[{i}] - {c}L AS z{i}" for i, c in enumerate(centre)]), names)
    exact = n * products - np.outer(rest, rest)  # n^2 times the covariance, in whole numbers
    v = np.array([[x / (n * n) for x in r] for r in exact.tolist()], float)
    e, vectors_ = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:components]
    order = order[e[order] > LEAST * max(e.max(), 0.0)]
    c = vectors_[:, order]
    if len(order):
        c = c * np.where(c[np.argmax(np.abs(c), axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    return Whitening(n, sums, c, e[order], sum(int(exact[i, i]) for i in range(d)) / (n * n))


def _deviations(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """``n x - S``, and the sum of its squares in each row, both exact."""
    y = x.astype(object) * model.n - np.array(model.sums, object) if abs(x).max(initial=0) > (1 << 62) // model.n else x * model.n - np.array(model.sums)
    if y.dtype != object and int(abs(y).max(initial=0)) ** 2 * len(model.sums) >= 1 << 62:
        y = y.astype(object)
    squares = (y * y).sum(axis=1)
    if len(squares) and max(squares) >= 1 << 63:
        raise OverflowError("a deviation does not fit in 64 bits")
    return y, squares.astype(np.int64)


def _batch_vectors(b: pa.RecordBatch, d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for lo in range(0, b.num_rows, ROWS):
        part = b.slice(lo, ROWS)
        yield part.column("vec_id"), part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, d)


def _whitened(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    to = model.components / np.sqrt(model.eigenvalues)
    for b in batches:
        for ids, x in _batch_vectors(b, len(model.sums)):
            y, squares = _deviations(x, model)
            yield ids, squares, (y.astype(float) / model.n) @ to


def _arrays(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    for _, _, w in _whitened(batches, model):
        yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in range(w.shape[1])], names=[f"w{k}" for k in range(w.shape[1])])


def _rows(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    k = len(model.eigenvalues)
    for ids, squares, w in _whitened(batches, model):
        n = len(ids)
        at = pa.array(np.repeat(np.arange(n), k))
        yield pa.RecordBatch.from_arrays(
            [ids.take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n)), pa.array(np.repeat(squares, k)), pa.array(w.reshape(-1)), pa.array(np.tile(model.eigenvalues / model.trace, n))],
            names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
        )


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry, by size, of the whitened vectors' covariance minus the identity, measured on all of them."""
    k = len(model.eigenvalues)
    names = [f"w{i}" for i in range(k)]
    white = vectors.mapInArrow(lambda b: _arrays(b, model), ", ".join(f"{x} double" for x in names))
    products = pair_sums(white, names).astype(float) / model.n  # their mean is zero: x - S/n was projected
    return float(np.abs(products - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of ``vec_id, embedding``."""
    vectors = whole_vectors(rows)
    model = fit(vectors, components)
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double"
    if model is None or not len(model.eigenvalues):
        return rows.sparkSession.createDataFrame([], f"{kind}, identity_error double")
    error = identity_error(vectors, model)
    return vectors.mapInArrow(lambda b: _rows(b, model), kind).withColumn("identity_error", F.lit(error))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
