"""Whitened components of vectors by spectral divide and conquer.

Tasks add up sums and centred products of their rows, so only tables of the size
of the dimension (squared) leave them. The covariance is then split on the
driver: the polar factor ``U`` of ``A - s I`` has eigenvalue 1 where ``A`` has
eigenvalues above ``s`` and -1 below, so ``(U + I) / 2`` projects on the upper
invariant subspace. ``U`` comes from the dynamically weighted Halley iteration
(QDWH), by QR steps while the weights are large and by Cholesky steps after. ``A``
is restricted to both subspaces and they are split further, until each has one
dimension; subspaces beyond the wanted components are left whole. The shift is
the mean eigenvalue, which lies strictly between the least and the greatest unless
all are equal. The components, a few columns, go to all tasks with the means.

Defined results: vectors that are null, empty or hold null or non-finite entries
are left out. Vectors of several lengths, and entries whose scaled value is not
exact in a double, are refused. Components without variance have ``whitened`` null and
``explained`` 0 (null if no component has any) and do not enter ``identity_error``.
A deviation beyond a long is null. Null and repeated ids, repeated rows and ties of
eigenvalues are no special case: a tied subspace gets one orthonormal basis for
all rows. An empty table gives an empty one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from wardflow.session import settle

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
# A variance of this share of the whole is taken for rounding.
NOTHING = 1e-14


# -- polar decomposition and splitting ------------------------------------------

def polar_factor(a: np.ndarray, steps: int = 40) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by weighted Halley steps."""
    n = len(a)
    x = a / np.linalg.norm(a)
    least, eye = 1e-16, np.eye(n)  # a bound below all singular values
    for _ in range(steps):
        square = least * least
        root = np.cbrt(4 * (1 - square) / square ** 2)
        first = np.sqrt(1 + root)
        wa = first + np.sqrt(8 - 4 * root + 8 * (2 - square) / (square * first)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.concatenate([np.sqrt(wc) * x, eye]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            low = np.linalg.cholesky(eye + wc * (x.T @ x))
            half = np.linalg.solve(low, x.T)
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(low.T, half).T
        least = min(1.0, least * (wa + wb * square) / (1 + wc * square))
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= 1e-14 * np.sqrt(n) * max(1.0, np.linalg.norm(x)) and least > 1 - 1e-8:
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """Orthonormal basis, and how many of its columns span the upper subspace."""
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n))
    if spread <= 1e-15 * n * max(abs(mean), np.finfo(float).tiny):
        return None
    start = np.random.default_rng(n).standard_normal((n, n))
    best = None
    # An eigenvalue at the shift has no sign: then the shift is moved a little.
    for move in (0.0, 0.01, -0.013, 0.031, -0.037, 0.07, -0.083):
        u = polar_factor(a - (mean + move * spread / np.sqrt(n)) * np.eye(n))
        projector = (u + np.eye(n)) / 2
        rank = int(round(float(np.trace(projector))))
        if not 0 < rank < n:
            continue
        basis = start
        for _ in range(3):
            basis, _ = np.linalg.qr(np.concatenate(
                [projector @ basis[:, :rank], (np.eye(n) - projector) @ basis[:, rank:]], axis=1))
        left = np.linalg.norm(basis[:, rank:].T @ a @ basis[:, :rank]) / spread
        if best is None or left < best[0]:
            best = left, basis, rank
        if left <= 1e-14 * n:
            break
    return best and (best[1], best[2])


def leading(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of a symmetric matrix, falling, and their vectors."""
    values: list[float] = []
    vectors: list[np.ndarray] = []
    todo = [np.eye(len(a))]
    while todo and len(values) < wanted:
        basis = todo.pop()
        own = basis.T @ a @ basis
        own = (own + own.T) / 2
        parts = _split(own) if len(own) > 1 else None
        if parts is None:  # one dimension, or all eigenvalues equal
            values += np.diag(own).tolist()
            vectors += list(basis.T)
        else:
            turned, rank = parts
            todo += [basis @ turned[:, rank:], basis @ turned[:, :rank]]
    value, vector = np.array(values), np.array(vectors).reshape(-1, len(a)).T
    order = np.argsort(-value, kind="stable")[:wanted]
    return value[order], vector[:, order]


# -- sums over all rows -----------------------------------------------------------

def integers(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """``floor(scale * c) + shift`` of every entry; null if the vector takes no part."""
    wide = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(wide, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    exact = F.transform(wide, lambda c: F.when(F.abs(c) * scale < 2.0 ** 52, F.floor(c * scale) + shift)
                        .otherwise(F.raise_error(F.lit("an entry is too large for exact sums"))))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, exact)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Fit(NamedTuple):
    """Rows, sums, and the components with their variances and shares."""

    n: int
    sums: np.ndarray
    variance: np.ndarray
    vectors: np.ndarray
    explained: list[float | None]


def _sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    def run(batches):
        n, total = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(0).value_lengths().to_numpy()
            dim = int(sizes[0])
            if (sizes != dim).any() or (total is not None and len(total) != dim):
                raise ValueError("vectors of several lengths")
            own = _matrix(batch.column(0), dim).sum(axis=0)
            total = own if total is None else total + own
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total),
                 pa.array(np.full(len(total), n))], names=["i", "total", "n"])

    # One row a dimension.
    found = (rows.select("x").mapInArrow(run, "i int, total long, n long").groupBy("i")
             .agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("i").collect())
    if len({r["n"] for r in found}) > 1:
        raise ValueError("vectors of several lengths")
    return found[0]["n"] if found else 0, np.array([r["total"] for r in found], np.int64)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - S / n``; the whole part is taken off before rounding can enter."""
    return (x - sums // n) - (sums % n) / n


def _covariance(rows: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    dim = len(sums)

    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            own = _centred(_matrix(batch.column(0), dim), n, sums)
            total += own.T @ own
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dim, dtype=np.int32)),
             pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    added = (rows.select("x").mapInArrow(run, "i int, row array<double>")
             .select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j")
             .agg(F.sum("v").alias("v")).toPandas())
    out = np.zeros((dim, dim))
    out[added["i"].to_numpy(), added["j"].to_numpy()] = added["v"].to_numpy()
    return (out + out.T) / (2 * n)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit:
    """Sums and leading components of the vectors ``x`` (array of long, not null)."""
    n, sums = _sums(rows)
    if not n:
        return Fit(0, sums, np.zeros(0), np.zeros((0, 0)), [])
    covariance = _covariance(rows, n, sums)
    variance, vectors = leading(covariance, components)
    trace = float(np.trace(covariance))
    variance = np.where(variance > NOTHING * trace, variance, 0.0)
    shares = [float(e) / trace if trace > 0 else None for e in variance]
    return Fit(n, sums, variance, vectors, shares)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sums of ``(n * x - S) ** 2``, exact; null beyond a long."""
    apart = x - sums // n
    rest = sums % n
    # n * x - S is n * (x - S div n) - S mod n.
    most = (float(np.abs(apart).max(initial=0)) + 1) * n
    if most * most * x.shape[1] < 2.0 ** 62:
        return ((n * apart - rest) ** 2).sum(axis=1).tolist()
    out = []
    for row in apart.tolist():
        exact = sum((n * a - r) ** 2 for a, r in zip(row, rest.tolist(), strict=True))
        out.append(exact if exact < 1 << 63 else None)
    return out


def project(rows: DataFrame, model: Fit) -> DataFrame:
    """``rows`` without ``x``, with ``deviation`` and the array ``whitened``."""
    kept = [f for f in rows.schema.fields if f.name != "x"]
    schema = StructType([*kept]).add("deviation", LongType()).add("whitened",
                                                                 ArrayType(DoubleType()))
    n, sums, dim = model.n, model.sums, len(model.sums)
    live = model.variance > 0
    turned = model.vectors / np.sqrt(np.where(live, model.variance, 1.0))

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(batch.num_columns - 1), dim)
            out = _centred(x, n, sums) @ turned
            flat = pa.array(out.ravel(), mask=~np.broadcast_to(live, out.shape).ravel())
            ends = np.arange(len(x) + 1, dtype=np.int32) * out.shape[1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(_deviations(x, n, sums), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), flat)], names=schema.names)

    return rows.select(*[f.name for f in kept], "x").mapInArrow(run, schema)


def _identity_error(projected: DataFrame, live: int) -> float | None:
    """Largest entry of the whitened covariance minus the identity, by magnitude."""
    pairs = [(i, j) for i in range(live) for j in range(i, live)]
    if not pairs:
        return None
    found = projected.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j])
                            .alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
             components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component, numbered from 1 by falling variance."""
    rows = (df.select(df[vec_id].alias("vec_id"), integers(df[vector]).alias("x"))
            .filter(F.col("x").isNotNull()))
    model = fit(rows, components)
    count = len(model.variance)
    if model.n:
        done = settle(project(rows, model), "whitened")
        error = _identity_error(done, int((model.variance > 0).sum()))
    else:
        done = rows.select("vec_id", F.lit(None).cast("long").alias("deviation"),
                           F.lit(None).cast("array<double>").alias("whitened"))
        error = None
    explained = F.array(*[F.lit(e).cast("double") for e in model.explained]).cast("array<double>")
    numbers = F.sequence(F.lit(1), F.lit(count)) if count else F.array().cast("array<int>")
    return (done.select("vec_id", "deviation", "whitened", F.explode(numbers).alias("component"))
            .select("vec_id", F.col("component").cast(IntegerType()).alias("component"),
                    F.lit(model.n).cast("long").alias("n"), "deviation",
                    F.get("whitened", F.col("component") - 1).alias("whitened"),
                    F.get(explained, F.col("component") - 1).alias("explained"),
                    F.lit(error).cast("double").alias("identity_error")))
