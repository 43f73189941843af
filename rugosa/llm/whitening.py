"""Whitening of embeddings by singular values of their centred rows.

Method. Over the fit list (each distinct integer vector once): a blockwise QR
factorisation reduces the centred rows to one triangle R (tasks factor their rows,
groups of triangles are stacked and factored again); Householder reflections bring R
to an upper bidiagonal; differential quotient-difference steps with shifts (dqds)
find its singular values to high relative accuracy; for each of the largest ones a
twisted factorisation of BᵀB - λI gives the right singular vector, which the
reflections carry back. A vector whose value lies close to another's is made
orthogonal to it and iterated again.

Only triangles of the vectors' dimension reach the driver, one for each of at most
``TRIANGLES`` groups.

Defined results: rows without a vector, with an empty one, or with a null or
non-finite component are dropped; of the rest, those whose vector has another number
of components than most (the larger number of a tie) are dropped too, as one
covariance needs one dimension; repeated vectors count once in the fit and each row
gets its rows in the result; rows that repeat or lack a vec_id are rows like any
other; directions without variance (below ``RANK`` of the largest eigenvalue) are no
components, so equal vectors alone give an empty result, as an empty table does;
a deviation beyond a long is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rugosa.llm.common import release, store
from rugosa.llm.vectors import integer_vectors
from rugosa.session import ship_package

#: Triangles that the driver stacks at most.
TRIANGLES = 16
#: Rows that are factored at a time.
ROWS = 4096
#: Eigenvalues below this part of the largest are no components.
RANK = 1e-13
#: Vectors whose eigenvalues lie closer than this part of the larger are made orthogonal.
CLUSTER = 1e-3


# ---------------------------------------------------------------- small algebra


def triangle(rows: np.ndarray) -> np.ndarray:
    """The R of a QR factorisation, d x d."""
    d = rows.shape[1]
    if len(rows) < d:
        rows = np.vstack([rows, np.zeros((d - len(rows), d))])
    return np.linalg.qr(rows, mode="r")


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and beta with (I - beta v vᵀ) x = -sign(x0) |x| e1."""
    size = np.linalg.norm(x)
    v = x.copy()
    if size == 0:
        return v, 0.0
    v[0] += np.copysign(size, x[0])
    return v, 2.0 / (v @ v)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of B = UᵀRV by Householder reflections from both
    sides, and V."""
    a = r.astype(np.float64).copy()
    d = len(a)
    right = np.eye(d)
    for k in range(d):
        v, beta = _reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v, beta = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= beta * np.outer(right[:, k + 1 :] @ v, v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), right


def _dqds_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One shifted differential qd transform; also the least d of it (negative where
    the shift was above the least squared singular value)."""
    n = len(q)
    q2, e2 = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    least = d
    for k in range(n - 1):
        q2[k] = d + e[k]
        ratio = q[k + 1] / q2[k] if q2[k] != 0 else np.inf
        e2[k] = e[k] * ratio if e[k] else 0.0
        d = d * ratio - shift if d else -shift
        least = min(least, d)
    q2[-1] = d
    return q2, e2, least


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values of an upper bidiagonal, falling. Shifts never pass the least
    value, so every quantity stays positive and each value is found to a few units
    of its own last place."""
    eps = np.finfo(np.float64).eps
    scale = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if scale == 0:
        return np.zeros(len(diagonal))
    b, c = diagonal / scale, above / scale
    found: list[float] = []
    # parts that a zero in the superdiagonal leaves apart; a zero on the diagonal
    # gives a zero value and is found by an unshifted step
    work = [(b * b, c * c, 0.0)]
    while work:
        q, e, total = work.pop()
        n = len(q)
        for k in range(n - 1):
            if e[k] <= (eps * eps) * max(q[k], 0.0) or e[k] <= np.finfo(float).tiny:
                work += [(q[: k + 1], e[:k], total), (q[k + 1 :], e[k + 1 :], total)]
                break
        else:
            if n == 1:
                found.append(max(total + q[0], 0.0))
            else:
                work.append(_advance(q, e, total, eps, found))
    return scale * np.sqrt(np.sort(np.array(found))[::-1])


def _advance(q: np.ndarray, e: np.ndarray, total: float, eps: float, found: list[float]) -> tuple:
    """A dqds step on an unreduced part; its last values leave when they have settled."""
    n = len(q)
    if e[-1] <= eps * eps * (total + q[-1]) or q[-1] == 0 and total == 0 and e[-1] == 0:
        found.append(total + q[-1])
        return q[:-1], e[:-1], total
    if n == 2:
        # the two values of [[q1, sqrt], [0, q2]]: larger root first, the other from the product
        s = q[0] + q[1] + e[0]
        root = np.sqrt(max((q[0] - q[1] + e[0]) ** 2 + 4 * q[1] * e[0], 0.0))
        large = 0.5 * (s + root)
        found.append(total + large)
        return np.array([q[0] * q[1] / large]), np.zeros(0), total
    # a lower bound of the least value by the trailing 2 x 2 block, less a margin
    a, g, t = q[-2], e[-1], q[-1]
    s = a + t + g
    least = a * t / max(0.5 * (s + np.sqrt(max((a - t + g) ** 2 + 4 * t * g, 0.0))), np.finfo(float).tiny)
    shift = max(0.0, least - np.sqrt(max(least * e[-2], 0.0))) if e[-2] < least else 0.0
    for factor in (0.98, 0.5, 0.1, 0.0):
        q2, e2, low = _dqds_step(q, e, factor * shift)
        if low >= 0 and np.isfinite(q2).all() and np.isfinite(e2).all():
            return q2, e2, total + factor * shift
    # an unshifted step of non-negative numbers stays non-negative
    return q2, e2, total


def _twisted_vector(b: np.ndarray, c: np.ndarray, value: float) -> np.ndarray:
    """A right singular vector of the unreduced bidiagonal (b, c) for the eigenvalue
    ``value`` of BᵀB: the top-down and the bottom-up factorisation of BᵀB - value I
    meet where the pivot is least."""
    n = len(b)
    if n == 1:
        return np.ones(1)
    diag = b * b
    diag[1:] += c * c
    off = b[:-1] * c
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    # stationary (top-down) with s, progressive (bottom-up) with p, in differential form
    low, up = np.empty(n - 1), np.empty(n - 1)
    s, p = np.empty(n), np.empty(n)
    s[0] = -value
    for k in range(n - 1):
        pivot = b[k] * b[k] + s[k]
        pivot = pivot if pivot else -tiny
        low[k] = off[k] / pivot
        s[k + 1] = low[k] * c[k] / b[k] * s[k] - value if b[k] else c[k] * c[k] - low[k] * off[k] - value
    p[-1] = b[-1] * b[-1] - value
    for k in range(n - 2, -1, -1):
        pivot = c[k] * c[k] + p[k + 1]
        pivot = pivot if pivot else -tiny
        up[k] = off[k] / pivot
        p[k] = p[k + 1] * b[k] * b[k] / pivot - value
    gamma = s + p + value
    r = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[r] = 1.0
    for k in range(r - 1, -1, -1):
        z[k] = -low[k] * z[k + 1]
    for k in range(r, n - 1):
        z[k + 1] = -up[k] * z[k]
    return z / np.linalg.norm(z)


def _inverse_step(b: np.ndarray, c: np.ndarray, value: float, x: np.ndarray) -> np.ndarray:
    """(BᵀB - value I)⁻¹ x by elimination with a small perturbation of zero pivots."""
    n = len(b)
    diag = b * b - value
    diag[1:] += c * c
    off = b[:-1] * c
    full = np.diag(diag) + np.diag(off, 1) + np.diag(off, -1)
    full[np.diag_indices(n)] += np.finfo(float).eps * max(np.abs(diag).max(), value)
    y = np.linalg.solve(full, x)
    return y / np.linalg.norm(y)


def leading_directions(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of ``r`` (falling) and its right singular vectors
    (columns)."""
    d = len(r)
    b, c, right = bidiagonalise(r)
    eps = np.finfo(float).eps
    # a negligible superdiagonal entry leaves parts with vectors of their own
    cuts = [0, *(k + 1 for k in range(d - 1) if abs(c[k]) <= eps * (abs(b[k]) + abs(b[k + 1]))), d]
    pairs = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        pairs += [(v, lo, hi) for v in dqds(b[lo:hi], c[lo : hi - 1])]
    pairs.sort(key=lambda x: -x[0])
    values, vectors, spans = [], [], []
    for v, lo, hi in pairs[:count]:
        lam = v * v
        z = _twisted_vector(b[lo:hi], c[lo : hi - 1], lam)
        close = [w[lo:hi] for w, u, s in zip(vectors, values, spans, strict=True) if s == (lo, hi) and u * u - lam <= CLUSTER * u * u]
        for _ in range(3 if close else 0):
            for w in close:
                z = z - (w @ z) * w
            if np.linalg.norm(z) < 1e-3:   # the same direction again: start from another one
                z = np.random.default_rng(5).standard_normal(hi - lo)
                for w in close:
                    z = z - (w @ z) * w
            z = _inverse_step(b[lo:hi], c[lo : hi - 1], lam, z / np.linalg.norm(z))
        for w in close:
            z = z - (w @ z) * w
        full = np.zeros(d)
        full[lo:hi] = z / np.linalg.norm(z)
        values.append(v)
        vectors.append(full)
        spans.append((lo, hi))
    return np.array(values), right @ np.column_stack(vectors) if vectors else np.zeros((d, 0))


# ---------------------------------------------------------------- Spark


_TRIANGLE = pa.schema([("part", pa.int32()), ("r", pa.binary())])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n: the whole steps of the mean are taken off exactly first."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    part = np.array([(s % n) / n for s in sums], np.float64)
    return (x - whole) - part


def _factor(n: int, sums: list[int], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for batch in batches:
            x = _matrix(batch.column(0))
            for i in range(0, len(x), ROWS):
                r = triangle(np.vstack([r, _centred(x[i : i + ROWS], n, sums)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([r.tobytes()], pa.binary())], schema=_TRIANGLE)

    return run


def _stack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for batch in batches:
            for body in batch.column(1).to_pylist():
                r = triangle(np.vstack([r, np.frombuffer(body).reshape(size, size)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([r.tobytes()], pa.binary())], schema=_TRIANGLE)

    return run


def blockwise_triangle(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows of ``vectors`` (x): factored in tasks, then the
    triangles of groups of tasks, until TRIANGLES are left."""
    size = len(sums)
    parts = vectors.select("x").mapInArrow(_factor(n, sums, size), "part int, r binary")
    parts = parts.repartition(TRIANGLES).mapInArrow(_stack(size), "part int, r binary")
    stacked = [np.frombuffer(r["r"]).reshape(size, size) for r in parts.collect()]
    return triangle(np.vstack(stacked)) if stacked else np.zeros((size, size))


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained,
    identity_error."""
    spark = vectors.sparkSession
    ship_package(spark)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integer_vectors(vectors)
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    size = most["d"]
    rows = rows.where(F.size("x") == size)
    fit = store(rows.select("x").distinct(), "whitening-fit")
    total = fit.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("x")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(size))).first()
    n, sums = total["n"], [int(total[f"s{i}"]) for i in range(size)]
    r = blockwise_triangle(fit, n, sums)
    values, directions = leading_directions(r, min(components, size))
    variance = float(np.sum(r * r)) / n
    eigen = values * values / n
    live = eigen > RANK * max(eigen.max(initial=0.0), np.finfo(float).tiny)
    eigen, directions = eigen[live], directions[:, live]
    if not len(eigen):
        release(fit)
        return spark.createDataFrame([], schema)
    scaled = directions / np.sqrt(eigen)
    error = _identity_error(fit, n, sums, scaled)
    release(fit)
    explained = [float(e / variance) for e in eigen]
    return rows.mapInArrow(_project(n, sums, scaled, explained, error), schema)


def _identity_error(fit: DataFrame, n: int, sums: list[int], scaled: np.ndarray) -> float:
    """Largest entry of the whitened fit list's covariance less the identity; the
    whitened values are centred before they are multiplied."""
    k = scaled.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _centred(_matrix(batch.column(0)), n, sums) @ scaled
            yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(k)], names=names)

    names = [f"w{i}" for i in range(k)]
    w = fit.select("x").mapInArrow(run, ", ".join(f"{c} double" for c in names))
    mean = w.agg(*(F.avg(c).alias(c) for c in names)).first()
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    centred = [F.col(c) - F.lit(mean[c]) for c in names]
    cov = w.agg(*((F.sum(centred[i] * centred[j]) / n).alias(f"c{i}_{j}") for i, j in cells)).first()
    return max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in cells)


def _project(n: int, sums: list[int], scaled: np.ndarray, explained: list[float], error: float):
    k = scaled.shape[1]
    limit = 2**63 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            w = _centred(x, n, sums) @ scaled
            reach = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
            if len(sums) * reach * reach <= limit:
                off = n * x - np.array(sums, np.int64)
                deviation = (off * off).sum(axis=1).tolist()
            else:
                off = n * x.astype(object) - np.array(sums, object)
                deviation = [v if v <= limit else None for v in (off * off).sum(axis=1)]
            rows = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n)),
                    pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run
