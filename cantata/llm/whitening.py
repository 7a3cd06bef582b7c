"""Embedding whitening: distributed moments, an eigensolver for the covariance, and a broadcast projection."""
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100000
#: Whole numbers up to here are exact as doubles.
EXACT = 2.0**53


def entries(column, width: int):
    """(kept, x): which rows of an Arrow list column are vectors of `width` finite entries, and those as whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    fits = (size == width) & np.asarray(column.is_valid())
    flat = column.filter(pa.array(fits)).flatten()
    v = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)  # null becomes NaN
    good = np.isfinite(v).all(axis=1)
    x = np.floor(SCALE * v[good]) + SHIFT
    if x.size and np.abs(x).max() >= EXACT:
        raise OverflowError(f"an entry passes {EXACT / SCALE:.0f}")
    kept = fits.copy()
    kept[fits] = good
    return kept, x.astype(np.int64)


def _merged(a, b):
    """Moments (n, sums, scatter) of two sets of rows, each scatter centred on the means of its own set."""
    if a is None:
        return b
    n = a[0] + b[0]
    # Whole numbers as long as they fit a double, so the distance of the means is rounded once.
    d = b[1] / b[0] - a[1] / a[0]
    return n, a[1] + b[1], a[2] + b[2] + np.outer(d, d) * (a[0] * (b[0] / n))


def _moments(x):
    """Moments of the rows of x, centred before multiplying."""
    n, s = len(x), x.sum(axis=0)
    d = x - s / n
    return n, s, d.T @ d


def moments(vectors: DataFrame, batch_moments, whole: bool, width: int):
    """(n, sums, scatter) over all rows, `batch_moments` of Arrow batches merged in the tasks and their results merged by Spark.

    A task gives one row for each coordinate. These are summed in two steps, by
    task counts and sums first and by scatters about the common mean then, so
    what meets in one place is one number for each task and pair of coordinates.
    """
    schema = f"i int, n long, s {'decimal(38,0)' if whole else 'double'}, means array<double>, scatter array<double>"

    def run(batches):
        m = None
        for b in batches:
            got = batch_moments(b)
            if got[0]:
                m = _merged(m, got)
        if m:
            n, s, c = m
            means = (np.asarray(s, float) / n).tolist()
            kind = pa.decimal128(38, 0) if whole else pa.float64()
            sums = [int(v) for v in s] if whole else [float(v) for v in s]
            rows = [range(width), [n] * width, sums, [means] * width, c.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int32(), pa.int64(), kind, pa.list_(pa.float64()), pa.list_(pa.float64())))], ["i", "n", "s", "means", "scatter"])

    parts = checkpoint(vectors.mapInArrow(run, schema))
    total = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()  # one row for each coordinate
    if not total:
        return 0, np.zeros(width), np.zeros((width, width))
    n, s = total[0].n, [int(r.s) if whole else r.s for r in total]
    mean = F.array(*[F.lit(float(v / n)) for v in s])
    # Chan's rule: the scatter about the common mean is the task's own, and n times the product of the distances of its means.
    own = parts.withColumn("c", mean).select("i", F.posexplode(F.zip_with("scatter", F.zip_with("means", "c", lambda a, b: a - b), lambda v, d: F.struct(v.alias("v"), d.alias("d")))).alias("j", "x"), "n", (F.get("means", F.col("i")) - F.get("c", F.col("i"))).alias("d"))
    cells = own.groupBy("i", "j").agg(F.sum(F.col("x.v") + F.col("n") * F.col("d") * F.col("x.d")).alias("v")).toArrow()  # width squared rows
    scatter = np.zeros((width, width))
    scatter[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["v"].to_numpy()
    return n, s, (scatter + scatter.T) / 2


def tridiagonal(a):
    """Householder reduction of a symmetric matrix: (diagonal, off-diagonal, reflectors), where each reflector v stands for I - 2vv' on the rows behind its own."""
    a, d = np.array(a, float), len(a)
    vectors = []
    for k in range(d - 2):
        x = a[k + 1:, k]
        size = np.abs(x).max()
        if size == 0:
            vectors.append(None)
            continue
        v = x / size
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        p = a[k + 1:, k + 1:] @ v
        w = 2 * (p - (v @ p) * v)
        block = np.outer(v, w)
        a[k + 1:, k + 1:] -= block + block.T
        a[k + 1:, k] -= 2 * (v @ x) * v
        a[k, k + 1:] = a[k + 1:, k]
        vectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), vectors


def above(diag, off, at):
    """Sturm counts: how many eigenvalues of the tridiagonal matrix exceed each value of `at`."""
    tiny = np.finfo(float).tiny * max(1.0, (off**2).max(initial=0))
    count, q = np.zeros(len(at), int), np.ones(len(at))
    for i, a in enumerate(diag):
        q = a - at - (off[i - 1] ** 2 / q if i else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q > 0
    return count


def leading(diag, off, k: int):
    """The k largest eigenvalues, falling, by bisection of Sturm counts from Gershgorin's bounds."""
    reach = np.concatenate(([0], np.abs(off))) + np.concatenate((np.abs(off), [0]))
    low, high = np.full(k, (diag - reach).min()), np.full(k, (diag + reach).max())
    pad = 1e-15 * max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    low, high, want = low - pad, high + pad, np.arange(1, k + 1)
    for _ in range(200):
        mid = (low + high) / 2
        more = above(diag, off, mid) >= want
        low, high = np.where(more, mid, low), np.where(more, high, mid)
        if not ((low < (low + high) / 2) & ((low + high) / 2 < high)).any():
            break
    return (low + high) / 2


def _solver(diag, off, at):
    """The factors of T - at by elimination with row exchanges, as a function that solves for a right side."""
    n, eps = len(diag), np.finfo(float).eps * max(np.abs(diag).max(), np.abs(off).max(initial=0), np.finfo(float).tiny)
    u, v, w, mult, swap = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, bool)
    a, b = diag[0] - at, off[0] if n > 1 else 0.0
    for i in range(n - 1):
        c, x, y = off[i], diag[i + 1] - at, off[i + 1] if i + 2 < n else 0.0
        if abs(c) > abs(a):
            swap[i], mult[i] = True, a / c
            u[i], v[i], w[i] = c, x, y
            a, b = b - mult[i] * x, -mult[i] * y
        else:
            mult[i] = c / a if a else 0.0
            u[i], v[i] = a, b
            a, b = x - mult[i] * b, y
    u[n - 1] = a
    u = np.where(np.abs(u) < eps, eps, u)

    def solve(r):
        r = np.array(r)
        for i in range(n - 1):
            if swap[i]:
                r[i], r[i + 1] = r[i + 1], r[i] - mult[i] * r[i + 1]
            else:
                r[i + 1] -= mult[i] * r[i]
        for i in range(n - 1, -1, -1):
            r[i] = (r[i] - (v[i] * r[i + 1] if i + 1 < n else 0) - (w[i] * r[i + 2] if i + 2 < n else 0)) / u[i]
        return r

    return solve


def tridiagonal_vectors(diag, off, values):
    """Unit eigenvectors (rows) of the falling `values` by inverse iteration; those of a cluster are made orthogonal to each other at every step."""
    scale = max(np.abs(diag).max(), np.abs(off).max(initial=0), np.finfo(float).tiny)
    out, first, rng = [], 0, np.random.default_rng(7)
    for k, e in enumerate(values):
        if k and values[k - 1] - e > 1e-3 * scale:
            first = k
        # Equal values get shifts a little apart, so that their systems differ.
        solve = _solver(diag, off, e - 2 * np.finfo(float).eps * scale * (k - first))
        v = rng.standard_normal(len(diag))
        for _ in range(6):
            for _ in range(2):  # twice is enough for full orthogonality
                for b in out[first:]:
                    v = v - (b @ v) * b
            v = solve(v / np.linalg.norm(v))
            v /= np.linalg.norm(v)
        for _ in range(2):
            for b in out[first:]:
                v = v - (b @ v) * b
            v /= np.linalg.norm(v)
        out.append(v)
    return np.array(out)


def eigen(cov, k: int):
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows."""
    d = len(cov)
    size = np.abs(cov).max(initial=0)
    if size == 0:
        return np.zeros(k), np.eye(d)[:k]
    diag, off, reflectors = tridiagonal(cov / size)
    values = leading(diag, off, k)
    vectors = tridiagonal_vectors(diag, off, values)
    for i in range(len(reflectors) - 1, -1, -1):
        if (v := reflectors[i]) is not None:
            vectors[:, i + 1:] -= 2 * np.outer(vectors[:, i + 1:] @ v, v)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    return values * size, vectors


class Whitening:
    """What fit() has learned: n, exact sums, eigenvalues, their share of the trace, and the projection (component by coordinate)."""

    def __init__(self, width, n, sums, values, vectors, trace):
        self.width, self.n, self.sums = width, n, sums
        live = values > 1e-12 * max(trace, np.finfo(float).tiny)
        self.live, self.explained = live, np.where(live, values, 0) / trace if trace > 0 else np.zeros(len(values))
        self.projection = vectors / np.sqrt(np.where(live, values, 1))[:, None] * live[:, None]


def width_of(vectors: DataFrame, col: str) -> int:
    """The most common number of entries; of equally common ones the largest."""
    r = vectors.where(F.size(col) > 0).groupBy(F.size(col).alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first()
    return r.m.d if r.m else 0


def fit(vectors: DataFrame, k: int = 8, col: str = "embedding") -> Whitening:
    """Moments of all vectors of the common length, and the k leading components of their covariance."""
    width = width_of(vectors, col)
    if not width:
        return Whitening(0, 0, [], np.zeros(0), np.zeros((0, 0)), 0.0)

    def batch(b):
        x = entries(b.column(0), width)[1] - SHIFT  # small numbers lie closer to their mean's double
        return _moments(x) if len(x) else (0,)

    n, sums, scatter = moments(vectors.select(col), batch, True, width)
    cov, sums = scatter / max(n, 1), [int(v) + n * SHIFT for v in sums]
    return Whitening(width, n, sums, *eigen(cov, min(k, width)), float(np.trace(cov)))


def _centred(x, model):
    """n * x - sums, in whole numbers."""
    if model.n * (np.abs(x).max(initial=0) + 1.0) * 2 >= 2.0**62:
        raise OverflowError("n * x passes 64 bits")
    return model.n * x - np.array(model.sums, np.int64)


def _deviation(y):
    """The sum of squares of each row of y, exact."""
    if y.size and np.abs(y).max() ** 2.0 * y.shape[1] >= 2.0**62:
        out = [sum(int(v) ** 2 for v in row) for row in y]
        if max(out) >= 1 << 63:
            raise OverflowError("a deviation passes 64 bits")
        return np.array(out, np.int64)
    return (y * y).sum(axis=1)


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained) for each kept vector and component."""
    spark, k = vectors.sparkSession, len(model.projection)
    held = spark.sparkContext.broadcast(model)  # k * width numbers
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained"]

    def run(batches):
        m = held.value
        for b in batches:
            if not m.width:
                continue
            kept, x = entries(b.column(1), m.width)
            y = _centred(x, m)
            z = (y / m.n) @ m.projection.T
            ids = b.column(0).filter(pa.array(kept)).take(pa.array(np.repeat(np.arange(len(x)), k)))
            cols = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, m.n, np.int64)), pa.array(np.repeat(_deviation(y), k)), pa.array(z.ravel()), pa.array(np.tile(m.explained, len(x)))]
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), col)
    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double")


def identity_error(vectors: DataFrame, model: Whitening, col: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over components that have variance; 0 where none has."""
    k = int(model.live.sum()) if model.width else 0
    if not k:
        return 0.0
    held = vectors.sparkSession.sparkContext.broadcast(model)

    def batch(b):
        m = held.value
        x = entries(b.column(0), m.width)[1]
        return _moments((_centred(x, m) / m.n) @ m.projection[m.live].T) if len(x) else (0,)

    n, _, scatter = moments(vectors.select(col), batch, False, k)
    return float(np.abs(scatter / n - np.eye(k)).max())


def whitened(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """Fit and apply: (vec_id, component, n, deviation, whitened, explained, identity_error).

    Dropped are rows whose vector is null, empty, holds null or non-finite
    entries, or has another length than most. Null and repeated ids pass
    through, repeated rows count as often as they stand; no rows give no rows,
    and columns beside id and vector are not read. A component without variance
    (fewer distinct vectors than components) has whitened and explained 0.
    Entries or deviations beyond exact 64-bit arithmetic are an error.
    """
    model = fit(vectors, k, col)
    return whiten(vectors, model, id_col, col).withColumn("identity_error", F.lit(identity_error(vectors, model, col)))
