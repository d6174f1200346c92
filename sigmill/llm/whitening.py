"""Whitening of embeddings by their leading principal components.

Entries become whole numbers first, so counts, sums and deviations are exact.
Partitions sum the products of their centred vectors, Spark adds the partial
matrices, and only the finished d x d matrix goes to the driver, whatever the
number of rows. There Householder reflections make it tridiagonal, bisection
on Sturm counts finds the leading eigenvalues, and inverse iteration, with
vectors of close eigenvalues kept orthogonal, finds their vectors. The few
components are broadcast, and every row is projected where it lies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import matrix, named, width

SCALE, SHIFT = 1024, 100_000
#: A number of a larger size has no place in a long once scaled; its vector counts as holding no finite number.
LARGEST = float(1 << 52)
LONG = 1 << 63
#: Eigenvalues nearer than this share of the largest are a cluster, whose vectors are kept orthogonal one to another.
CLOSE = 1e-3
#: An eigenvalue up to this share of the largest is none: its component can't be scaled to one.
NOTHING = 1e-12


@dataclass(frozen=True)
class Whitening:
    """n vectors, their sums by dimension, and the components (rows of `components`) by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace if len(self.eigenvalues) else self.eigenvalues


def whole(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors).astype(np.int64) + SHIFT


def total(x: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    if len(x) and float(np.abs(x).max()) * len(x) < LONG / 2:
        return x.sum(0).tolist()
    return x.astype(object).sum(0).tolist() if len(x) else [0] * x.shape[1]


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - sums / n, rounded once: the whole part of the mean is taken off before anything is a double."""
    return (x - np.array([s // n for s in sums], np.int64)) - np.array([s % n for s in sums]) / n


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Exact sum over dimensions of (n x - sums)^2 of each row; None where that is no long."""
    from_mean = x - np.array([s // n for s in sums], np.int64)
    most = n * (float(np.abs(from_mean).max()) + 1) if from_mean.size else 0.0
    kind = np.int64 if most < 2**53 and most * most * x.shape[1] < LONG / 2 else object
    rest = n * from_mean.astype(kind) - np.array([s % n for s in sums], kind)
    return [v if v < LONG else None for v in (rest * rest).sum(1).tolist()] if from_mean.size else [0] * len(x)


def sums(rows: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """How many usable vectors there are, and their sums by dimension."""

    def run(batches):
        n, at = 0, [0] * d
        for batch in batches:
            _, v = matrix(batch.column("vec"), d, LARGEST)
            n += len(v)
            at = [a + b for a, b in zip(at, total(whole(v)), strict=True)]
        # Decimals hold what a long can't.
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, d), pa.int32()), "s": pa.array([str(x) for x in (n, *at)])})

    found = rows.select("vec").mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    by = {r.i: int(r.s) for r in found.collect()}  # one number for each dimension
    return by.get(-1, 0), tuple(by.get(i, 0) for i in range(d))


def products(rows: DataFrame, made, k: int) -> np.ndarray:
    """The sum over all rows of y y', where `made` gives the k-wide matrix of rows y of a batch."""

    def run(batches):
        at = np.zeros((k, k))
        for batch in batches:
            y = made(batch)
            at += y.T @ y
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": at[i, j]})

    out = np.zeros((k, k))
    # A row for each pair of dimensions: its size is the width's, not the table's.
    for r in rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def covariance(rows: DataFrame, n: int, sums_: tuple[int, ...]) -> np.ndarray:
    d = len(sums_)
    return products(rows.select("vec"), lambda batch: centred(whole(matrix(batch.column("vec"), d, LARGEST)[1]), n, sums_), d) / n


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors of a symmetric matrix."""
    a, d = a.copy(), len(a)
    mirrors = []
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size:
            x[0] += np.copysign(size, x[0])
            x /= np.linalg.norm(x)
        mirrors.append(x)
        if size:
            # H A H with H = I - 2 x x' on the rows and columns after k.
            rest = a[k + 1 :, k + 1 :]
            p = rest @ x
            q = p - x * (x @ p)
            rest -= 2 * (np.outer(x, q) + np.outer(q, x))
            column = a[k + 1 :, k] - 2 * x * (x @ a[k + 1 :, k])
            a[k + 1 :, k] = a[k, k + 1 :] = column
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def below(diagonal: np.ndarray, off2: np.ndarray, at: np.ndarray, least: float) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each of `at`, by the signs of the pivots."""
    q = diagonal[0] - at
    count = (q < 0).astype(int)
    for a, b2 in zip(diagonal[1:], off2, strict=True):
        q = a - at - b2 / np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues of a tridiagonal matrix, falling, all bisected at once down to neighbouring doubles."""
    d, off2 = len(diagonal), off * off
    reach = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    bound = max(float(np.abs(diagonal).max() + reach.max()), np.finfo(float).tiny)
    least = max(np.finfo(float).tiny, np.finfo(float).eps ** 2 * bound)
    wanted = d - np.arange(1, k + 1)  # eigenvalue number i has this many below it
    low, high = np.full(k, -bound * (1 + 1e-9)), np.full(k, bound * (1 + 1e-9))
    for _ in range(2000):
        middle = (low + high) / 2
        if np.all((middle == low) | (middle == high) | (high - low <= np.finfo(float).eps * np.abs(middle))):
            break
        under = below(diagonal, off2, middle, least) <= wanted
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


def solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; pivots of next to nothing become `least`."""
    d = len(diagonal)
    main, up, up2, low, x = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * d, off.tolist(), b.tolist()
    for i in range(d - 1):
        if abs(low[i]) > abs(main[i]):
            main[i], low[i] = low[i], main[i]
            up[i], main[i + 1] = main[i + 1], up[i]
            up2[i], up[i + 1] = up[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(main[i]) < least:
            main[i] = least
        f = low[i] / main[i]
        main[i + 1] -= f * up[i]
        up[i + 1] -= f * up2[i]
        x[i + 1] -= f * x[i]
    if abs(main[-1]) < least:
        main[-1] = least
    for i in range(d - 1, -1, -1):
        after = (up[i] * x[i + 1] if i + 1 < d else 0.0) + (up2[i] * x[i + 2] if i + 2 < d else 0.0)
        x[i] = (x[i] - after) / main[i]
    return np.array(x)


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) by inverse iteration, made orthogonal within clusters of close eigenvalues."""
    random, size = np.random.default_rng(0), float(np.abs(values).max(initial=0))
    least = np.finfo(float).eps * max(size, np.finfo(float).tiny)
    out = np.zeros((len(values), len(diagonal)))
    first = 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLOSE * size:
            first = i
        x = random.standard_normal(len(diagonal))
        for _ in range(5):
            x = solve(diagonal, off, float(value), x / np.linalg.norm(x), least)
            x /= np.abs(x).max()
            for _ in range(2):  # twice is enough
                x -= out[first:i].T @ (out[first:i] @ x)
                x /= np.linalg.norm(x)
        out[i] = x
    return out


def principal(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The (at most) k largest eigenvalues of a covariance that aren't nothing beside the largest, falling, and their unit vectors as rows."""
    d = len(cov)
    size = float(np.abs(cov).max(initial=0))
    if not size:
        return np.empty(0), np.empty((0, d))
    diagonal, off, mirrors = tridiagonal(cov / size)
    values = leading(diagonal, off, min(k, d))
    values = values[values > NOTHING * values[0]]
    vectors = vectors_of(diagonal, off, values)
    for at in range(len(mirrors) - 1, -1, -1):
        x = mirrors[at]
        vectors[:, at + 1 :] -= 2 * np.outer(vectors[:, at + 1 :] @ x, x)
    largest = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)]
    return values * size, vectors * np.sign(largest)[:, None]


def fit(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8) -> Whitening:
    """The leading components of all usable vectors of `rows`; none where nothing varies or there is no row."""
    rows = named(rows, id_col, vec_col)
    d = width(rows)
    n, by = sums(rows, d) if d else (0, ())
    if not n:
        return Whitening(0, (0,) * d, np.empty(0), np.empty((0, d)), 0.0)
    cov = covariance(rows, n, by)
    values, vectors = principal(cov, k)
    return Whitening(n, by, values, vectors, float(np.trace(cov)))


def _projected(w: Whitening):
    root = np.sqrt(w.eigenvalues)

    def made(x: np.ndarray) -> np.ndarray:
        return centred(x, w.n, w.sums) @ w.components.T / root

    return made


def transform(rows: DataFrame, w: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, deviation, whitened) of every usable row; whitened has a number for each component of `w`."""
    d, sent = len(w.sums), rows.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        w = sent.value
        project = _projected(w)
        for batch in batches:
            places, v = matrix(batch.column("vec"), d, LARGEST)
            x = whole(v)
            far = deviations(x, w.n, w.sums) if w.n else []
            y = project(x) if w.n else np.empty((0, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(places)), pa.array(far, pa.int64()), lists], ["id", "deviation", "whitened"])

    return named(rows, id_col, vec_col).mapInArrow(run, "id long, deviation long, whitened array<double>")


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """How far the covariance of `whitened`, centred once more, is from the identity: its largest entry."""
    if not n or not k:
        return 0.0
    one = white.select(*[F.col("whitened")[i].alias(f"w{i}") for i in range(k)])
    mean = np.array(one.agg(*[F.avg(c) for c in one.columns]).first())
    cov = products(one, lambda batch: np.column_stack([c.to_numpy() for c in batch.columns]) - mean, k) / n
    return float(np.abs(cov - np.eye(k)).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8) -> DataFrame:
    """Every usable row by its id: n, deviation, whitened and explained (arrays by component), identity_error.

    Left out are vectors that are null or hold a null, a NaN, an infinity or a
    number of more than 2^52. Null ids and repeated rows are rows like others;
    ties of eigenvalues leave any orthogonal choice; shorter vectors count as
    filled up with zeros. Where fewer than k components vary at all (one row,
    equal rows, narrow vectors) the arrays are shorter. A deviation that is no
    long is null. No rows give no rows; other columns are not read.
    """
    w = fit(rows, id_col, vec_col, k)
    white = transform(rows, w, id_col, vec_col)
    error = identity_error(white, w.n, len(w.eigenvalues))
    explained = F.array(*[F.lit(float(x)) for x in w.explained]).cast("array<double>")
    return white.select(F.col("id").alias(id_col), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op13_embedding_whitening(spark, sf_dir):
    from .common import table

    found = whiten(table(spark, sf_dir, "embeddings"))
    by = found.select("vec_id", F.posexplode("whitened").alias("i", "whitened"), "n", "deviation", "explained", "identity_error")
    return by.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("i")].alias("explained"), "identity_error")
