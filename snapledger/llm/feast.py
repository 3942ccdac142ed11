"""Whitening of embeddings by FEAST: contour integration finds the largest eigenvalues of the covariance interval by
interval, and inertia counts prove that none is missed.

1. Every entry becomes the integer floor(`SCALE` * entry) + `SHIFT`. Tasks add up integers (sums, then products of
   differences from the floor of the mean), Spark adds the tasks' parts, so the covariance is exact up to its one
   rounding and doesn't depend on partitions or repeated tasks. The driver holds it: width times width numbers,
   whatever the number of rows, and the width is at most `WIDEST`.
2. Inertia: by Sylvester's law the signs of the pivots of V - s, factored symmetrically, count the eigenvalues on either
   side of s. Bisection by these counts cuts the wanted end of the spectrum into intervals with at most `PER_INTERVAL`
   eigenvalues each, whose borders lie in gaps.
3. Each interval is a row of a DataFrame and a task of its own: from a random block, Gauss-Legendre quadrature over a
   circle around the interval adds up solutions with V shifted by complex numbers, which projects onto the interval's
   eigenvectors; Rayleigh-Ritz takes them out; both repeat until residuals are down at rounding. A task that finds
   another number of eigenvalues than the inertia count says takes a larger block, and raises in the end.
4. A last Rayleigh-Ritz step over all intervals together, then one pass whitens and one measures the covariance of
   what was whitened.

Defined results: vectors that are null or hold a null or non-finite entry, or one of at least 2**36, are dropped; so
are those of another length than the most frequent one (ties: the longer), as they have no covariance with the others.
Components with an eigenvalue of zero (below `RANK` of the largest) have no rows, as they can't be whitened; so equal
vectors alone, one vector, empty vectors or an empty table give no rows. `deviation` is null where it doesn't fit a long.
Repeated rows count each, a null vec_id is kept, other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
WIDEST = 1024
PER_INTERVAL = 4
NODES = 8  # of the quadrature over the upper half circle
RANK = 1e-11  # below it rounding of the covariance reaches the fifth digit of an eigenvalue
LIMIT = 2.0**36
GAP = 1e-6  # a border's distance to the next eigenvalue, relative
SPAN = 1 << 62


# -- Exact sums ---------------------------------------------------------------------------------------------------


def _integers(batch: pa.RecordBatch, width: int) -> np.ndarray:
    entries = batch["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(entries * SCALE).astype(np.int64).reshape(-1, width) + SHIFT


def _parts(values: np.ndarray) -> list[Decimal]:
    return [Decimal(int(v)) for v in values.ravel()]


def _sums(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for batch in batches:
            if batch.num_rows:
                x = _integers(batch, width)
                n, total = n + len(x), total + x.sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([_parts(total)], pa.list_(pa.decimal128(38, 0)))], ["n", "part"])

    return run


def _products(width: int, middle: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        for batch in batches:
            if batch.num_rows:
                d = _integers(batch, width) - middle
                if int(np.abs(d).max()) ** 2 * len(d) < 1 << 53:  # exact in doubles
                    total = total + (d.astype(np.float64).T @ d.astype(np.float64)).astype(np.int64).astype(object)
                else:
                    total = total + d.astype(object).T @ d.astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([_parts(total)], pa.list_(pa.decimal128(38, 0)))], ["part"])

    return run


def _added(parts: DataFrame, size: int) -> np.ndarray:
    """The parts of all tasks, added place by place in Spark; as many numbers as a part has."""
    rows = parts.select(F.posexplode("part").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size, object)
    for at, v in zip(rows["at"].to_pylist(), rows["v"].to_pylist()):
        out[at] = int(v)
    return out


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The rows that can be whitened, and their length."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < LIMIT))  # NaN is above all in Spark
    rows = vectors.where(whole).select("vec_id", "embedding")
    lengths = rows.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("width")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("width")).first()
    width = most["width"] if most else 0
    if width > WIDEST:
        raise ValueError(f"vectors have {width} entries; at most {WIDEST} are supported")
    return rows.where(F.size("embedding") == width), width


def moments(rows: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums per dimension as integers, and the covariance, divisor n, rounded once."""
    found = rows.select("embedding").mapInArrow(_sums(width), "n long, part array<decimal(38,0)>")
    n = found.agg(F.sum("n")).first()[0]
    sums = _added(found, width)
    middle = np.array([int(s) // n for s in sums], np.int64)
    parts = rows.select("embedding").mapInArrow(_products(width, middle), "part array<decimal(38,0)>")
    products = _added(parts, width * width).reshape(width, width)
    rest = sums - n * middle.astype(object)
    exact = n * products - np.outer(rest, rest)
    return n, sums, np.array([[int(v) / n**2 for v in row] for row in exact])


# -- Eigenvalues --------------------------------------------------------------------------------------------------


def above(v: np.ndarray, s: float) -> int:
    """How many eigenvalues of the symmetric `v` exceed s: the positive pivots of v - s, factored symmetrically with
    the largest pivot first, single or two by two (such a block has one sign of each)."""
    a, count = v - s * np.eye(len(v)), 0
    while len(a):
        diagonal = np.abs(a.diagonal())
        i = int(diagonal.argmax())
        off = np.abs(a - np.diag(a.diagonal()))
        j, k = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[i] >= 0.64 * off[j, k]:
            if diagonal[i] == 0:
                break
            taken, count = [i], count + int(a[i, i] > 0)
        else:
            taken, count = [int(j), int(k)], count + 1
        rest = np.delete(np.arange(len(a)), taken)
        a = a[np.ix_(rest, rest)] - a[np.ix_(rest, taken)] @ np.linalg.solve(a[np.ix_(taken, taken)], a[np.ix_(taken, rest)])
        a = (a + a.T) / 2
    return count


def _border(v: np.ndarray, s: float, floor: float) -> float:
    """s, or a value somewhat below it, with no eigenvalue close to it; `floor` where all the way down is crowded."""
    while s > floor and above(v, s * (1 - GAP)) != above(v, s * (1 + GAP)):
        s *= 1 - 3 * GAP
    return max(s, floor)


def intervals(v: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(a, b, eigenvalues in it), from the top down, that hold the k largest eigenvalues, or all above zero."""
    top = float(np.abs(v).sum(1).max()) * (1 + 1e-3)
    floor = RANK * top
    if not top or not above(v, floor):
        return []
    out, work = [], [(floor, top, above(v, floor), 0)]  # of a pair of halves the upper is worked on first
    while work and sum(c for *_, c in out) < k:
        a, b, low, high = work.pop()
        middle = (a * b) ** 0.5 if b > 4 * a else (a + b) / 2
        border = _border(v, middle, a)
        if low - high <= PER_INTERVAL and b < 4 * a or border <= a or b - a <= 8 * GAP * b:
            if low > high:
                out.append((a, b, low - high))
            continue
        between = above(v, border)
        if low > between:
            work.append((a, border, low, between))
        if between > high:
            work.append((border, b, between, high))
    return out


def projected(v: np.ndarray, a: float, b: float, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues between a and b and their vectors (columns), `count` of them by the inertia."""
    width, norm = len(v), float(np.abs(v).sum(1).max())
    x, w = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(0.5j * np.pi * (1 - x))
    centre, radius = (a + b) / 2, (b - a) / 2
    draw = np.random.default_rng(seed)
    for size in (2 * count + 4, 4 * count + 16, width):
        size = min(size, width)
        block, worst = draw.standard_normal((width, size)), math.inf
        for _ in range(40):
            q = np.zeros((width, size))
            for weight, z in zip(w, turn):
                q += (weight / 2) * radius * np.real(z * np.linalg.solve((centre + radius * z) * np.eye(width) - v, block))
            q, _ = np.linalg.qr(q)
            values, small = np.linalg.eigh(q.T @ v @ q)
            block = q @ small
            inside = (values > a) & (values <= b)
            left = np.abs(v @ block[:, inside] - block[:, inside] * values[inside]).max(initial=0.0)
            if int(inside.sum()) == count and (left <= 1e-15 * norm or worst <= 1e-13 * norm and left >= worst / 2):
                return values[inside], block[:, inside]
            worst = left if int(inside.sum()) == count else math.inf
    raise ArithmeticError(f"{count} eigenvalues lie between {a} and {b} by inertia, and not all were found")


def _solved(v: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                values, vectors = projected(v, r["a"], r["b"], r["c"], r["seed"])
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(vectors.T.tolist(), pa.list_(pa.float64()))], ["e", "u"])

    return run


def components(spark: SparkSession, v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues above zero, falling, and their unit vectors (columns); each interval in a Spark task."""
    parts = intervals(v, k)
    if not parts:
        return np.zeros(0), np.zeros((len(v), 0))
    rows = spark.createDataFrame([(a, b, c, seed) for seed, (a, b, c) in enumerate(parts)], "a double, b double, c int, seed int")
    found = rows.repartition(len(parts), "seed").mapInArrow(_solved(v), "e double, u array<double>").collect()
    basis, _ = np.linalg.qr(np.array([r["u"] for r in found]).T)
    values, small = np.linalg.eigh(basis.T @ v @ basis)
    order = np.argsort(values)[::-1][:k]
    return values[order], basis @ small[:, order]


# -- Whitening ----------------------------------------------------------------------------------------------------


def _centred(batch: pa.RecordBatch, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """x, x - S/n, and the sum over dimensions of (n*x - S)**2 of each row."""
    x = _integers(batch, len(sums))
    if n * max(int(x.max()), -int(x.min())) < SPAN and max(map(abs, sums.tolist())) < SPAN:
        far = n * x - sums.astype(np.int64)
        near = far / n
        if int(np.abs(far).max()) ** 2 * len(sums) < SPAN:
            return x, near, (far * far).sum(1).tolist()
        far = far.astype(object)
    else:
        far = n * x.astype(object) - sums
        near = (far / n).astype(np.float64)
    exact = (far * far).sum(1).tolist()
    return x, near, [d if d < 1 << 63 else None for d in exact]


def _errors(n: int, sums: np.ndarray, turned: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((turned.shape[1],) * 2)
        for batch in batches:
            if batch.num_rows:
                y = _centred(batch, n, sums)[1] @ turned  # of mean zero, as x - S/n is
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["part"])

    return run


def _whitened(n: int, sums: np.ndarray, turned: np.ndarray, explained: np.ndarray, error: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = turned.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            _, near, deviation = _centred(batch, n, sums)
            row = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays([
                batch["vec_id"].take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)),
                pa.array(deviation, pa.int64()).take(pa.array(row)), pa.array((near @ turned).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark = vectors.sparkSession
    rows, width = usable(vectors.withColumn("vec_id", F.col("vec_id").cast("long")))
    if not width:
        return spark.createDataFrame([], SCHEMA)
    n, sums, v = moments(rows, width)
    values, vectors_ = components(spark, v, k)
    k = len(values)
    if not k:
        return spark.createDataFrame([], SCHEMA)
    turned = vectors_ / np.sqrt(values)
    parts = rows.select("embedding").mapInArrow(_errors(n, sums, turned), "part array<double>")
    found = parts.select(F.posexplode("part").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()  # k * k rows
    identity = np.eye(k).ravel()
    error = max(abs(r["v"] / n - identity[r["at"]]) for r in found)
    return rows.mapInArrow(_whitened(n, sums, turned, values / np.trace(v), float(error)), SCHEMA)


def op13_feast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
