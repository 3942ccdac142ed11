"""Centroid clustering over zone maps: vectors in Hilbert order are cut into blocks that know their least and greatest
value in each dimension, and a block compares its vectors only with centroids that its box leaves possible.

1. Vectors become integers, floor(`SCALE` * component). The curve runs through the `CURVE_DIMENSIONS` dimensions of
   greatest variance, `CURVE_BITS` bits each, and is as fine as the range that the whole table has there.
2. Rows are range-partitioned and sorted by their place on the curve, and a hash of the row after it, so that any
   number of equal vectors is spread over tasks. Every `BLOCK` rows that follow each other are one row of the block
   table, with their box. The table is computed once and kept in the shared folder.
3. A round bounds the squared distances between each block's box and every centroid. A centroid that is farther than
   the one with the least greatest distance all over the box can't be nearest to any vector of the block. The others
   are compared exactly, in integers. Tasks return sums per centroid, Spark adds them, and the driver holds the centroids: k times
   64 integers.

Results don't depend on the order, on partitions or on repeated tasks: everything counted is an integer.

Defined results: a vector with another number of components than `DIMENSION`, with a null or non-finite one, or one
of at least 2**19, for which distances need not fit a long, has no row. Equal vectors get equal clusters. Repeated
rows are counted each. A null vec_id is clustered, and starts no centroid while enough others exist. With fewer than k
vectors there are as many centroids as vectors. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.common import cut

DIMENSION = 64
SCALE = 256
K = 40
ROUNDS = 5
BLOCK = 128
CURVE_DIMENSIONS, CURVE_BITS = 12, 5  # 60 bits: a place on the curve is a long that is not negative
LIMIT = 2.0**19  # of a component
EXACT = 1 << 53  # integers below it are exact in a double


def hilbert_place(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of `cells` (rows, dimensions), integers below 2**bits.

    The bits of all dimensions are turned from the finest subcube up by the reflections and exchanges of the curve,
    then Gray-decoded and interleaved (Skilling 2004).
    """
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in range(len(x)):
            upper = (x[axis] >> level & 1).astype(bool)
            swap = np.where(upper, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[axis] ^= swap
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= turn
    place = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            place = place << 1 | (x[axis] >> level & 1)
    return place


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(np.arange(0, rows * width + 1, width, dtype=np.int32), pa.array(matrix.ravel(), kind))


def _integers(batch: pa.RecordBatch) -> np.ndarray:
    return np.floor(_matrix(batch["embedding"], DIMENSION).astype(np.float64) * SCALE).astype(np.int64)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, least, greatest, sum and sum of squares of each dimension, of this task's rows."""
    n, lo, hi, total, squares = 0, np.full(DIMENSION, np.inf), np.full(DIMENSION, -np.inf), np.zeros(DIMENSION), np.zeros(DIMENSION)
    for batch in batches:
        if batch.num_rows:
            x = _integers(batch).astype(np.float64)
            n, lo, hi = n + len(x), np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0))
            total, squares = total + x.sum(0), squares + (x * x).sum(0)
    if n:
        yield pa.RecordBatch.from_pydict({"axis": np.arange(DIMENSION, dtype=np.int32), "n": np.full(DIMENSION, n), "lo": lo, "hi": hi, "total": total, "squares": squares})


def _placed(axes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    step = np.maximum(hi - lo + 1, 1) / (1 << CURVE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _integers(batch)
                cells = np.clip((x[:, axes] - lo) / step, 0, (1 << CURVE_BITS) - 1)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["tie"], pa.array(hilbert_place(cells, CURVE_BITS)), _lists(x, pa.int32())], ["vec_id", "tie", "place", "x"])

    return run


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every `BLOCK` rows that follow each other: their ids, vectors and box."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        x, starts = _matrix(batch["x"], DIMENSION), np.arange(0, n, BLOCK)
        at = np.append(starts, n).astype(np.int32)
        yield pa.RecordBatch.from_arrays([
            pa.ListArray.from_arrays(at, batch["vec_id"]), pa.ListArray.from_arrays(at * DIMENSION, pa.array(x.ravel(), pa.int32())),
            _lists(np.minimum.reduceat(x, starts), pa.int32()), _lists(np.maximum.reduceat(x, starts), pa.int32()),
        ], ["vec_ids", "x", "lo", "hi"])


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids, rising, that may be nearest to a vector in the box from `lo` to `hi`.

    The rival is the centroid whose greatest distance to the box is least. Another one's squared distance less the
    rival's is linear in the vector, so its least value over the box is exact; where it is above zero, the other is out.
    """
    far = np.maximum(np.abs(centroids - lo), np.abs(centroids - hi))
    rival = centroids[(far * far).sum(1).argmin()]
    way = centroids - rival
    least = (centroids * centroids).sum(1) - (rival * rival).sum() - 2 * np.maximum(way * lo, way * hi).sum(1)
    return np.flatnonzero(least <= 0)


def nearest(x: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row of `x` out of `among`, ties to the smaller number, and its squared distance."""
    c = centroids[among]
    if 4 * DIMENSION * max(int(np.abs(x).max()), int(np.abs(c).max()), 1) ** 2 < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        distance = ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    else:
        distance = np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)
    best = distance.argmin(1)
    return among[best], distance[np.arange(len(x)), best]


def _blocks(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    lo, hi = _matrix(batch["lo"], DIMENSION).astype(np.int64), _matrix(batch["hi"], DIMENSION).astype(np.int64)
    for i in range(batch.num_rows):
        x = np.asarray(batch["x"][i].values).reshape(-1, DIMENSION).astype(np.int64)
        yield (batch["vec_ids"][i].values, x, *nearest(x, centroids, candidates(lo[i], hi[i], centroids)))


def _sums(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, x, cluster, _ in _blocks(batch, centroids):
                counts += np.bincount(cluster, minlength=len(counts))
                np.add.at(sums, cluster, x)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held]), _lists(sums[held], pa.int64())], ["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vec_ids, _, cluster, distance in _blocks(batch, centroids):
                yield pa.RecordBatch.from_arrays([vec_ids, pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    whole = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < LIMIT))  # NaN is above all in Spark
    return vectors.where((F.size("embedding") == DIMENSION) & whole).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def blocks(rows: DataFrame) -> DataFrame:
    """(vec_ids, x, lo, hi): the vectors in Hilbert order, `BLOCK` a row, with their box."""
    spread = rows.select("embedding").mapInArrow(_spread, "axis int, n long, lo double, hi double, total double, squares double")
    spread = spread.groupBy("axis").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("t"), F.sum("squares").alias("s"))
    variance = F.col("s") / F.col("n") - (F.col("t") / F.col("n")) ** 2
    widest = spread.orderBy(variance.desc(), "axis").limit(CURVE_DIMENSIONS).collect()
    axes = np.array([r["axis"] for r in widest], np.int64)
    lo, hi = (np.array([r[name] for r in widest]) for name in ("lo", "hi"))
    tie = F.xxhash64("vec_id", F.monotonically_increasing_id())  # spreads equal vectors, equal ids too
    placed = rows.withColumn("tie", tie).mapInArrow(_placed(axes, lo, hi), "vec_id long, tie long, place long, x array<int>")
    ordered = placed.repartitionByRange("place", "tie").sortWithinPartitions("place", "tie")
    return cut(ordered.mapInArrow(_blocked, "vec_ids array<long>, x array<int>, lo array<int>, hi array<int>"))


def start(rows: DataFrame, k: int) -> np.ndarray:
    """The k vectors of least hash, in the order of the hash; equal hashes (repeated ids) in the order of the vectors."""
    draw = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    taken = rows.orderBy(draw.asc_nulls_last(), "embedding").limit(k).collect()
    return np.floor(np.array([r["embedding"] for r in taken], np.float64).reshape(-1, DIMENSION) * SCALE).astype(np.int64)


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor of the mean of their vectors; those without vectors stay."""
    sums = table.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
    sums = sums.select("cluster", "n", F.posexplode("sums").alias("axis", "part")).groupBy("cluster", "axis")
    found = sums.agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()  # k * DIMENSION rows
    out = centroids.copy()
    for r in found:
        out[r["cluster"], r["axis"]] = int(r["total"]) // r["n"]
    return out


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector."""
    spark, rows = vectors.sparkSession, usable(vectors)
    centroids = start(rows, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    table = blocks(rows)
    for _ in range(rounds):
        centroids = moved(table, centroids)
    found = cut(table.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"))
    parts = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in centroids]
    known = [(c, part, sum(parts.values()), digests[c]) for c, part in parts.items()]
    of_cluster = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # at most k rows
    return found.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int, rounds: int) -> str:
    """The same by comparing every vector with every centroid."""
    parts = [f"""kept as (
  select vec_id, list_transform(embedding, lambda e: cast(floor({SCALE} * cast(e as double)) as bigint)) as x from embeddings
  where len(embedding) = {DIMENSION} and len(list_filter(embedding, lambda e: e is not null and isfinite(e) and abs(e) < {LIMIT})) = {DIMENSION}
), c0 as (
  select cast(row_number() over (order by sha256('2:' || vec_id), x) - 1 as integer) as c, x as y from kept qualify c < {k}
)"""]
    distance = "list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for r in range(rounds + 1):
        parts.append(f"""d{r} as (select vec_id, x, c, cast({distance} as bigint) as d from kept, c{r}
), a{r} as (select vec_id, x, min(c) as c, any_value(d) as d from d{r} join (select vec_id, x, min(d) as d from d{r} group by all) using (vec_id, x, d) group by vec_id, x)""")
        if r < rounds:
            parts.append(f"""s{r} as (select c, i, sum(x[i])::hugeint as s, count(*) as n from a{r}, range(1, {DIMENSION + 1}) t(i) group by all
), m{r} as (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as y from s{r} group by c
), c{r + 1} as (select c, coalesce(m{r}.y, c{r}.y) as y from c{r} left join m{r} using (c))""")
    return f"""with {', '.join(parts)}
select vec_id, c as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(y, ',')) as centroid_sha256
from a{rounds} join c{rounds} using (c)"""


OP12_SQL = _sql(K, ROUNDS)
