"""Embedding near-duplicates over a robust-pruned flat graph.

1. Equal vectors of a label become one node with a multiplicity.
2. Pivots: a hashed sample of each label's nodes, at most `PIVOTS` of it, thinned to vectors that differ clearly, so a
   dense group has one pivot and stays together. Every node joins the shards of its nearest pivots. How many is measured
   for each part (label and length): every node of a vec_id divisible by 50 gets a made-up partner at the threshold, and
   the overlap is the least at which `MEETING` of these pairs share a shard. So a part without links has evidence, too,
   and lone pairs count as much as those of dense groups.
3. Build: each shard makes a flat graph; a node keeps the neighbours that robust pruning leaves of its nearest and some
   random nodes: one is dropped if a kept one is closer to it than the node is, by the factor `ALPHA`.
4. The adjacency lists that a node got in its shards are united, and go back to the shards with the vectors.
5. Search: every node is a query. A greedy search runs from the shard's medoid; from where it ends, and from the node
   itself, the search expands as long as nodes within the range widened by `SLACK` are found.
6. Verify: cosine in double precision. A pair that meets in several shards counts in the first of them only.
   Tasks give counts and a spanning forest of the links, never the pairs.
7. Audit: the links of all nodes of a vec_id divisible by 50 are counted by brute force against all rows, in blocks.
   Where a part finds less than `RECALL` of its links, taken over pairs or over nodes, its overlap is doubled and the
   search repeated, up to all pivots of the part. The audit is the product of `audit`.

A shard of more than `BLOCK` nodes is dealt into blocks; a task takes two blocks, and every two blocks meet once.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do
those without label or vec_id; vectors of different length never link; equal rows are vectors of their own and link with
each other; a component is named by its least vec_id (null for a null vec_id, which isn't kept); an empty table gives no
rows; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.common import components, cut

THRESHOLD = 0.93
TARGET = 400  # nodes a shard should have
PIVOTS = 512
DISTINCT = 0.8  # pivots nearer than that are one
MEETING = 0.995
PROBED = 5000  # in parts up to that size every node is a probe
BLOCK = 2000
DEGREE = 16
NEAREST = 40
RANDOM = 8
ALPHA = 1.2
BEAM = 16
SLACK = 0.05
QUERY_EVERY = 50
QUERY_ROWS = 500
RECALL = 0.95
GROUP_ROWS = 10_000


def nodes(vectors: DataFrame) -> DataFrame:
    """node, part (label and length), unit vector, copies, of every different vector that can link."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    wide = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    asked = F.bool_or(F.pmod("vec_id", F.lit(QUERY_EVERY)) == 0).alias("asked")
    usable = vectors.where("vec_id is not null and label is not null and size(embedding) > 0").where(F.coalesce(whole, F.lit(False)))
    return (
        usable.select("vec_id", node_key().alias("node"), F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string")).alias("part"), wide.alias("wide"), norm.alias("norm"))
        .where("norm > 0").groupBy("node", "part").agg(F.count("*").alias("copies"), asked, F.first(F.transform("wide", lambda x: x / F.col("norm"))).alias("unit"))
    )


def node_key():
    spelt = F.concat_ws(",", F.col("label").cast("string"), F.transform("embedding", lambda x: x.cast("string")))
    return F.unhex(F.substring(F.sha2(spelt, 256), 1, 32))


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def pivots(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """part, pivot (its number within the part), unit. A part's pivots are thinned in one small group."""
    place = F.pmod(F.xxhash64("node"), F.lit(1 << 40)) / float(1 << 40)
    drawn = points.join(sizes, "part").where(place < F.least(F.lit(1.0), F.least(F.lit(1.0 / TARGET), PIVOTS / F.col("n"))) + 1e-12)
    least = points.groupBy("part").agg(F.min_by("unit", F.struct(F.xxhash64("node"), "node")).alias("unit"))
    both = drawn.select("part", "unit").unionByName(least.select("part", "unit"))

    def thin(group: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(group["unit"])
        x = x[np.lexsort(x.T[::-1])]
        kept: list[int] = []
        for i in range(len(x)):
            if not kept or (x[kept] @ x[i]).max() < DISTINCT:
                kept.append(i)
        return pd.DataFrame({"part": group["part"].iloc[0], "pivot": range(len(kept)), "unit": list(x[kept])})

    return both.groupBy("part").applyInPandas(thin, "part string, pivot int, unit array<double>")


def _beside(points: DataFrame, others: DataFrame, sizes: DataFrame) -> tuple:
    """Both sides grouped for work in groups of bounded size of a part, each of which gets the part's `others`."""
    groups = F.ceil(F.col("n") / GROUP_ROWS).cast("int")
    left = points.join(sizes, "part").withColumn("salt", F.pmod(F.xxhash64("node", F.lit(7)), groups).cast("int")).drop("n")
    right = others.join(sizes, "part").withColumn("salt", F.explode(F.sequence(F.lit(0), groups - 1))).drop("n")
    # Columns of their own, as both sides may come from the same table.
    return left, right.select(*[F.col(c).alias(c) for c in right.columns])


def overlaps(points: DataFrame, of_pivots: DataFrame, sizes: DataFrame) -> DataFrame:
    """(part, overlap): to how many nearest pivots the nodes of a part must go for `MEETING` of the probes to meet."""
    left, right = _beside(points.join(sizes, "part").where(F.col("asked") | (F.col("n") <= PROBED)).select("node", "part", "unit"), of_pivots, sizes)

    def needed(group: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(centres):
            return pd.DataFrame({"part": [], "need": []})
        x, to = _matrix(group["unit"]), _matrix(centres["unit"]).T
        side = np.stack([np.random.default_rng(list(node)).normal(size=x.shape[1]) for node in group["node"]])
        side -= (side * x).sum(1)[:, None] * x
        length = np.linalg.norm(side, axis=1)[:, None]
        side = np.where(length > 1e-9, side / np.maximum(length, 1e-9), 0)
        rank = lambda y: np.argsort(np.argsort(-(y @ to), axis=1, kind="stable"), axis=1)
        need = np.maximum(rank(x), rank(THRESHOLD * x + np.sqrt(1 - THRESHOLD**2) * side)).min(1) + 1
        return pd.DataFrame({"part": group["part"], "need": need})

    probes = left.groupBy("part", "salt").cogroup(right.groupBy("part", "salt")).applyInPandas(needed, "part string, need int")
    return probes.groupBy("part").agg(F.ceil(F.percentile("need", F.lit(MEETING))).cast("int").alias("overlap"))


def assigned(points: DataFrame, of_pivots: DataFrame, sizes: DataFrame, overlap: DataFrame) -> DataFrame:
    """`points` with the numbers of their nearest pivots, nearest first. A part without a probe goes to all pivots."""
    left, right = _beside(points, of_pivots, sizes)
    left = left.join(overlap, "part", "left")

    def nearest(group: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({"node": [], "part": [], "copies": [], "unit": [], "shards": []})
        centres = centres.sort_values("pivot")
        most = group["overlap"].iloc[0]
        near = np.argsort(-(_matrix(group["unit"]) @ _matrix(centres["unit"]).T), axis=1, kind="stable")[:, : len(centres) if pd.isna(most) else int(most)]
        return group[["node", "part", "copies", "unit"]].assign(shards=list(near.astype(np.int32)))

    schema = "node binary, part string, copies long, unit array<double>, shards array<int>"
    return left.groupBy("part", "salt").cogroup(right.groupBy("part", "salt")).applyInPandas(nearest, schema)


def dealt(members: DataFrame) -> DataFrame:
    """A row for every task that a member takes part in: task, side (0: both blocks are its own, 1, 2), shard."""
    each = members.withColumn("shard", F.explode("shards"))
    blocks = each.groupBy("part", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    block = F.pmod(F.xxhash64("node", F.lit(11)), F.col("n_blocks")).cast("int")
    placed = each.join(blocks, ["part", "shard"]).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    task = F.xxhash64("part", "shard", F.least("block", "other"), F.greatest("block", "other"))
    return placed.withColumn("task", task).withColumn("side", side).drop("n_blocks", "block", "other")


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one task after another; the first column is the task, by which the rows are sorted."""
    rows: list[tuple] = []
    for batch in batches:
        columns = [c.to_pylist() if not pa.types.is_list(c.type) or pa.types.is_binary(c.type.value_type) else _lists(c) for c in batch.columns]
        for row in zip(*columns):
            if rows and row[0] != rows[0][0]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    values, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
    return [values[a:b] for a, b in zip(at[:-1], at[1:])]


def pruned(x: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned neighbours of every row of unit vectors, with the reverse edges."""
    n = len(x)
    out: list[set[int]] = [set() for _ in range(n)]
    if n == 1:
        return [np.zeros(0, np.int64)]
    draw = np.random.default_rng(n)
    for begin in range(0, n, 256):
        similar = x[begin : begin + 256] @ x.T
        for row, i in enumerate(range(begin, min(begin + 256, n))):
            s = similar[row]
            near = np.argpartition(-s, NEAREST)[: NEAREST + 1] if n > NEAREST + 1 else np.arange(n)
            near = np.unique(np.concatenate((near, draw.integers(0, n, RANDOM))))
            near = near[near != i]
            near = near[np.argsort(-s[near], kind="stable")]
            far = np.sqrt(np.maximum(0, 2 - 2 * s[near]))
            between = np.sqrt(np.maximum(0, 2 - 2 * (x[near] @ x[near].T)))
            left = np.ones(len(near), bool)
            for _ in range(DEGREE):
                k = left.argmax()
                if not left[k]:
                    break
                out[i].add(int(near[k]))
                out[near[k]].add(i)
                left &= ALPHA * between[k] > far
                left[k] = False
    return [np.fromiter(sorted(o), np.int64, len(o)) for o in out]


def _reached(x: np.ndarray, graph: list[np.ndarray], start: int, query: int) -> np.ndarray:
    """The nodes where a greedy search of `BEAM` candidates from `start` ends."""
    goal = x[query]
    seen = {start}
    ids, sims, done = np.array([start]), x[[start]] @ goal, np.zeros(1, bool)
    while not done.all():
        k = int(np.flatnonzero(~done)[0])
        done[k] = True
        fresh = [j for j in graph[ids[k]].tolist() if j not in seen]
        if not fresh:
            continue
        seen.update(fresh)
        ids, sims, done = np.concatenate((ids, fresh)), np.concatenate((sims, x[fresh] @ goal)), np.concatenate((done, np.zeros(len(fresh), bool)))
        best = np.argsort(-sims, kind="stable")[:BEAM]
        ids, sims, done = ids[best], sims[best], done[best]
    return ids


def ranges(x: np.ndarray, graph: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of rows within the range, as the search from every row finds them."""
    n = len(x)
    medoid = int((x @ x.mean(0)).argmax())
    pairs = []
    for q in range(n):
        front = np.unique(np.append(_reached(x, graph, medoid, q), q))
        front = front[x[front] @ x[q] >= THRESHOLD - SLACK]
        known = np.zeros(n, bool)
        known[front] = True
        found = [front]
        while len(front):
            front = np.unique(np.concatenate([graph[v] for v in front]))
            front = front[~known[front]]
            known[front] = True
            front = front[x[front] @ x[q] >= THRESHOLD - SLACK]
            found.append(front)
        near = np.concatenate(found)
        near = near[(near != q) & (x[near] @ x[q] >= THRESHOLD)]
        pairs.append(np.minimum(near, q) * n + np.maximum(near, q))
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return both // n, both % n


def adjacency(tasks: DataFrame) -> DataFrame:
    """(node, near) of every node: the united neighbour lists of its shards."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tasks(batches):
            keys = [r[1] for r in rows]
            near = [[keys[j] for j in own] for own in pruned(np.stack([r[2] for r in rows]))]
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(near, pa.list_(pa.binary()))], ["node", "near"])

    sent = tasks.select("task", "node", "unit").repartition("task").sortWithinPartitions("task", "node")
    built = sent.mapInArrow(build, "node binary, near array<binary>")
    return built.select("node", F.explode("near").alias("other")).distinct().groupBy("node").agg(F.collect_list("other").alias("near"))


def searched(tasks: DataFrame, graph: DataFrame) -> DataFrame:
    """(node, other, links, pairs): counts of links by node (other is null), in vectors and in nodes, and a spanning forest of the links."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tasks(batches):
            keys, copies = [r[1] for r in rows], np.array([r[3] for r in rows], np.int64)
            place = {k: i for i, k in enumerate(keys)}
            near = [np.array(sorted({place[k] for k in r[7] or () if k in place}), np.int64) for r in rows]
            a, b = ranges(np.stack([r[2] for r in rows]), near)
            side, shard = np.array([r[5] for r in rows]), rows[0][6]
            held = [set(r[4].tolist()) for r in rows]
            counted = (side[a] == 0) | (side[a] != side[b])  # two blocks meet here only for what lies across
            counted &= np.fromiter((min(held[i] & held[j]) == shard for i, j in zip(a.tolist(), b.tolist())), bool, len(a))
            a, b = a[counted], b[counted]
            links = np.bincount(a, copies[b], len(keys)) + np.bincount(b, copies[a], len(keys))
            pairs = np.bincount(a, minlength=len(keys)) + np.bincount(b, minlength=len(keys))
            root = list(range(len(keys)))

            def find(v: int, root: list[int] = root) -> int:
                while root[v] != v:
                    root[v] = v = root[root[v]]
                return v

            forest = []
            for i, j in zip(a.tolist(), b.tolist()):
                i, j = find(i), find(j)
                if i != j:
                    root[i] = j
                    forest.append((keys[i], keys[j]))
            some = np.flatnonzero(links)
            yield pa.record_batch([
                pa.array([keys[i] for i in some] + [f for f, _ in forest], pa.binary()),
                pa.array([None] * len(some) + [t for _, t in forest], pa.binary()),
                pa.array([int(links[i]) for i in some] + [0] * len(forest), pa.int64()),
                pa.array([int(pairs[i]) for i in some] + [0] * len(forest), pa.int64())], ["node", "other", "links", "pairs"])

    sent = tasks.join(graph, "node", "left").select("task", "node", "unit", "copies", "shards", "side", "shard", "near")
    return sent.repartition("task").sortWithinPartitions("task", "node").mapInArrow(search, "node binary, other binary, links long, pairs long")


def true_links(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, part, there) of every node of a vec_id divisible by `QUERY_EVERY`: other nodes that link, by brute force.

    Queries come in blocks; every block meets all nodes of its part, in groups of bounded size.
    """
    asked = points.where("asked")
    per_part = asked.groupBy("part").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("n_blocks"))
    queries = asked.join(per_part, "part").withColumn("block", F.pmod(F.xxhash64("node", F.lit(13)), F.col("n_blocks")).cast("int"))
    left, right = _beside(points.select("node", "part", "unit"), queries.select("part", "block", F.col("node").alias("query"), "unit"), sizes)
    left = left.join(per_part, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).drop("n_blocks")

    def count(group: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(queries):
            return pd.DataFrame({"query": [], "part": [], "there": []})
        near = (_matrix(queries["unit"]) @ _matrix(group["unit"]).T >= THRESHOLD).sum(1)
        held = set(group["node"])
        near -= np.fromiter((q in held for q in queries["query"]), bool, len(queries))  # itself; `isin` loses a key's last zero bytes
        return pd.DataFrame({"query": queries["query"], "part": queries["part"], "there": near})

    keys = ["part", "salt", "block"]
    counted = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(count, "query binary, part string, there long")
    return counted.groupBy(F.col("query").alias("node"), "part").agg(F.sum("there").alias("there"))


def audit(true: DataFrame, links: DataFrame) -> DataFrame:
    """part, queries with links, by_pair and by_node: the share of their true links that were found, per part."""
    known = true.where("there > 0").join(links.select("node", "pairs"), "node", "left")
    found = F.least("there", F.coalesce("pairs", F.lit(0)))
    return known.groupBy("part").agg(
        F.count("*").alias("queries"), (F.sum(found) / F.sum("there")).alias("by_pair"), F.avg(found / F.col("there")).alias("by_node"))


def linked(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, links, pairs) of nodes with links to others, in vectors and in nodes, and (node, component)."""
    sizes = cut(points.groupBy("part").agg(F.count("*").alias("n")))
    of_pivots = cut(pivots(points, sizes))
    most = of_pivots.groupBy("part").agg(F.max("pivot").alias("most"))
    overlap = cut(overlaps(points, of_pivots, sizes))
    true = cut(true_links(points, sizes))
    while True:
        tasks = cut(dealt(assigned(points, of_pivots, sizes, overlap)))
        found = cut(searched(tasks, adjacency(tasks)))
        links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"), F.sum("pairs").alias("pairs"))
        poor = audit(true, links).where(F.least("by_pair", "by_node") < RECALL).join(most, "part").join(overlap, "part")
        poor = cut(poor.where("overlap <= most").select("part"))
        if poor.isEmpty():
            return links, components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
        again = poor.withColumn("times", F.lit(2))
        overlap = cut(overlap.join(again, "part", "left").select("part", (F.col("overlap") * F.coalesce("times", F.lit(1))).alias("overlap")))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    points = cut(nodes(vectors))
    links, groups = linked(points)
    rows = vectors.select("vec_id", F.when(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.col("vec_id").isNotNull(), node_key()).alias("node"))
    known = points.select("node", "copies").join(links, "node", "left").join(groups, "node", "left").select(
        "node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("component"))
    rows = rows.join(known, "node", "left")
    least = rows.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("least"))
    rows = rows.join(least, "component", "left")
    component = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return rows.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


# All pairs, for small tables.
OP10_SQL = """
with recursive vectors as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
), links as (
  select a.vec_id as x, b.vec_id as y from vectors a join vectors b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93
), reached(x, root) as (
  select vec_id, vec_id from vectors union select links.y, reached.root from reached join links on links.x = reached.x
)
select r.x as vec_id, coalesce(any_value(n), 0) as n_links, min(root) as component_id, r.x = min(root) as kept
from reached r left join (select x, count(*) as n from links group by x) c on c.x = r.x group by r.x
"""
