"""Near-duplicates by BagMinHash over multisets of five-word shingles.

Signature. A shingle that occurs c times is a point of weight c. Every (shingle, weight unit) carries Poisson processes
for the `SIZE` components of the signature; a component keeps the earliest point of all shingles. Two texts agree in a
component with a chance equal to their weighted Jaccard similarity. Weights are discretised to integers and organised
in intervals (0,1], (1,2], (2,4], (4,8] ...: one process serves an interval, and each of its points also draws its
place inside, so it counts only where the weight reaches that far. Points come in order of time, and only up to a bound
by which all components are almost surely reached; texts that are not go on. So the cost hardly depends on `SIZE` times
the number of shingles.

Bands. `BANDS` bands of `ROWS` components make buckets; the members of a bucket are chained to its least member, and
chained texts form families. Nothing is paired yet.

Verification. A family is dealt into blocks of bounded bytes; a task takes two blocks, compares the signatures of all
their pairs as byte matrices, and computes the exact multiset overlap where the estimate is within four standard errors
of the threshold and the two aren't linked already. It returns a spanning forest of the links, never all pairs, so
no link between different texts is lost beyond the chance of banding, and equal texts take part once.

Classes are the connected components of the verified links.

Edge cases: null texts and texts without a word are in no class but their own (class_id is their doc_id); texts of
one to four words have one shingle; equal texts share a class; a class is named by its least doc_id (null sorts
behind all others, and names a class only where no other id is in it); repeated rows share a class and each gives a
row; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.common import components, cut, free_name, slices, text_key, worker_memo
from snapledger.llm.shingles import bags, mix, overlap

THRESHOLD = 0.8
BANDS, ROWS = 28, 7
SIZE = BANDS * ROWS
BLOCK_ROWS = 512
BLOCK_BYTES = 4 << 20
SLACK = 4 * (THRESHOLD * (1 - THRESHOLD) / SIZE) ** 0.5

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _points(texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(text, shingle, weight, low, high) of every interval that a shingle's weight enters."""
    text = np.repeat(np.arange(len(texts)), [len(s) for s, _ in texts])
    shingle = np.concatenate([s for s, _ in texts]) if texts else np.zeros(0, np.uint64)
    weight = np.concatenate([c for _, c in texts]).astype(np.int64) if texts else np.zeros(0, np.int64)
    parts, low, high = [], 0, 1
    inside = np.arange(len(shingle))
    while len(inside):
        parts.append((text[inside], shingle[inside], weight[inside], np.full(len(inside), low), np.full(len(inside), high)))
        low, high = high, 2 * high
        inside = inside[weight[inside] > low]
    return tuple(map(np.concatenate, zip(*parts))) if parts else tuple(np.zeros(0, np.int64) for _ in range(5))


def signatures(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Signature (SIZE 64-bit values) of every bag; rows of empty bags mean nothing."""
    n = len(texts)
    totals = np.array([c.sum() for _, c in texts], np.float64) if n else np.zeros(0)
    times = np.full(n * SIZE, np.inf)
    values = np.zeros(n * SIZE, np.uint64)
    text, shingle, weight, low, high = _points(texts)
    state = mix(shingle + high.astype(np.uint64) * _ODD)
    time = np.zeros(len(text))
    rate = SIZE * (high - low).astype(np.float64)
    bound = (np.log(SIZE) + 3) / np.maximum(totals, 1)
    while len(text):
        alive = np.arange(len(text))
        while len(alive):
            # The next point of each process: waiting time, component and place, all from one chain of hashes.
            s = mix(state[alive] + _ODD)
            t = time[alive] - np.log(_uniform(s)) / rate[alive]
            early = t <= bound[text[alive]]
            alive, s, t = alive[early], s[early], t[early]
            state[alive], time[alive] = s, t
            other = mix(s ^ _ODD)
            place = low[alive] + _uniform(mix(other)) * (high[alive] - low[alive])
            real = place < weight[alive]
            slot = text[alive[real]] * SIZE + ((other[real] >> np.uint64(32)) * np.uint64(SIZE) >> np.uint64(32)).astype(np.int64)
            t, s = t[real], s[real]
            np.minimum.at(times, slot, t)
            first = times[slot] == t
            values[slot[first]] = s[first]
        # Texts with a component that no point has reached go on to twice the time, from where they stopped.
        open_texts = np.isinf(times.reshape(n, SIZE)).any(1) & (totals > 0)
        kept = open_texts[text]
        text, state, weight, low, high, time, rate = (x[kept] for x in (text, state, weight, low, high, time, rate))
        bound = bound * 2
    return values.reshape(n, SIZE)


def signed(docs: DataFrame) -> DataFrame:
    """key, sig (one byte of each component), bands (64-bit hashes), bytes, of every row whose text has a word."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memo("bagminhash")
        numbers = np.arange(BANDS, dtype=np.uint64)
        for batch in slices(batches, "text"):
            texts = bags(batch.column(1))
            full = [i for i, (s, _) in enumerate(texts) if len(s)]
            if not full:
                continue
            values = signatures([texts[i] for i in full])
            bands = np.zeros((len(full), BANDS), np.uint64) + numbers
            for k in range(ROWS):
                bands = mix(bands ^ values[:, k::ROWS][:, :BANDS])
            at = pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(full)),
                pa.array([v.tobytes() for v in (values & np.uint64(255)).astype(np.uint8)]),
                pa.ListArray.from_arrays(at, pa.array(bands.ravel().view(np.int64))),
                pc.binary_length(batch.column(1)).cast(pa.int64()).take(pa.array(full)),
            ], names=["key", "sig", "bands", "bytes"])

    return docs.select("key", "text").mapInArrow(sign, "key binary, sig binary, bands array<long>, bytes long")


def families(signatures_: DataFrame) -> DataFrame:
    """(node, component) of texts that share buckets, in one family if a chain of buckets joins them."""
    members = signatures_.select("key", F.explode("bands").alias("bucket"))
    heads = members.groupBy("bucket").agg(F.min("key").alias("b"), F.count("*").alias("n")).where("n > 1").select("bucket", "b")
    return components(members.join(heads, "bucket").where("key != b").select(F.col("key").alias("a"), "b"))


def _links(rows: list[tuple], other: list[tuple] | None, bag: dict) -> Iterator[tuple[bytes, bytes]]:
    """A spanning forest of the verified links among `rows`, or between `rows` and `other`. rows: (key, sig, text)."""
    right = rows if other is None else other
    sigs = np.stack([np.frombuffer(r[1], np.uint8) for r in rows])
    others = np.stack([np.frombuffer(r[1], np.uint8) for r in right])
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    need = SIZE * (THRESHOLD - SLACK)
    for i, (key, _, _) in enumerate(rows):
        agree = (others == sigs[i]).sum(1)
        near = np.flatnonzero(agree >= need)
        if other is None:
            near = near[near > i]
        for j in near[np.argsort(-agree[near], kind="stable")]:
            a, b = find(key), find(right[j][0])
            if a != b and overlap(bag[key], bag[right[j][0]]) >= THRESHOLD:
                root[a] = b
                yield key, right[j][0]


def verified(family: DataFrame, signs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that span every class. family: node, component; signs: key, sig, bytes; texts: key, text; once per key."""
    member = family.join(signs.select(F.col("key").alias("node"), "sig", "bytes"), "node")
    blocks = (
        member.groupBy("component")
        .agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("n"))
    )
    block = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    dealt = (
        member.join(blocks, "component").withColumn("block", block)
        .join(texts.select(F.col("key").alias("node"), "text"), "node")
        # Every block meets itself and all others of its family, each two in one place.
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select(
            F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("task"),
            (F.col("block") <= F.col("other")).alias("left"), (F.col("block") == F.col("other")).alias("own"),
            F.col("node").alias("key"), "sig", "text",
        )
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[tuple]) -> pa.RecordBatch:
            texts = pa.array([r[5] for r in rows], pa.string())
            bag = dict(zip([r[3] for r in rows], bags(texts)))
            left = [(r[3], r[4]) + (None,) for r in rows if r[1]]
            right = None if rows[0][2] else [(r[3], r[4], None) for r in rows if not r[1]]
            links = list(_links(left, right, bag)) if left and (right is None or right) else []
            return pa.record_batch([pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], names=["a", "b"])

        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[0] != rows[0][0]:
                    if len(rows) > 1:
                        yield found(rows)
                    rows = []
                rows.append(row)
        if len(rows) > 1:
            yield found(rows)

    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(link, "a binary, b binary")


def classes(docs: DataFrame) -> DataFrame:
    """(key, component) of all text keys whose text is near another one's. docs: key, text."""
    docs = docs.where("text is not null")
    signs = cut(signed(docs).groupBy("key").agg(*[F.first(c).alias(c) for c in ("sig", "bands", "bytes")]))
    family = cut(families(signs))
    # Copies fold to one row in the tasks that read them, before any text moves.
    texts = docs.groupBy("key").agg(F.first("text").alias("text"))
    return components(verified(family, signs, texts)).withColumnRenamed("node", "key")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every document."""
    keyed = docs.select("doc_id", "text", text_key("text").alias("key"))
    found = classes(keyed)
    ids = keyed.select("doc_id", "key", _wordless().alias("alone"))
    # Names are found by text, where copies have folded to one row, so a group of copies meets its name in a join only.
    by_text = ids.where("not alone").groupBy("key").agg(F.min("doc_id").alias("least")).join(found, "key", "left")
    by_text = by_text.withColumn("component", F.coalesce("component", "key"))
    names = by_text.groupBy("component").agg(F.min("least").alias("class_id"))
    of_text = by_text.join(names, "component").select("key", "class_id")
    return ids.join(of_text, "key", "left").select("doc_id", F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def _wordless():
    return F.coalesce(~F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7f]"), F.lit(True))


def deduplicated(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each class: that of the least doc_id, then of the least text key. Repeated rows are
    copies, too; documents without a word all stay, but for repeated rows."""
    key, part = free_name(docs, "text_key"), free_name(docs, "component")
    keyed = docs.withColumn(key, F.coalesce(text_key(F.col("text")), F.lit(b"").cast("binary")))
    found = classes(keyed.select(F.col(key).alias("key"), "text")).select(F.col("key").alias(key), F.col("component").alias(part))
    narrow = keyed.select("doc_id", key, _wordless().alias("alone"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("k")
    by_text = narrow.where("not alone").groupBy(key).agg(first).join(found, key, "left").withColumn(part, F.coalesce(part, key))
    keep = (
        by_text.groupBy(part).agg(F.min(F.struct("k.none", "k.doc_id", key)).alias("k"))
        .select(F.col("k")["doc_id"].alias("doc_id"), F.col(f"k.{key}").alias(key))
        .unionByName(narrow.where("alone").select("doc_id", key).distinct())
    )
    left, right = keyed.alias("l"), keep.alias("r")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col(f"l.`{key}`") == F.col(f"r.`{key}`"))
    return left.join(right, same, "left_semi").dropDuplicates(["doc_id", key]).drop(key)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
