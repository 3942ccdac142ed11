"""Quality by co-training of two views.

The text view sees how the characters of a text follow each other, by class; the metadata view sees the record's
source, language and length and the layout of its lines. Each view starts from labelled rows; in every round each hands
its most confident verdicts on unlabelled rows to the other, as labels. At the end both are calibrated on labelled rows
that neither learnt from, and a logistic combination of the calibrated views scores every document.

Limits that are parameters: `LABELLED` and `POOL` bound the rows that are learnt from (those of least hash). Scoring
covers every whole text.

Edge cases: null and empty texts have the features of an empty text; null source, language or length are values of
their own; without labels of both kinds every score is the share of good labels (0.5 without any); of several labels
of one id the least counts; a null doc_id is held out; repeated rows get equal scores; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.common import held_out, slices

LABELLED = 3000
POOL = 4000
ROUNDS = 4
SHARE = 0.05  # of the pool that each view may label in a round
CLASSES = 24
SLOTS = 64  # hashed sources and languages


def _byte_classes() -> np.ndarray:
    """Letters, digits, spaces, line ends and non-ASCII have a class each; the punctuation shares the rest."""
    out = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = 0
        elif c.islower():
            out[b] = 1
        elif c.isupper():
            out[b] = 2
        elif c.isdigit():
            out[b] = 3
        elif c == "\n":
            out[b] = 4
        elif c.isspace():
            out[b] = 5
        else:
            out[b] = 6 + b % (CLASSES - 6)
    return out


_CLASS = _byte_classes()
TEXT_SIZE = CLASSES * CLASSES
META_SIZE = 2 * SLOTS + 20 + 6


def views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Text and metadata features of rows (text, lang, source, n_chars)."""
    n = batch.num_rows
    texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
    a, b = np.zeros((n, TEXT_SIZE), np.float32), np.zeros((n, META_SIZE), np.float32)
    rows = zip(texts, batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("n_chars").to_pylist())
    for i, (text, lang, source, chars) in enumerate(rows):
        raw = np.frombuffer(text.as_buffer(), np.uint8)
        if len(raw) > 1:
            kind = _CLASS[raw]
            a[i] = np.sqrt(np.bincount(kind[:-1] * CLASSES + kind[1:], minlength=TEXT_SIZE) / len(raw))
        b[i, zlib.crc32(repr(source).encode()) % SLOTS] = 1
        b[i, SLOTS + zlib.crc32(repr(lang).encode()) % SLOTS] = 1
        b[i, 2 * SLOTS + (0 if chars is None else 1 + min(18, max(0, int(chars)).bit_length()))] = 1
        ends = np.flatnonzero(raw == 10)
        lengths = np.diff(np.concatenate(([-1], ends, [len(raw)]))) - 1
        b[i, -6:] = np.log1p([len(lengths), lengths.mean(), lengths.max(), lengths.min(), lengths.std(), (lengths == 0).sum()])
    return a, b


class Classifier:
    """Logistic regression on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 150):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = (x - self.mean) / self.scale
        self.weights, self.bias = np.zeros(x.shape[1], np.float32), np.float32(0)
        velocity, seen, at = np.zeros_like(self.weights), np.zeros_like(self.weights), np.float32(0)
        for k in range(1, rounds + 1):  # Adam
            slope = (1 / (1 + np.exp(-np.clip(z @ self.weights + self.bias, -30, 30))) - y) / len(y)
            g = z.T @ slope + penalty * self.weights
            velocity = 0.9 * velocity + 0.1 * g
            seen = 0.999 * seen + 0.001 * g * g
            self.weights -= 0.02 * (velocity / (1 - 0.9**k)) / (np.sqrt(seen / (1 - 0.999**k)) + 1e-8)
            self.bias -= np.float32(0.5) * slope.sum()
        self.weights = self.weights.astype(np.float32)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias


def _rate(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class CoTrained:
    """Two co-trained views with their calibration and combination."""

    def __init__(self, a: np.ndarray, b: np.ndarray, y: np.ndarray, pool_a: np.ndarray, pool_b: np.ndarray):
        split = len(y) * 3 // 4 if min(y[len(y) * 3 // 4 :].sum(), (1 - y[len(y) * 3 // 4 :]).sum()) > 4 else len(y)
        kept = slice(split, None) if split < len(y) else slice(None)
        xa, ya, xb, yb = a[:split], y[:split], b[:split], y[:split]
        free_a = free_b = np.arange(len(pool_a))
        good = y.mean()
        for _ in range(ROUNDS):
            self.text, self.meta = Classifier(xa, ya), Classifier(xb, yb)
            give = int(SHARE * len(pool_a))
            picked, labels = self._confident(self.text.margin(pool_a[free_b]), give, good)
            xb, yb = np.concatenate((xb, pool_b[free_b[picked]])), np.concatenate((yb, labels))
            free_b = np.delete(free_b, picked)
            picked, labels = self._confident(self.meta.margin(pool_b[free_a]), give, good)
            xa, ya = np.concatenate((xa, pool_a[free_a[picked]])), np.concatenate((ya, labels))
            free_a = np.delete(free_a, picked)
        self.text, self.meta = Classifier(xa, ya), Classifier(xb, yb)
        margins = np.stack((self.text.margin(a[kept]), self.meta.margin(b[kept])), 1)
        self.scales = [Classifier(margins[:, k : k + 1], y[kept]) for k in (0, 1)]
        calibrated = np.stack([s.margin(margins[:, k : k + 1]) for k, s in enumerate(self.scales)], 1)
        self.both = Classifier(calibrated, y[kept])

    @staticmethod
    def _confident(margin: np.ndarray, give: int, good: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows with a firm verdict (rate beyond 0.9), at most `give`, both kinds in their usual shares."""
        order = np.argsort(margin, kind="stable")
        low, high = order[: round(give * (1 - good))], order[len(order) - round(give * good) :]
        low, high = low[_rate(margin[low]) < 0.1], high[_rate(margin[high]) > 0.9]
        picked = np.concatenate((low, high[~np.isin(high, low)]))
        return picked, np.concatenate((np.zeros(len(low)), np.ones(len(picked) - len(low)))).astype(np.float32)

    def score(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated rates of the text view, the metadata view and both."""
        margins = [self.scales[0].margin(self.text.margin(a)[:, None]), self.scales[1].margin(self.meta.margin(b)[:, None])]
        return _rate(margins[0]), _rate(margins[1]), _rate(self.both.margin(np.stack(margins, 1)))


COLUMNS = ("text", "lang", "source", "n_chars")


def model(docs: DataFrame, labels: DataFrame) -> CoTrained | float:
    """Learn from the documents of the learnt fold; the share of good labels where only one kind is known."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("y"))
    )
    labelled = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    pool = (
        docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", F.lit(-1).alias("y"))
        .orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(POOL)
    )
    chosen = labelled.unionByName(pool)
    taken = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", *COLUMNS)  # bounded rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            a, b = views(batch)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "y": batch.column("y"),
                "a": pa.array([x.tobytes() for x in a]), "b": pa.array([x.tobytes() for x in b])})

    table = taken.mapInArrow(extract, "doc_id long, y int, a binary, b binary").toArrow()
    order = np.lexsort((table["doc_id"].to_numpy(), table["y"].to_numpy()))
    y = table["y"].to_numpy()[order]
    read = lambda name: np.frombuffer(b"".join(table[name].to_pylist()), np.float32).reshape(len(y), -1)[order]
    if not (y == 1).any() or not (y == 0).any():
        return float(y[y >= 0].mean()) if (y >= 0).any() else 0.5
    a, b = read("a"), read("b")
    given = np.flatnonzero(y >= 0)
    given = given[np.argsort([zlib.crc32(str(i).encode()) for i in table["doc_id"].to_numpy()[order][given]], kind="stable")]
    return CoTrained(a[given], b[given], y[given].astype(np.float32), a[y < 0], b[y < 0])


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the calibrated rates of both views, and the combined score that a document is good."""
    learnt = model(docs, labels)
    if isinstance(learnt, float):
        return docs.select("doc_id", *[F.lit(learnt).alias(c) for c in ("text_score", "meta_score", "score")])
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The model travels with the function: a few thousand numbers, and its class by value.
        for batch in slices(batches, "text"):
            rates = [pa.array(r.astype(np.float64)) for r in learnt.score(*views(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *rates], names=["doc_id", "text_score", "meta_score", "score"])

    return docs.select("doc_id", *COLUMNS).mapInArrow(rate, "doc_id long, text_score double, meta_score double, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
