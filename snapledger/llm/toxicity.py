"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts P and unlabelled texts U train a linear classifier on the presence of words
and word beginnings. With class prior p the
risk of calling a text clean is that of U less p times that of P; where this estimate falls below zero the model has
over-fitted P, and the step goes the other way (the non-negative correction). Rare words get weight 0 by a proximal step.

Limits that are parameters: `POSITIVES` and `UNLABELLED` bound the rows that are learnt from; they are those of least
hash, so the choice does not depend on partitions. The prior is the toxic share of all labelled rows of the learnt fold.
Scoring covers every whole text. Labels, lang, source and doc_id are never inputs of a score.

Edge cases: null, empty and wordless texts get the score of the intercept; without confirmed toxic texts every score is
0; several labels of one id count as toxic if any is; a null doc_id is held out; repeated rows get equal scores; an
empty table gives no rows; other columns of the documents are kept, and a column that bears the name of a new one is
the caller's to rename (`scored` takes the names).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapledger.llm.common import held_out, slices, worker_memo
from snapledger.llm.shingles import stem_hashes

BITS = 20
STEMS = (5, 6, 7, 8)  # bytes of a word's beginning that are features, too: invented and inflected words share stems
POSITIVES = 3000
UNLABELLED = 6000
ROUNDS = 3000
STEP = 8.0
PENALTY = 2e-4
EVIDENCE = 5.5  # standard errors by which a word's share in P must differ from that in U


def features(texts: pa.Array, telling: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of all distinct features, words and stems, by text; with `telling`, only where that is true."""
    hashes, text = stem_hashes(texts, STEMS)
    feature = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    if telling is not None:
        kept = telling[feature]
        feature, text = feature[kept], text[kept]
    both = np.unique(text << BITS | feature)
    return (both & ((1 << BITS) - 1)).astype(np.int32), both >> BITS


def _rate(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def telling(index: np.ndarray, row: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Words whose share of confirmed texts differs from their share of unlabelled ones beyond chance."""
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    of_p = np.bincount(index[positive[row]], minlength=1 << BITS)
    of_u = np.bincount(index[~positive[row]], minlength=1 << BITS)
    both = (of_p + of_u + 1) / (n_p + n_u)
    error = np.sqrt(both * (1 - np.minimum(both, 0.999)) * (1 / n_p + 1 / n_u))
    return np.flatnonzero((np.abs(of_p / n_p - of_u / n_u) > EVIDENCE * error) & (of_p + of_u >= 5))


def _share(index: np.ndarray, row: np.ndarray, positive: np.ndarray, n_words: int) -> float:
    """Share of toxic texts among the unlabelled ones, where labelled rows are picked with a leaning.

    A word that only toxic texts have is as much rarer in U than in P as toxic texts are; so the middle ratio of the
    words that P has more often, each weighed by its share of P, tells the prior.
    """
    of_p = np.bincount(index[positive[row]], minlength=n_words) / max(1, positive.sum())
    of_u = np.bincount(index[~positive[row]], minlength=n_words) / max(1, (~positive).sum())
    more = of_p > of_u
    if not more.any():
        return 1.0
    ratio, weight = of_u[more] / of_p[more], of_p[more]
    order = np.argsort(ratio)
    middle = np.searchsorted(np.cumsum(weight[order]), weight.sum() / 2)
    return float(max(ratio[order][middle], 0.001))


def fit(index: np.ndarray, row: np.ndarray, positive: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and intercept from the (feature, text) pairs of P and U texts.

    Only words with evidence take part. Logistic loss; adaptive steps per weight with soft thresholding, so that words
    which the others explain go to 0.
    """
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    words = telling(index, row, positive)
    place = np.full(1 << BITS, -1)
    place[words] = np.arange(len(words))
    used = place[index] >= 0
    index, row = place[index[used]], row[used]
    prior = min(prior, _share(index, row, positive, len(words)))
    weights, bias = np.zeros(len(words)), float(np.log(prior / (1 - prior)))
    # Step below the inverse curvature of the logistic loss, by the largest number of telling words in a text.
    step = 4 * STEP / (1 + np.bincount(row, minlength=1).max(initial=0))
    for _ in range(ROUNDS):
        margin = bias + np.bincount(row, weights[index], len(positive))
        rate = _rate(margin)
        loss_clean = np.logaddexp(0, margin)
        clean_risk = loss_clean[~positive].sum() / n_u - prior * loss_clean[positive].sum() / n_p
        if clean_risk >= 0:
            slope = np.where(positive, -prior / n_p, rate / n_u)
        else:
            slope = np.where(positive, prior * rate / n_p, -rate / n_u)
        weights -= step * np.bincount(index, slope[row], len(words))
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * PENALTY, 0)
        bias -= step * slope.sum()
    margin = bias + np.bincount(row, weights[index], len(positive))
    out = np.zeros(1 << BITS, np.float32)
    out[words] = weights
    return out, float(bias - _border(margin, positive, prior))


def _border(margin: np.ndarray, positive: np.ndarray, prior: float) -> float:
    """The margin at which calling texts toxic is right most often, as P and U estimate it.

    Of all texts, prior * (share of P above) are rightly called and (share of U above) less that wrongly.
    """
    level, place = np.unique(margin, return_inverse=True)
    above = lambda kind: np.cumsum(np.bincount(place[kind], minlength=len(level))[::-1])[::-1] / max(1, kind.sum())
    best = int(np.argmax(2 * prior * above(positive) - above(~positive)))
    return float(level[best] if best == 0 else (level[best] + level[best - 1]) / 2)


def model(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """Learn from the documents of the learnt fold; None without confirmed toxic ones."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not toxic:
        return None
    order = F.xxhash64("doc_id")
    confirmed = known.where("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(POSITIVES)
    unlabelled = (
        docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id")
        .orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(UNLABELLED)
    )
    chosen = confirmed.withColumn("p", F.lit(True)).unionByName(unlabelled.withColumn("p", F.lit(False)))
    taken = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("p", "text")  # bounded rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memo("toxicity")
        for batch in slices(batches, "text"):
            index, text = features(batch.column(1))
            at = np.searchsorted(text, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(index, pa.int32()))], ["p", "words"])

    table = taken.mapInArrow(extract, "p boolean, words array<int>").toArrow().combine_chunks()
    if not table.num_rows:
        return None
    words = table["words"].combine_chunks()
    text = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
    prior = min(max(toxic / n, 0.001), 0.9)
    return fit(words.flatten().to_numpy(), text, table["p"].to_numpy().astype(bool), prior)


def scored(docs: DataFrame, labels: DataFrame, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """`docs` with a toxicity score in [0, 1] and the decision at 0.5 as further columns."""
    learnt = model(docs, labels)
    if learnt is None:
        return docs.withColumn(score, F.lit(0.0)).withColumn(predicted, F.lit(0))
    shared = docs.sparkSession.sparkContext.broadcast(learnt)  # 2^BITS weights
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])
    text_at = docs.columns.index("text")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memo("toxicity")
        weights, bias = shared.value
        for batch in slices(batches, "text"):
            index, text = features(batch.column(text_at), weights != 0)
            rates = _rate(bias + np.bincount(text, weights[index], batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates), pa.array((rates >= 0.5).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(rate, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, labels).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
