"""Toxicity by non-negative positive-unlabelled learning (numpy).

Confirmed toxic texts are the positives, a sample of all documents is the unlabelled set (which holds
toxic texts too). A linear model of word features g(x) is fitted to the risk
    prior * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - prior * E_pos[loss(-g)])
with logistic loss; where the second term would turn negative, the step goes up along it, so that the
model cannot gain by fitting the unlabelled texts away. The prior is the share of toxic rows among the
labelled ones. Features are words and word beginnings, hashed into BUCKETS; a word or beginning that
stands in a text several times gives a second feature. Every bucket that LEAST positives of different
text have, and positives clearly more often than unlabelled texts, is used.

Fitting reads bounded samples (POSITIVES, UNLABELLED rows, drawn by a hash of the id); scoring reads
every whole text. Scores are sigmoid(g) of the text alone: labels, language, source and id are no
inputs. Null and empty texts get the model's score without any feature. Without positives every score
is the prior. Repeated rows are scored each for itself; rows with a null id are scored, and held_out
is then false. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.llm.base import bound, held, table
from driftlane.llm.words import mix, powers, slices

BUCKETS = 1 << 18
BEGINNINGS = (4, 5, 6)
#: Occurrences in one text from which a bucket gives its second feature.
SEVERAL = 3
POSITIVES, UNLABELLED = 6_000, 24_000
#: Positives of different text that a bucket must stand in, and standard errors above the unlabelled share.
LEAST, CLEARLY = 8, 4
STEPS, RATE, SHRINK = 400, 0.05, 1e-4
THRESHOLD = 0.3
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of a text column: number of the first text, texts, and distinct (text, bucket) pairs."""
    for at, words in slices(column, True, NOT_LETTER):
        n = len(words.counts)
        if not len(words.starts):
            yield at, n, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        text_of = np.repeat(np.arange(n, dtype=np.int64), words.counts)
        found, owner = [mix(words.hashes() + np.uint64(1))], [text_of]
        size = words.ends - words.starts
        for k in BEGINNINGS:
            long_ = np.flatnonzero(size >= k)
            begin = words.data[words.starts[long_][:, None] + np.arange(k)].astype(np.uint64) + np.uint64(1)
            found.append(mix((begin * powers(0x100000001B3, k)).sum(1, dtype=np.uint64) + np.uint64(k << 56)))
            owner.append(text_of[long_])
        half = np.uint64(BUCKETS // 2 - 1)
        pairs = (np.concatenate(owner) << 32) | (np.concatenate(found) & half).astype(np.int64)
        pairs, count = np.unique(pairs, return_counts=True)
        pairs = np.concatenate([pairs, pairs[count >= SEVERAL] + BUCKETS // 2])
        yield at, n, pairs >> 32, pairs & 0xFFFFFFFF


def bucket_texts(texts: DataFrame) -> DataFrame:
    """(positive, bucket, n): texts of either kind with each bucket; a task sends one row per bucket and kind."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            kind = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, _, owner, bucket in features(batch.column(0)):
                total += np.bincount(kind[at + owner] * BUCKETS + bucket, minlength=2 * BUCKETS).reshape(2, BUCKETS)
        kind, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(bucket), pa.array(total[kind, bucket])], ["positive", "bucket", "n"])

    return texts.select("text", "positive").mapInArrow(count, "positive int, bucket long, n long").groupBy("positive", "bucket").agg(F.sum("n").alias("n"))


def chosen_buckets(texts: DataFrame, positives: int, unlabelled: int) -> np.ndarray:
    """Buckets that positives have more often than unlabelled texts by CLEARLY standard errors, the clearest first."""
    least = F.col("n") >= LEAST
    rows = bucket_texts(texts).groupBy("bucket").pivot("positive", [0, 1]).agg(F.sum("n")).fillna(0).withColumnRenamed("1", "n").where(least)
    got = rows.select("bucket", "n", F.col("0").alias("u")).toArrow()  # BUCKETS rows at most
    bucket, n, u = (got.column(k).to_numpy() for k in range(3))
    p, q = n / max(positives, 1), u / max(unlabelled, 1)
    both = (n + u) / max(positives + unlabelled, 1)
    z = (p - q) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / max(positives, 1) + 1 / max(unlabelled, 1)))
    order = np.argsort(-z, kind="stable")
    return bucket[order[z[order] > CLEARLY]]


def present(texts: DataFrame, buckets: np.ndarray) -> DataFrame:
    """positive and the places in ``buckets`` of a text's features, for every row."""
    spot = np.full(BUCKETS, -1, np.int32)
    spot[buckets] = np.arange(len(buckets))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, owner, bucket in features(batch.column(0)):
                own = spot[bucket] >= 0
                owner, bucket = owner[own], bucket[own]
                order = np.argsort(owner, kind="stable")
                offsets = np.searchsorted(owner[order], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(at, n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(spot[bucket][order]))], ["positive", "places"])

    return texts.select("text", "positive").mapInArrow(find, "positive int, places array<int>")


def fit(places: list[np.ndarray], positive: np.ndarray, prior: float, width: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of the linear model under the non-negative risk, by full-batch Adam."""
    count = np.fromiter(map(len, places), np.int64, len(places))
    column = np.concatenate(places).astype(np.int64) if count.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(places)), count)
    is_pos, is_unl = positive == 1, positive == 0
    n_pos, n_unl = max(1, is_pos.sum()), max(1, is_unl.sum())
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        g = np.bincount(row, w[column], len(places)) + b
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        loss_neg = np.logaddexp(0, g)
        negative = loss_neg[is_unl].sum() / n_unl - prior * loss_neg[is_pos].sum() / n_pos
        up = np.where(is_pos, -prior * (1 - s) / n_pos, 0.0)
        low = np.where(is_unl, s / n_unl, 0.0) - np.where(is_pos, prior * s / n_pos, 0.0)
        slope = up + low if negative >= 0 else -low
        grad = np.append(np.bincount(column, slope[row], width) + SHRINK * w, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def held_out(id_: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_).cast("string")), F.lit(4)) == 2, F.lit(False))


def trained(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weight of every bucket and the intercept; labels are those outside the held-out ids."""
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    n, toxic = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    prior = min(max((toxic or 0) / n if n else 0.0, 1e-3), 0.999)
    by = F.xxhash64("doc_id")
    pos = known.where("toxic = 1").select("doc_id").distinct().orderBy(by, "doc_id").limit(POSITIVES)
    unl = documents.select("doc_id").where("doc_id is not null").distinct().orderBy(by, "doc_id").limit(UNLABELLED)
    ids = pos.withColumn("positive", F.lit(1)).union(unl.withColumn("positive", F.lit(0)))
    sample = held(documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "positive").dropDuplicates(["positive", "text"]))
    sizes = dict(sample.groupBy("positive").count().collect())
    weights = np.zeros(BUCKETS)
    if not sizes.get(1):
        return weights, float(np.log(prior / (1 - prior)))
    buckets = chosen_buckets(sample, sizes.get(1, 0), sizes.get(0, 0))
    rows = present(sample, buckets).toArrow()  # POSITIVES + UNLABELLED rows at most
    places = [np.asarray(x, np.int64) for x in rows.column("places").to_pylist()]
    weights[buckets], intercept = fit(places, rows.column("positive").to_numpy(), prior, len(buckets))
    return weights, intercept


def scored(documents: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """doc_id and score of every row."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = np.full(batch.num_rows, intercept)
            for at, n, owner, bucket in features(batch.column(1)):
                g[at:at + n] += np.bincount(owner, weights[bucket], n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(g, -30, 30))))], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``documents``."""
    found = scored(documents, *trained(documents, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@bound("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
