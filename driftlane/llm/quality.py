"""Quality by importance resampling: hashed n-gram models of good and of raw text, Gumbel top-k.

Two bags of hashed n-grams are counted: over texts labelled good (the target; a bounded sample of
labelled rows) and over all documents (raw). A document's log weight is the sum, over its n-grams,
of the log ratio of the two models. Its sampling key is that weight plus Gumbel noise drawn from a
hash of id, text and seed; the k largest keys are a sample without replacement in proportion to the
weights. k is not set by hand: it is the number of documents at or above the cut which best tells
the labelled good and bad texts of the same sample apart.

N-grams are words, pairs of words, and runs of one to three word shapes (case, closing signs,
digits, whether the word repeats the one before), so that text made of unknown words still has
familiar n-grams. A null or empty text has no n-grams and weight 0. Repeated rows are counted
and scored each for itself. Without labels of both kinds the cut is 0. Ties at the k-th key are all
kept. Extra columns pass through ``select_good`` and are ignored elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.llm.base import bound, held, table
from driftlane.llm.words import inside, mix, slices, window_hashes

BUCKETS = 1 << 16
#: Labelled rows that the target model and the cut are fitted on, of each label at most.
LABELLED_ROWS = 20_000
SEED = 17


def shapes(words) -> np.ndarray:
    """A small code of each word's look: case, digits, last two signs, sameness with the word before."""
    data, starts, ends = words.data, words.starts, words.ends
    if not len(starts):
        return np.zeros(0, np.uint64)
    kind = np.zeros(256, np.uint8)
    kind[65:91], kind[48:58] = 1, 2
    kinds = kind[data]
    upper = np.minimum(np.add.reduceat((kinds == 1).astype(np.int32), starts), 3)
    digits = np.minimum(np.add.reduceat((kinds == 2).astype(np.int32), starts), 2)
    sign = np.ones(256, bool)
    sign[65:91] = sign[97:123] = sign[48:58] = False
    sign[128:] = False
    last, second = data[ends - 1], data[np.maximum(ends - 2, starts)]
    last, second = np.where(sign[last], last, 0), np.where(sign[second] & (ends - starts > 1), second, 0)
    plain = words.hashes()
    same = np.zeros(len(starts), np.uint64)
    same[1:] = plain[1:] == plain[:-1]
    same[np.minimum(words.first[:-1], len(starts) - 1)] = 0
    return (upper.astype(np.uint64) << np.uint64(24)) | (digits.astype(np.uint64) << np.uint64(20)) | (last.astype(np.uint64) << np.uint64(8)) \
        | second.astype(np.uint64) | (same << np.uint64(40))


def ngrams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of a text column: number of the first text, buckets, and the text each belongs to."""
    for at, words in slices(column, lower=False):
        plain, look = words.hashes(), mix(shapes(words) + np.uint64(1))
        text_of = np.repeat(np.arange(len(words.counts)), words.counts)
        found, owner = [], []
        for hashes, size, salt in ((plain, 1, 1), (plain, 2, 2), (look, 1, 3), (look, 2, 4), (look, 3, 5)):
            own = inside(words.first, size)
            found.append(mix(window_hashes(hashes, size)[own] + np.uint64(salt)) & np.uint64(BUCKETS - 1))
            owner.append(text_of[own])
        yield at, np.concatenate(found).astype(np.int64), np.concatenate(owner)


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n): how often each hashed n-gram occurs in the ``text`` column; a task sends one row per bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, found, _ in ngrams(batch.column(0)):
                total += np.bincount(found, minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratios(target: DataFrame, raw: DataFrame) -> np.ndarray:
    """Log ratio of the two smoothed models for each bucket (BUCKETS numbers reach the driver)."""
    sides = []
    for side in (target, raw):
        counts = np.zeros(BUCKETS)
        for row in bucket_counts(side).collect():
            counts[row["bucket"]] = row["n"]
        sides.append(np.log((counts + 0.5) / (counts.sum() + 0.5 * BUCKETS)))
    return sides[0] - sides[1]


def weights(documents: DataFrame, ratios: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, n_grams, log_weight, key of every row."""
    table_ = ratios.astype(np.float64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for at, found, owner in ngrams(batch.column(2)):
                total[at:] += np.bincount(owner, table_[found], batch.num_rows - at)
                size[at:] += np.bincount(owner, minlength=batch.num_rows - at)
            draw = mix(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ mix(np.array([seed], np.uint64)))
            uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size), pa.array(total), pa.array(total - np.log(-np.log(uniform)))],
                ["doc_id", "text_hash", "n_grams", "log_weight", "key"])

    rows = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("text_hash"), "text")
    return rows.mapInArrow(score, "doc_id long, text_hash long, n_grams long, log_weight double, key double")


def labelled(documents: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """Documents with their quality label: at most ``rows`` of each label, drawn by a hash of the id."""
    known = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").alias("_quality"))
    parts = [known.where(F.col("_quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for q in (0, 1)]
    return documents.join(F.broadcast(parts[0].union(parts[1]).dropDuplicates(["doc_id"])), "doc_id")


def best_cut(rows: list[tuple[float, int]], keep_good: float = 0.998) -> float:
    """Largest cut in log weight that still keeps ``keep_good`` of the good rows, moved down to the next bad one.

    Half way between the nearest rows on both sides of that place; 0 without rows of both kinds.
    """
    good = np.sort([w for w, q in rows if q == 1])
    bad = np.sort([w for w, q in rows if q == 0])
    if not len(good) or not len(bad):
        return 0.0
    high = good[int(len(good) * (1 - keep_good))]
    below = bad[bad < high]
    return float((below[-1] + high) / 2) if len(below) else float(high)


def kth_largest(scores: DataFrame, column: str, k: int, bins: int = 4096, rounds: int = 4) -> float:
    """A number with at least k rows at or above it, and no fewer than k only through ties or a gap of range / bins**rounds."""
    low, high = scores.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return math.inf
    above = 0
    for _ in range(rounds):
        step = (high - low) / bins
        if not step > 0:
            break
        spot = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(step)), F.lit(bins - 1))
        counts = dict(scores.where(F.col(column).between(low, high)).groupBy(spot.alias("b")).count().collect())  # at most ``bins`` rows
        for b in range(bins - 1, -1, -1):
            here = counts.get(b, 0)
            if above + here >= k:
                break
            above += here
        low, high = low + b * step, low + (b + 1) * step
    return low


def resampled(documents: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, n_grams, log_weight, key, kept of every row of ``documents``."""
    sample = held(labelled(documents, labels).select("doc_id", "text", "_quality"))
    ratios = log_ratios(sample.where("_quality = 1"), documents)
    scores = held(weights(documents, ratios, seed))
    known = weights(sample, ratios, seed).select("doc_id", F.expr("log_weight / greatest(n_grams, 1)").alias("w"))
    known = known.join(sample.select("doc_id", "_quality"), "doc_id").select("w", "_quality")
    cut = best_cut([(r[0], r[1]) for r in known.collect()])  # at most 2 * LABELLED_ROWS rows
    k = scores.where(F.expr("log_weight / greatest(n_grams, 1)") >= cut).count()
    # keys are compared after the cut is taken off, so that the k-th key lies where the classes part
    scores = scores.withColumn("key", F.col("key") - F.lit(cut) * F.col("n_grams"))
    return scores.withColumn("kept", F.col("key") >= F.lit(kth_largest(scores, "key", k)))


def select_good(documents: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``documents`` that the resampling keeps, all their columns."""
    kept = resampled(documents, labels, seed).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash"))
    keyed = documents.select(F.struct(*documents.columns).alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    return keyed.join(kept, F.expr("row.doc_id <=> _kept_id and key = _kept_hash"), "left_semi").select("row.*")


@bound("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_grams", F.round("log_weight", 6).alias("log_weight"), F.round("key", 6).alias("key"), "kept")
