"""Substring de-duplication: winnowed seeds, extended to the words of all repeats over a length.

Texts of one word sequence are one class; a class of several rows repeats as a whole. Every window
of LENGTH words picks the least of its SEED-word hashes as its seed (winnowing), so two equal windows
pick the same seed at the same place. Seeds are joined on their hash; those with one occurrence among
all classes drop out. Around the others, extension goes both ways for all occurrences at once: each
window that picked the seed is one key of its words, and occurrences with the same key extend over the
same words. The union of the windows with a second occurrence is the union of all maximal repeats of
at least LENGTH words. No pairs of documents are formed, so a passage in very many documents is as
many rows as it has occurrences. Windows are compared by 96 bits of two independent hashes.

Null and empty texts have no words. Texts under LENGTH words are never cut. Rows with a null id and
rows that share an id are told apart by their words. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.llm.base import bound, held, table
from driftlane.llm.words import Words, blobs, inside, slices, window_hashes

LENGTH, SEED = 35, 8
#: Class lists are broadcast to a text scan up to so many bytes, and joined by a shuffle beyond.
BROADCAST_BYTES = 32_000_000
NOTHING = hashlib.sha256(b"").hexdigest()


def seeds(words: Words, hashes: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of ``length`` words, the position each picks, and the hashes at all positions."""
    starts = inside(words.first, length)
    grams = window_hashes(hashes, seed)
    if not len(starts):
        return starts, starts, grams
    bits = np.uint64((1 << 28) - 1)
    least = (grams & ~bits) | np.arange(len(grams), dtype=np.uint64) & bits  # equal seeds: the first
    width, span = length - seed + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    low = (least[starts] & bits).astype(np.int64)
    return starts, (starts & ~int(bits)) | low if len(grams) > int(bits) else low, grams


def joined_words(words: Words, keep: np.ndarray | None = None) -> list[bytes]:
    """Each text's words (those marked in ``keep``) joined by one space."""
    n = len(words.starts)
    keep = np.ones(n, bool) if keep is None else keep
    step = np.zeros(len(words.data) + 1, np.int8)
    step[words.starts[keep]] += 1
    step[words.ends[keep]] -= 1
    solid = np.cumsum(step[:-1]) > 0
    kept = np.flatnonzero(keep)
    text_of = np.searchsorted(words.first, kept, "right")
    gap = words.starts[kept[1:][text_of[1:] == text_of[:-1]]] - 1  # the sign before every kept word but a text's first
    data = np.where(solid, words.data, np.uint8(32))
    solid[gap] = True
    before = np.zeros(len(solid) + 1, np.int64)
    np.cumsum(solid, out=before[1:])
    flat = data[solid].tobytes()
    at = before[words.offsets].tolist()
    return [flat[a:b] for a, b in zip(at, at[1:])]


def _keys(words: Words, hashes: np.ndarray) -> list[bytes | None]:
    return [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(words.first.tolist(), words.first[1:].tolist())]


def scanned(documents: DataFrame, length: int, seed: int) -> DataFrame:
    """doc_id, n_words, key (of the word sequence), words_sha256, seed hashes (binary) of every row."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words in slices(batch.column(1), False):
                hashes, n = words.hashes(), len(words.counts)
                _, picked, grams = seeds(words, hashes, length, seed)
                picked = np.unique(picked)
                count = np.diff(np.searchsorted(picked, words.first))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, n), pa.array(words.counts.astype(np.int64)), pa.array(_keys(words, hashes), pa.binary()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in joined_words(words)], pa.string()), blobs(grams[picked], count),
                ], ["doc_id", "n_words", "key", "words_sha256", "seeds"])

    return documents.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_words long, key binary, words_sha256 string, seeds binary")


def shared_seeds(classes: DataFrame) -> DataFrame:
    """(node, ranks): for each class, which of its seeds (by place in its list) occur a second time anywhere."""
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(b, np.int64) for b in batch.column(1).to_pylist()]
            count = np.fromiter(map(len, lists), np.int64, len(lists))
            rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(len(lists)), count))), pa.array(rank.astype(np.int32)),
                pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)),
            ], ["node", "rank", "seed"])

    posted = classes.select("node", "seeds").mapInArrow(post, "node long, rank int, seed long")
    twice = held(posted.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed"))
    return posted.join(twice, "seed").groupBy("node").agg(F.collect_list("rank").alias("ranks"))


def _with_texts(documents: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """node, key, text and ``column`` for the classes of ``wanted`` (node, doc_id, key, column)."""
    wanted = held(wanted.select("node", F.col("doc_id").alias("_id"), "key", column))
    size = wanted.agg(F.sum(F.lit(48) + F.octet_length(F.col(column)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    return documents.select("doc_id", "text").join(wanted, F.expr("doc_id <=> _id")).select("node", "key", column, "text")


def repeated_windows(documents: DataFrame, wanted: DataFrame, length: int, seed: int) -> DataFrame:
    """(node, at): starts of the windows of these classes that occur a second time anywhere."""
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words in slices(batch.column(3), False):
                hashes = words.hashes()
                starts, picked, _ = seeds(words, hashes, length, seed)
                every = np.unique(picked)
                marked = np.zeros(len(every), bool)
                low = np.searchsorted(every, words.first)
                keys = _keys(words, hashes)
                for k, key in enumerate(keys):
                    if key == batch.column(1)[first + k].as_py():
                        marked[low[k] + np.frombuffer(batch.column(2)[first + k].as_py(), np.int32)] = True
                starts = starts[marked[np.searchsorted(every, picked)]]
                text_of = np.searchsorted(words.first, starts, "right") - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(window_hashes(hashes, length)[starts].view(np.int64)),
                    pa.array((window_hashes(words.hashes(1), length, 1)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    batch.column(0).take(pa.array(first + text_of)), pa.array((starts - words.first[text_of]).astype(np.int32)),
                ], ["h1", "h2", "node", "at"])

    windows = _with_texts(documents, wanted, "ranks").mapInArrow(extend, "h1 long, h2 int, node long, at int")
    windows = held(windows)
    twice = held(windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"))
    return windows.join(twice, ["h1", "h2"]).select("node", "at")


def _packed(df: DataFrame, column: str) -> DataFrame:
    """(node, column): the sorted numbers of an array column as binary."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.sort(np.asarray(x, np.int32)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", column])

    return df.select("node", column).mapInArrow(pack, f"node long, {column} binary")


def _runs(df: DataFrame, length: int) -> DataFrame:
    """(node, runs): the covered word ranges of each class, as binary pairs of start and end."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column(1).to_pylist():
                at = np.unique(np.asarray(x, np.int32))
                cut = np.flatnonzero(np.diff(at) > length) + 1
                pairs = np.stack([at[np.r_[0, cut]], at[np.r_[cut - 1, len(at) - 1]] + length], 1)
                found.append(pairs.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "runs"])

    return df.groupBy("node").agg(F.collect_list("at").alias("at")).mapInArrow(pack, "node long, runs binary")


def cut_texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, n_removed, kept (text) of the classes that lose some words."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words in slices(batch.column(3), False):
                keep, keys = np.ones(len(words.starts), bool), _keys(words, words.hashes())
                same = [key == batch.column(1)[first + k].as_py() for k, key in enumerate(keys)]
                for k in np.flatnonzero(same):
                    for a, b in np.frombuffer(batch.column(2)[first + k].as_py(), np.int32).reshape(-1, 2):
                        keep[words.first[k] + a:words.first[k] + b] = False
                gone = np.add.reduceat(np.append(~keep, False).astype(np.int64), words.first[:-1]) * (words.counts > 0)
                rows = np.flatnonzero(same)
                texts = joined_words(words, keep)
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(first, len(keys)).take(pa.array(rows)), pa.array(gone[rows]), pa.array([texts[k].decode() for k in rows], pa.string()),
                ], ["key", "n_removed", "kept"])

    return _with_texts(documents, wanted, "runs").mapInArrow(cut, "key binary, n_removed long, kept string")


def deduplicated(documents: DataFrame, length: int = LENGTH, seed: int = SEED, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; with ``texts``, kept (null where nothing is removed)."""
    seen = held(scanned(documents, length, seed))
    long_ = seen.where(F.col("n_words") >= length)
    classes = held(long_.groupBy("key").agg(
        F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("doc_id"), F.first("seeds").alias("seeds"),
    ).withColumn("node", F.xxhash64("key")))
    whole = classes.where("rows > 1").select("key", F.lit(True).alias("whole"))
    ranks = _packed(shared_seeds(classes), "ranks").join(classes.select("node", "doc_id", "key"), "node")
    windows = repeated_windows(documents, ranks, length, seed)
    runs = _runs(windows, length).join(classes.where("rows = 1").select("node", "doc_id", "key"), "node")
    cut = cut_texts(documents, runs).select("key", "n_removed", F.sha2("kept", 256).alias("sha"), *(["kept"] if texts else []))
    changed = cut.withColumn("whole", F.lit(False)).unionByName(whole, allowMissingColumns=True).withColumnRenamed("key", "_key")
    out = seen.drop("seeds").join(held(changed), F.col("key") == F.col("_key"), "left")
    kept = [F.expr("if(whole, '', kept)").alias("kept")] if texts else []
    return out.select(
        "doc_id", "n_words", F.expr("if(whole, n_words, coalesce(n_removed, 0L))").alias("n_removed"),
        F.expr(f"if(whole, '{NOTHING}', coalesce(sha, words_sha256))").alias("kept_sha256"), *kept)


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p0, array_to_string(list_slice(w, p0, p0 + {LENGTH} - 1), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH} + 2)) AS p0 FROM d WHERE len(w) >= {LENGTH})),
twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(p0, p0 + {LENGTH})) AS p FROM win JOIN twice USING (s))),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@bound("op8_substrings", SQL)
def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
