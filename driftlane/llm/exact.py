"""Exact duplicates against a history of texts, by a minimal perfect hash over its distinct digests.

The history is an index in buckets of the digest's first bits. A bucket holds a minimal perfect hash
of its digests: level after level, each digest not placed yet marks a position; positions that one
digest alone marks are set, the others try again with another seed. The number of set positions before
a digest's own is its slot, so n digests have the slots 0 to n - 1. A slot holds the whole digest, the
largest doc_id with that text (the locator of the winner) and the number of rows. A foreign digest may
land on any slot; it is a member only if the slot's 32 bytes equal its own. Nonmembers are grouped by
digest among themselves.

Rows are counted per digest before anything meets in a bucket, so a bucket is about KEYS digests
however often one of them occurs. The index is a table: a lost task builds its buckets again, and later
corpora can be looked up in it.

Texts are equal if their bytes are; digests are SHA-256. A null text counts as empty. Of equal texts the
row with the largest id stays; a null id never does (kept is false, and keep_id null where no row has an
id). Rows that repeat id and text are all flagged as kept, ``drop_repeats`` leaves one of them. Empty
tables give empty results; extra columns pass through ``drop_repeats`` and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.llm.base import bound, held, table
from driftlane.llm.words import mix

#: Digests of one bucket, about. Positions of a level for each digest that is not placed yet.
KEYS, ROOM = 1024, 2
INDEX = "bucket long, buckets long, sizes array<int>, marks binary, digests binary, keep_ids array<string>, counts array<long>"
FOUND = "digest binary, keep_id long, group_size long, in_history boolean"


def digest_of(text: str):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def digested(documents: DataFrame) -> DataFrame:
    """doc_id, digest of every row."""
    return documents.select("doc_id", digest_of("text").alias("digest"))


def counted(digests: DataFrame) -> DataFrame:
    """digest, keep_id, group_size of every distinct digest."""
    return digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def words_of(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(len(digests), 4)


def positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where each digest lies on a level; all its bits take part, so that no two digests agree on every level."""
    seeds = mix(np.arange(4 * level + 1, 4 * level + 5, dtype=np.uint64)) | np.uint64(1)
    return (mix((mix(words) * seeds).sum(1, dtype=np.uint64)) % np.uint64(size)).astype(np.int64)


def placed(words: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, marks of all levels, and the slot of each digest; digests are distinct."""
    sizes, marks, start = [], [], 0
    spot = np.full(len(words), -1, np.int64)
    open_ = np.arange(len(words))
    while len(open_):
        size = ROOM * len(open_)
        at = positions(words[open_], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        spot[open_[alone[at]]] = at[alone[at]] + start
        open_ = open_[~alone[at]]
        marks.append(alone)
        sizes.append(size)
        start += size
    every = np.concatenate(marks) if marks else np.zeros(0, bool)
    return sizes, every, (np.cumsum(every) - 1)[spot]


def slots(words: np.ndarray, sizes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Slot on which each digest lands, -1 if no level has its mark."""
    out = np.full(len(words), -1, np.int64)
    rank, start, open_ = np.cumsum(marks) - 1, 0, np.arange(len(words))
    for level, size in enumerate(sizes):
        at = positions(words[open_], level, int(size)) + start
        hit = marks[at]
        out[open_[hit]] = rank[at[hit]]
        open_ = open_[~hit]
        start += int(size)
    return out


def in_buckets(counts: DataFrame, buckets) -> DataFrame:
    first = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    return counts.withColumn("buckets", F.lit(buckets).cast("long")).withColumn("bucket", F.pmod(first, F.col("buckets")))


def build_index(digests: DataFrame, keys: int = KEYS) -> DataFrame:
    """The history's index, one row for each bucket; ``digests`` has doc_id and digest."""
    counts = held(counted(digests))
    buckets = max(1, -(-counts.count() // keys))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        sizes, marks, slot = placed(words_of(rows["digest"].tolist()))
        order = np.argsort(slot)
        return pd.DataFrame({
            "bucket": rows["bucket"][:1], "buckets": rows["buckets"][:1], "sizes": [sizes], "marks": [np.packbits(marks).tobytes()],
            "digests": [b"".join(rows["digest"][order])], "keep_ids": [rows["keep_id"][order].tolist()],
            "counts": [rows["group_size"][order].tolist()],
        })

    # doc_id travels as text: pandas would turn nullable longs into doubles
    return held(in_buckets(counts.withColumn("keep_id", F.col("keep_id").cast("string")), buckets).groupBy("bucket").applyInPandas(build, INDEX))


def winners(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """digest, keep_id, group_size, in_history of every distinct text of the history and of ``incoming`` (doc_id, digest)."""
    buckets = index.agg(F.max("buckets")).first()[0] or 1  # one number
    arrived = in_buckets(counted(incoming).withColumn("keep_id", F.col("keep_id").cast("string")), buckets)

    def look_up(there: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        digests = rows["digest"].tolist()
        ids = [None if k is None else int(k) for k in rows["keep_id"]]
        counts = rows["group_size"].tolist()
        history = np.zeros(len(digests), bool)
        if len(there):
            one = there.iloc[0]
            whole, sizes = one["digests"], np.asarray(one["sizes"])
            marks = np.unpackbits(np.frombuffer(one["marks"], np.uint8), count=int(sizes.sum())).astype(bool)
            keep, total = [None if k is None else int(k) for k in one["keep_ids"]], list(map(int, one["counts"]))
            for k, slot in enumerate(slots(words_of(digests), sizes, marks).tolist()):
                if slot >= 0 and whole[32 * slot:32 * slot + 32] == digests[k]:
                    history[k] = True
                    keep[slot] = max((x for x in (keep[slot], ids[k]) if x is not None), default=None)
                    total[slot] += counts[k]
            new = np.flatnonzero(~history)
            digests = [whole[s:s + 32] for s in range(0, len(whole), 32)] + [digests[k] for k in new]
            ids, counts = keep + [ids[k] for k in new], total + [counts[k] for k in new]
            history = np.arange(len(digests)) < len(keep)
        return pd.DataFrame({"digest": digests, "keep_id": pd.array(ids, "Int64"), "group_size": counts, "in_history": history})

    return index.groupBy("bucket").cogroup(arrived.groupBy("bucket")).applyInPandas(look_up, FOUND)


def deduplicated(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, in_history, text_sha256 of every row of both tables (doc_id, text)."""
    old, new = held(digested(history)), held(digested(incoming))
    found = held(winners(build_index(old), new))
    repeated = found.where("group_size > 1").select(F.col("digest").alias("_digest"), "keep_id", "group_size")
    rows = old.withColumn("in_history", F.lit(True)).union(new.withColumn("in_history", F.lit(False)))
    rows = rows.join(repeated, F.col("digest") == F.col("_digest"), "left")  # texts that occur once meet nobody
    keep = F.when(F.col("_digest").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"), "in_history", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_repeats(documents: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay: texts which the index lacks, one row (largest id) of each, all columns.

    A text all of whose rows have no id keeps one of them.
    """
    keyed = documents.select(F.struct(*documents.columns).alias("row"), digest_of("text").alias("digest"))
    new = winners(index, digested(documents)).where("not in_history")
    wanted = new.select(F.col("digest").alias("wanted"), "keep_id")
    return keyed.join(wanted, F.expr("digest = wanted and row.doc_id <=> keep_id")).dropDuplicates(["digest"]).select("row.*")


def halves(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A table as history and newcomers: by a hash of the id; rows without an id are newcomers."""
    first = F.coalesce(F.xxhash64("doc_id") % 2 == 0, F.lit(False)) & F.col("doc_id").isNotNull()
    return documents.where(first), documents.where(~first)


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, coalesce(doc_id = max(doc_id) OVER w, false) AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@bound("op13_exact_dedup", SQL)
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(*halves(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
