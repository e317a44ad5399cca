"""MinHash near-duplicates: an inverted join on signature coordinates, confirmed on whole sets.

A text's set are its distinct word shingles (as 64-bit hashes); its signature are the least values
of COORDINATES hash functions over the set. Texts of equal sets are one class. Each class is posted
under each (coordinate, value). Two sets at the threshold agree, but for a chance of about 1 in
30,000, on at least ``least`` coordinates, so

* values that one class alone has are dropped, and then every class with fewer than ``least`` values
  (skip: it can reach the count with nobody);
* of a class with s values, only the s - least + 1 rarest need be posted (prefix: with a common order
  by frequency, two classes that share ``least`` values share one of those).

Classes that share a posted value are compared in tiles: classes that share a value with the
same least class lie together, in chunks of bounded total set size, and a tile is a pair of chunks with a value
in common. Inside a tile pairs are confirmed by the exact intersection of their whole sets, block by
block, so a tile's memory is bounded. A tile returns a spanning forest of its links, never all pairs; connected components join the forests. A value shared by very many classes
thus becomes many tiles, not one large group.

Null and empty texts have an empty set and are linked with nothing; their component is their own id.
Rows of one set share a component, whatever their ids; rows with a null id get it too, and it is
null where no row of a component has an id. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.llm.base import bound, held, table
from driftlane.llm.components import forest, least_ids
from driftlane.llm.words import blobs, give_back, inside, mix, slices, window_hashes

COORDINATES = 64
#: Shingles of one chunk of classes, about, where a class counts as PER_CLASS more.
CHUNK, PER_CLASS = 300_000, 80
#: Numbers of each matrix by which the classes of a tile are compared (4 bytes each).
BLOCK = 4_000_000
#: The list of classes to compare is broadcast to the text scan up to so many rows (16 bytes each).
BROADCAST_ROWS = 1_000_000


def least_equal(similarity: float, coordinates: int = COORDINATES) -> int:
    """Coordinates on which sets of that similarity agree, less four standard deviations."""
    mean = coordinates * similarity
    return max(1, int(mean - 4 * math.sqrt(mean * (1 - similarity))))


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of a text column: number of the first text, sorted distinct shingles, and how many each text has.

    A text with fewer words than ``shingle`` has its whole sequence as its one shingle.
    """
    for at, words in slices(column, lower=True):
        hashes = words.hashes()
        own = inside(words.first, shingle)
        text_of = np.repeat(np.arange(len(words.counts)), words.counts)
        found, owner = window_hashes(hashes, shingle)[own], text_of[own]
        for k in np.flatnonzero((words.counts > 0) & (words.counts < shingle)):
            low, high = words.first[k], words.first[k + 1]
            found = np.append(found, window_hashes(hashes[low:high], int(high - low)) ^ mix(np.array([high - low], np.uint64)))
            owner = np.append(owner, k)
        order = np.lexsort((found, owner))
        found, owner = found[order], owner[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        found, owner = found[new], owner[new]
        yield at, found, np.bincount(owner, minlength=len(words.counts))


def signatures(sets: np.ndarray, counts: np.ndarray, coordinates: int) -> np.ndarray:
    """(texts, coordinates) of 32-bit values; zeros for empty sets."""
    full = np.flatnonzero(counts)
    out = np.zeros((len(counts), coordinates), np.uint32)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        factors = mix(np.arange(1, coordinates + 1, dtype=np.uint64)) | np.uint64(1)
        mixed = mix(sets)
        for k, factor in enumerate(factors):
            value = mixed * factor
            out[full, k] = mix(np.minimum.reduceat(value ^ (value >> np.uint64(31)), starts)).astype(np.uint32)
    return out


def fingerprints(documents: DataFrame, shingle: int, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, set_key (null if empty) and signature (binary) of every row."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets, counts in shingle_sets(batch.column(1), shingle):
                ends = np.cumsum(counts)
                keys = [
                    hashlib.blake2b(sets[e - n:e].tobytes(), digest_size=16).digest() if n else None for e, n in zip(ends.tolist(), counts.tolist())
                ]
                found = signatures(sets, counts, coordinates)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(counts)), pa.array(counts.astype(np.int64)), pa.array(keys, pa.binary()),
                    blobs(found.ravel(), np.full(len(counts), coordinates)),
                ], ["doc_id", "n_shingles", "set_key", "signature"])
            give_back()

    return documents.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_shingles long, set_key binary, signature binary")


def postings(classes: DataFrame, coordinates: int, least: int) -> DataFrame:
    """(node, value) for the values under which a class must be posted."""
    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, coordinates + 1, dtype=np.uint64) << np.uint64(40))
        for batch in batches:
            n = batch.num_rows
            found = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, coordinates)
            value = mix(found.astype(np.uint64) ^ salt)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(n), coordinates))), pa.array(value.view(np.int64).ravel())], ["node", "value"])

    every = classes.select("node", "signature").mapInArrow(values, "node long, value long")
    shared = every.groupBy("value").agg(F.count(F.lit(1)).alias("rarity")).where("rarity > 1")
    per_node = every.join(shared, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rarity", "value"))).alias("all"))
    kept = per_node.where(F.size("all") >= least).select(
        "node", F.explode(F.slice("all", 1, F.size("all") - least + 1)).alias("p"))
    return kept.select("node", "p.value")


def tiles(posted: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, tile, side): the tiles in which each class is compared; side 1 and 2 are the two chunks, 0 both in one.

    A class's home is the least class that shares a posted value with it (or itself), so the classes
    of a large group have few homes. Homes are cut into chunks by total set size.
    """
    least = held(posted.groupBy("value").agg(F.min("node").alias("least")))
    home = posted.join(least, "value").groupBy("node").agg(F.min("least").alias("home")).join(sizes, "node")
    weight = home.groupBy("home").agg(F.sum(F.col("n_shingles") + PER_CLASS).alias("weight"))
    chunk = home.join(weight, "home").select(
        "node", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.ceil(F.col("weight") / F.lit(CHUNK)))).alias("chunk"))
    chunk = held(chunk)
    at = posted.join(chunk, "node").select("value", "chunk").distinct()
    pairs = at.select("value", F.col("chunk").alias("a")).join(at.select("value", F.col("chunk").alias("b")), "value").where("a <= b")
    pairs = pairs.select("a", "b").distinct().select("a", "b", F.xxhash64("a", "b").alias("tile"))
    ends = pairs.select("tile", F.expr(
        "explode(if(a = b, array(struct(a as chunk, 0 as side)), array(struct(a as chunk, 1 as side), struct(b as chunk, 2 as side)))) as e"
    )).select("tile", "e.chunk", "e.side")
    return ends.join(chunk, "chunk").select("node", "tile", "side")


def tile_links(rows: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Spanning links of one tile: pairs with 100 * intersection >= percent * union, confirmed on whole sets."""
    rows = rows.sort_values("node", ignore_index=True)
    n = len(rows)
    sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
    size = np.fromiter(map(len, sets), np.int64, n)
    side = rows["side"].to_numpy()
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    sorted_flat = flat[order]
    run = np.flatnonzero(np.r_[True, sorted_flat[1:] != sorted_flat[:-1], True])
    column = np.repeat(np.arange(len(run) - 1), np.diff(run))
    wide = np.diff(run)[column] > 1  # a shingle of one class alone is in no intersection
    owner, column = owner[order][wide], column[wide]
    _, column = np.unique(column, return_inverse=True)
    n_columns = int(column.max()) + 1 if len(column) else 0
    step = max(1, BLOCK // n)  # rows and columns of the 0/1 matrix at once
    parts = [(column >= low) & (column < low + step) for low in range(0, n_columns, step)]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for top in range(0, n, step):
        common = np.zeros((min(step, n - top), n), np.float32)
        for k, own in enumerate(parts):
            matrix = np.zeros((n, min(step, n_columns - k * step)), np.float32)
            matrix[owner[own], column[own] - k * step] = 1
            common += matrix[top:top + step] @ matrix.T
        union = size[top:top + step, None] + size - common
        i, j = np.nonzero(100 * common >= percent * union)
        i += top
        pair = (i < j) & ((side[i] != side[j]) | (side[i] == 0))
        left.append(i[pair])
        right.append(j[pair])
    node = rows["node"].to_numpy()
    return [(int(node[x]), int(node[y])) for x, y in forest(np.concatenate(left).tolist(), np.concatenate(right).tolist(), n)]


def linked(documents: DataFrame, shingle: int, percent: int, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, set_key, component_id, kept of every row of ``documents``.

    ``percent`` is the least Jaccard similarity of the shingle sets, in hundredths.
    """
    least = least_equal(percent / 100, coordinates)
    seen = held(fingerprints(documents, shingle, coordinates))
    classes = held(seen.where("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"),
    ).withColumn("node", F.monotonically_increasing_id()))  # written once, so the numbers stay; unlike hashes they are distinct
    posted = held(postings(classes, coordinates, least))
    placed = held(tiles(posted, classes.select("node", "n_shingles")))
    wanted = placed.select("node").distinct().join(classes, "node").select(F.col("node").alias("_node"), F.col("doc_id").alias("_id"), F.col("set_key").alias("_key"))
    wanted = held(wanted)
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets, counts in shingle_sets(batch.column(2), shingle):
                ends = np.cumsum(counts)
                keys = [hashlib.blake2b(sets[e - n:e].tobytes(), digest_size=16).digest() for e, n in zip(ends.tolist(), counts.tolist())]
                same = np.flatnonzero([k == w for k, w in zip(keys, batch.column(1).slice(at, len(counts)).to_pylist())])
                taken = np.concatenate([sets[ends[k] - counts[k]:ends[k]] for k in same]) if len(same) else sets[:0]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(same + at)), blobs(taken, counts[same])], ["node", "shingles"])
            give_back()

    texts = documents.select("doc_id", "text").join(wanted, F.expr("doc_id <=> _id")).select("_node", "_key", "text")
    sets = texts.mapInArrow(gather, "node long, shingles binary").dropDuplicates(["node"])
    work = placed.join(sets, "node")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        links = tile_links(rows, percent)
        give_back()
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    links = work.groupBy("tile").applyInPandas(compare, "a long, b long")
    joined = least_ids(links, classes, "node", "doc_id").select(F.col("node").alias("_node"), "least_id", F.lit(True).alias("_linked"))
    per_class = classes.select(F.col("set_key").alias("_key"), F.col("node").alias("_node"), F.col("doc_id").alias("_id")).join(
        joined, "_node", "left").select("_key", F.expr("if(_linked, least_id, _id)").alias("component_id"))
    out = seen.select("doc_id", "n_shingles", "set_key").join(per_class, F.col("set_key") == F.col("_key"), "left")
    return out.select(
        "doc_id", "n_shingles", "set_key", F.expr("if(set_key is null, doc_id, component_id)").alias("component_id"),
    ).withColumn("kept", F.expr("coalesce(doc_id = component_id, false)"))


def drop_near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group: the one with the group's smallest id. Rows without an id stay."""
    gone = linked(documents, shingle, percent).where("doc_id is not null and not kept").select(F.col("doc_id").alias("_gone_id")).distinct()
    return documents.join(gone, F.col("doc_id") == F.col("_gone_id"), "left_anti")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p0, p0 + 2), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS p0 FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
pairs AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, b.y FROM reach r JOIN pairs b ON r.y = b.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN least ON x = d.doc_id
"""


@bound("op10_minhash", SQL)
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), shingle=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")
