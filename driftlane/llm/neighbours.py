"""Embedding near-duplicates by collision counting on sorted projections.

Every vector, scaled to length one, is projected on PROJECTIONS random directions. Two vectors
collide on a direction if their projections lie within a window around either one. At the link
threshold the difference of two projections is normal with a known spread, so the number of
collisions that all but about 1 in 30,000 linked pairs reach is known too (recall calibration);
pairs with fewer are dropped, the others are confirmed by their cosine in double precision.

Vectors of a label are sorted by their first projection into cells, cells into chunks of bounded
size; a tile is a pair of chunks whose cells can hold colliding vectors, and it counts collisions
direction by direction in arrays. A tile returns the number of links of each of its vectors and a
spanning forest, never the pairs, so a large group of copies is no large result. Equal vectors of
a label are one class, counted by its rows.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows without a label,
link with nothing; their component is their own id. Vectors of different length never link. Rows
that share an id are vectors of their own. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.llm.base import bound, held, table
from driftlane.llm.components import forest, least_ids

PROJECTIONS = 64
#: Half the window, and reach of the sort, in standard deviations of a difference at the threshold.
WINDOW, REACH = 1.5, 4.2
CELLS_PER_REACH = 2
#: Classes of one chunk, about.
CHUNK = 400
SEED = 5


def directions(size: int, count: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng((SEED, size)).standard_normal((size, count)) / math.sqrt(size)


def least_collisions(count: int = PROJECTIONS) -> int:
    """Collisions at the threshold, less four standard deviations."""
    p = math.erf(WINDOW / math.sqrt(2))
    return max(1, int(count * p - 4 * math.sqrt(count * p * (1 - p))))


def spread(size: int, cosine: float) -> float:
    """Standard deviation of the difference of two projections of vectors with that cosine."""
    return math.sqrt(max(2 - 2 * cosine, 1e-12) / size)


def keyed(vectors: DataFrame, cosine: float) -> DataFrame:
    """vec_id, label, vector (binary doubles; null if it links with nothing), size and cell of every row."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"vector": [], "size": [], "cell": []}
            labels = batch.column(1)
            for k, value in enumerate(batch.column(2)):
                usable = value.is_valid and labels[k].is_valid and len(value.values) and not value.values.null_count
                own = np.asarray(value.values, np.float64) if usable else np.zeros(0)
                norm = math.sqrt(own @ own) if usable and np.isfinite(own).all() else 0.0
                if not 0 < norm < math.inf:
                    out["vector"].append(None), out["size"].append(0), out["cell"].append(0)
                    continue
                width = REACH * spread(len(own), cosine) / CELLS_PER_REACH
                out["vector"].append(own.tobytes())
                out["size"].append(len(own))
                out["cell"].append(math.floor(float(own @ directions(len(own))[:, 0]) / norm / width))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int64()), pa.array(out["vector"], pa.binary()), pa.array(out["size"], pa.int32()), pa.array(out["cell"], pa.int32())],
                ["vec_id", "label", "vector", "size", "cell"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(scan, "vec_id long, label long, vector binary, size int, cell int")


def tiles(classes: DataFrame) -> DataFrame:
    """(tile, side, node): the tiles in which each class is compared; side 0 where both chunks are one."""
    size = classes.groupBy("label", "size", "cell").agg(F.count(F.lit(1)).alias("n"))
    chunk = held(classes.join(size, ["label", "size", "cell"]).select(
        "node", "label", "size", "cell", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / F.lit(CHUNK))).alias("part")))
    every = chunk.select("label", "size", "cell", "part").distinct()
    a = every.toDF("label", "size", "cell_a", "part_a")
    # each chunk looks up the cells from its own one on; a cell is a key, so this is an equi-join
    near = every.withColumn("cell_a", F.explode(F.sequence(F.col("cell") - CELLS_PER_REACH, F.col("cell"))))
    pairs = near.toDF("label", "size", "cell_b", "part_b", "cell_a").join(a, ["label", "size", "cell_a"]).where("cell_a < cell_b or part_a <= part_b")
    ends = pairs.withColumn("tile", F.xxhash64("label", "size", "cell_a", "part_a", "cell_b", "part_b")).select("tile", "label", "size", F.expr(
        "explode(if(cell_a = cell_b and part_a = part_b, array(struct(cell_a as cell, part_a as part, 0 as side)), "
        "array(struct(cell_a as cell, part_a as part, 1 as side), struct(cell_b as cell, part_b as part, 2 as side)))) as e"))
    return ends.select("tile", "label", "size", "e.cell", "e.part", "e.side").join(chunk, ["label", "size", "cell", "part"]).select("tile", "side", "node")


def tile_links(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """(a, b, n): b null: class a has n linked vectors in this tile; else a link of the tile's forest."""
    rows = rows.sort_values(["side", "node"], ignore_index=True)
    units = np.stack([np.frombuffer(v, np.float64) for v in rows["vector"]])
    norms = np.sqrt((units * units).sum(1))
    size = units.shape[1]
    spots = (units / norms[:, None] @ directions(size)).astype(np.float32)
    side, node, weight = rows["side"].to_numpy(), rows["node"].to_numpy(), rows["n_rows"].to_numpy()
    one = np.flatnonzero(side < 2)
    two = np.flatnonzero(side == 2) if side[0] else one
    window, least = np.float32(WINDOW * spread(size, cosine)), least_collisions()
    hits = np.zeros((len(one), len(two)), np.uint8)
    for k in range(spots.shape[1]):
        hits += np.abs(spots[one, k][:, None] - spots[two, k][None, :]) <= window
    x, y = np.nonzero(hits >= least)
    x, y = one[x], two[y]
    if not side[0]:
        x, y = x[x < y], y[x < y]
    links = np.zeros(len(rows), np.int64)
    ok = np.zeros(len(x), bool)
    for low in range(0, len(x), 100_000):
        p, q = x[low:low + 100_000], y[low:low + 100_000]
        ok[low:low + 100_000] = np.einsum("ij,ij->i", units[p], units[q]) / (norms[p] * norms[q]) >= cosine
    x, y = x[ok], y[ok]
    np.add.at(links, x, weight[y])
    np.add.at(links, y, weight[x])
    some = np.flatnonzero(links)
    tree = forest(x.tolist(), y.tolist(), len(rows))
    return pd.DataFrame({
        "a": np.concatenate([node[some], [node[i] for i, _ in tree]]).astype(np.int64),
        "b": pd.array([None] * len(some) + [int(node[j]) for _, j in tree], dtype="Int64"),
        "n": np.concatenate([links[some], np.zeros(len(tree), np.int64)]),
    })


def linked(vectors: DataFrame, cosine: float) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label)."""
    rows = held(keyed(vectors, cosine).withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector"))))
    classes = held(rows.where("vector is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("size").alias("size"), F.first("cell").alias("cell"), F.first("vector").alias("vector"),
        F.count(F.lit(1)).alias("n_rows"), F.min("vec_id").alias("vec_id")))
    work = tiles(classes).join(classes.select("node", "vector", "n_rows"), "node")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return tile_links(frame, cosine)

    found = held(work.groupBy("tile").applyInPandas(compare, "a long, b long, n long"))
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    least = least_ids(found.where("b is not null").select("a", "b"), classes, "node", "vec_id")
    per_class = classes.select("node", "vec_id", "n_rows").join(degree, "node", "left").join(least.withColumn("linked", F.lit(True)), "node", "left").select(
        F.col("node").alias("_node"), (F.coalesce("others", F.lit(0)) + F.col("n_rows") - 1).alias("n"),
        F.expr("if(linked, least_id, vec_id)").alias("component_id"))
    out = rows.select("vec_id", "node").join(per_class, F.col("node") == F.col("_node"), "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.expr("if(node is null, vec_id, component_id)").alias("component_id")).withColumn(
        "kept", F.expr("coalesce(vec_id = component_id, false)"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON least.x = vec_id LEFT JOIN degree ON degree.x = vec_id
"""


@bound("op3_neighbours", SQL)
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"), 0.93)
