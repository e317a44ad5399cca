"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.llm.base import held


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component_id) of every node of ``links``; component_id is the smallest node reachable.

    Each round links a node's larger neighbours to its smallest one, then its smaller neighbours
    likewise, until nothing changes; the number of rounds is logarithmic in a component's size.
    A node's neighbours are only ever aggregated (min), never collected, so a node with very many
    links is no large group. Null nodes and self-links are dropped; an empty table gives no rows.
    """
    edges = held(
        links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where("u <> v").distinct()
        edges = held(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    nodes = edges.select("u", F.col("v").alias("component_id")).union(edges.select("v", "v")).distinct()
    return nodes.toDF("node", "component_id")


def least_ids(links: DataFrame, nodes: DataFrame, node: str, id_: str) -> DataFrame:
    """(node, least_id) of every linked node: the smallest non-null ``id_`` among the nodes reachable."""
    joined = held(components(links, "a", "b").join(nodes.select(F.col(node).alias("node"), F.col(id_).alias("_id")), "node"))
    least = joined.groupBy("component_id").agg(F.min("_id").alias("least_id"))
    return joined.join(least, "component_id").select("node", "least_id")


def forest(a: list[int], b: list[int], n: int) -> list[tuple[int, int]]:
    """Links among 0..n-1 that join what the pairs (a, b) join: n - 1 of them at most (inside a task)."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a, b):
        p, q = top(x), top(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out
