"""Device node trees: filter, signature, surface guess, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane.functions import fixed
from driftlane.functions import weights as wt


def _clean(col: Column, limit: int) -> Column:
    text = F.substring(F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " ")), 1, limit)
    return F.nullif(text, F.lit(""))


def keep_nodes(nodes: Column) -> Column:
    """Nodes with text, description, id, selection or scrolling, not too deep,
    clipped; the first 450 of a tree."""
    cleaned = F.transform(
        nodes,
        lambda n: F.struct(
            n["depth"].alias("depth"), _clean(n["text"], 200).alias("text"),
            _clean(n["content_description"], 320).alias("content_description"),
            _clean(n["view_id"], 180).alias("view_id"),
            F.coalesce(_clean(n["class_name"], 160), F.lit("")).alias("class_name"),
            F.coalesce(n["selected"], F.lit(False)).alias("selected"),
            F.coalesce(n["scrollable"], F.lit(False)).alias("scrollable"),
        ),
    )
    kept = F.filter(
        cleaned,
        lambda n: (F.coalesce(n["depth"], F.lit(0)) <= fixed.MAX_NODE_DEPTH)
        & (
            n["text"].isNotNull() | n["content_description"].isNotNull() | n["view_id"].isNotNull()
            | n["selected"] | n["scrollable"]
        ),
    )
    return F.slice(kept, 1, fixed.MAX_NODES)


def tree_signature(nodes: Column) -> Column:
    """First 32 hex digits of the SHA-256 over depth, id, text, description and
    selection of every node."""
    lines = F.transform(
        nodes,
        lambda n: F.concat(
            F.concat_ws(
                "|", n["depth"].cast("string"), F.coalesce(n["view_id"], F.lit("")), F.coalesce(n["text"], F.lit("")),
                F.coalesce(n["content_description"], F.lit("")), n["selected"].cast("string"),
            ),
            F.lit(";"),
        ),
    )
    return F.substring(F.sha2(F.array_join(lines, ""), 256), 1, 32)


def explode_nodes(snapshots: DataFrame, keys: list[str], nodes: str = "nodes") -> DataFrame:
    """One row per node with its place in the tree."""
    rows = snapshots.select(*keys, F.posexplode(nodes).alias("place", "_n"))
    fields = ["text", "content_description", "view_id", "class_name", "selected"]
    return rows.select(*keys, "place", *[F.col(f"_n.{f}").alias(f) for f in fields])


def surface_hits(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """One row per node and matching token: surface, weight, evidence, order.

    The token table is a literal of a few entries, tested inside one projection.
    """
    hay = F.lower(F.concat_ws(" ", "text", "content_description", "view_id"))
    view = F.lower(F.coalesce("view_id", F.lit("")))
    selected = F.coalesce("selected", F.lit(False))
    tokens = F.array(*[
        F.struct(F.lit(n).alias("no"), F.lit(s).alias("surface"), F.lit(t).alias("token"), F.lit(w).alias("weight"))
        for n, (s, t, w) in enumerate((s, t, w) for s, words, w in fixed.SURFACE_TOKENS for t in words)
    ])
    extra = F.when(selected, 0.26).otherwise(0.0) + F.when(F.contains(view, F.lit("pivot")), 0.08).otherwise(0.0)
    base = nodes.withColumns({"_hay": hay, "_view": view, "_selected": selected, "_extra": extra})
    by_token = F.transform(
        F.filter(tokens, lambda t: F.contains("_hay", t["token"])),
        lambda t: F.struct(
            t["no"].alias("no"), t["surface"].alias("surface"), (t["weight"] + F.col("_extra")).alias("weight"),
            F.concat(t["token"], F.when(F.col("_selected"), "[selected]").otherwise("")).alias("evidence"),
        ),
    )
    by_view = F.when(
        F.contains("_view", F.lit("player")) | F.contains("_view", F.lit("watch")),
        F.array(F.struct(
            F.lit(1_000).alias("no"), F.lit("watch").alias("surface"), F.lit(0.24).alias("weight"),
            F.concat(F.lit("view_id:"), F.col("_view")).alias("evidence"),
        )),
    ).otherwise(F.array().cast("array<struct<no:int,surface:string,weight:double,evidence:string>>"))
    rows = base.filter(F.trim("_hay") != "").select(*keys, "place", F.explode(F.concat(by_token, by_view)).alias("_h"))
    return rows.select(*keys, "place", "_h.*")


def guess_surface(nodes: DataFrame, keys: list[str], evidence_limit: int = 12, trees: DataFrame | None = None) -> DataFrame:
    """Surface, confidence and evidence of every tree.

    Trees without a hit are ``unknown`` with .15. ``trees`` lists the keys of all
    trees; one without any node is ``unknown`` with .0. Without it, all trees
    that have nodes are answered for.
    """
    hits = surface_hits(nodes, keys)
    order = F.struct("place", "no")
    per_token = hits.groupBy(*keys, "surface", "evidence").agg(
        F.sum("weight").alias("weight"), F.min(order).alias("first")
    )
    surfaces = per_token.groupBy(*keys, "surface").agg(
        F.round(F.sum("weight"), 9).alias("score"), F.min("first").alias("first")
    )
    # a tree has five surfaces at most
    ranked = wt.top_k(surfaces, keys, [F.desc("score"), F.asc("first")], 2)
    best = ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("rank") == 1, F.col("surface"))).alias("surface"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("runner_up"),
    )
    margin = F.greatest(F.lit(0.0), F.col("score") - F.col("runner_up"))
    confidence = wt.clamp(0.30 + F.col("score") * 0.35 + margin * 0.25, 0.15, 0.95)
    kept = wt.top_k(
        per_token.join(best.select(*keys, "surface"), [*keys, "surface"], "left_semi"),
        keys, [F.asc("first")], evidence_limit, "_e",
    )
    evidence = kept.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_e", "evidence"))), lambda r: r["evidence"]).alias("evidence")
    )
    found = best.withColumn("confidence", confidence).drop("score", "runner_up").join(evidence, keys)
    every = nodes.select(*keys).distinct().withColumn("_nodes", F.lit(True))
    if trees is not None:
        every = trees.select(*keys).distinct().join(every, keys, "left")
    return every.join(found, keys, "left").select(
        *keys,
        F.coalesce("surface", F.lit("unknown")).alias("surface"),
        F.coalesce("confidence", F.when(F.col("_nodes"), 0.15).otherwise(0.0)).alias("confidence"),
        F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"),
    )


def histograms(nodes: DataFrame, fields: list[str], k: int | None = 30) -> DataFrame:
    """Most frequent values of several fields in one aggregation."""
    pairs = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields
    ])
    rows = nodes.select(F.explode(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != "")).alias("p"))
    counts = rows.groupBy("p.field", "p.value").agg(F.count("*").alias("n"))
    return wt.top_k(counts, ["field"], [F.desc("n"), F.asc("value")], k)


def totals(snapshots: DataFrame, nodes: str = "nodes") -> DataFrame:
    """Snapshots and nodes per guessed surface."""
    surface = F.coalesce(F.nullif("surface_guess.surface", F.lit("")), F.lit("unknown"))
    return snapshots.groupBy(surface.alias("surface")).agg(
        F.count("*").alias("snapshots"),
        F.sum(F.greatest(F.coalesce(F.size(nodes), F.lit(0)), F.lit(0))).alias("nodes"),
    )


def inspection(snapshots: DataFrame, fields: dict[str, str], k: int = 30, nodes: str = "nodes") -> DataFrame:
    """Totals, guessed surfaces and the ``k`` most frequent values of node fields, in one pass.

    ``fields``: name -> node field. Rows are section, value, n: ``snapshots`` and ``nodes`` without
    a value, every ``surface``, and the values of each field. A snapshot and its nodes are exploded
    into (section, value) once and counted before the shuffle.
    """
    surface = F.coalesce(F.nullif("surface_guess.surface", F.lit("")), F.lit("unknown"))
    kind = "struct<section:string,value:string,n:bigint>"

    def entry(section: str, value: Column, n: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), value.cast("string").alias("value"), n.cast("bigint").alias("n")).cast(kind)

    size = F.greatest(F.coalesce(F.size(nodes), F.lit(0)), F.lit(0))
    own = F.array(entry("snapshots", F.lit(None), F.lit(1)), entry("nodes", F.lit(None), size), entry("surface", surface, F.lit(1)))

    def values(name: str, field: str) -> Column:
        filled = F.filter(nodes, lambda r: F.coalesce(r[field].cast("string"), F.lit("")) != "")
        return F.coalesce(F.transform(filled, lambda r: entry(name, r[field], F.lit(1))), F.array().cast(f"array<{kind}>"))

    rows = snapshots.select(F.explode(F.concat(own, *[values(n, f) for n, f in fields.items()])).alias("e")).select("e.*")
    counts = rows.groupBy("section", "value").agg(F.sum("n").alias("n"))
    # totals and surfaces are groups of their own, so the cut to k rows per group keeps them all
    own_group = F.when(F.col("section").isin("snapshots", "nodes", "surface"), F.coalesce("value", F.lit("")))
    return wt.top_k(counts.withColumn("_own", own_group), ["section", "_own"], [F.desc("n"), F.asc("value")], k).select("section", "value", "n")
