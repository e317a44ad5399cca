"""Exposure prior of one snapshot.

Cards carry ``categories`` and ``intents`` (arrays of id, name, share), position,
confidence, demand and freshness. The contribution of a card to a category is
share x rank weight x confidence weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlane.functions import fixed
from driftlane.functions import weights as wt
from driftlane.functions.plan import hold

VECTOR = "array<struct<id:string,name:string,share:double>>"


def blend_categories(
    items: DataFrame, content: Column, target: Column, content_weight: float, target_weight: float, out: str = "categories"
) -> DataFrame:
    """Adds two category vectors mixed per id and renormalised, best first.

    Ids on one side only keep their part, as in a full outer join. The merged
    vector and its total are held, so no lambda computes them again.
    """
    none = F.array().cast("array<struct<id:string,name:string,share:double,raw_score:double>>")
    rows = items.withColumns({"_a": F.coalesce(content, none), "_b": F.coalesce(target, none)})

    def entry(c: Column, share: Column) -> Column:
        return F.struct(c["id"].alias("id"), F.coalesce(c["name"], c["id"]).alias("name"), share.alias("share"))

    def with_target(c: Column) -> Column:
        other = F.get(F.filter("_b", lambda t: t["id"] == c["id"]), F.lit(0))["share"]
        return entry(c, c["share"] * content_weight + F.coalesce(other * target_weight, F.lit(0.0)))

    only_target = F.filter("_b", lambda t: ~F.exists("_a", lambda c: c["id"] == t["id"]))
    merged = F.concat(
        F.transform("_a", with_target), F.transform(only_target, lambda t: entry(t, t["share"] * target_weight))
    )
    # the sort key is read off the finished share, and sort_array needs no comparing lambda
    keyed = F.transform(
        F.filter(merged, lambda c: F.coalesce(c["id"], F.lit("")) != ""),
        lambda c: F.struct((-c["share"]).alias("sort"), c["id"].alias("id"), c["name"].alias("name"), c["share"].alias("share")),
    )
    rows = rows.withColumn("_merged", F.sort_array(keyed))
    rows = hold(rows.drop("_a", "_b"), "_merged")
    total = F.aggregate("_merged", F.lit(0.0), lambda s, c: s + F.coalesce(c["share"], F.lit(0.0)))
    rows = hold(rows.withColumn("_total", total), "_total")
    vector = F.transform(
        "_merged",
        lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), (c["share"] / F.col("_total")).alias("share")),
    )
    return rows.withColumn(out, F.when(F.col("_total") > 0, vector).otherwise(F.array().cast(VECTOR))).drop("_merged", "_total")


def effective_categories(items: DataFrame) -> DataFrame:
    """Adds ``categories``: .78 content + .22 target where a target exists."""
    target = F.when(F.col("target_profile.available"), F.col("target_profile.categories"))
    return blend_categories(items, F.col("classification.categories"), target, 0.78, 0.22)


def effective_intents(items: DataFrame) -> DataFrame:
    """Adds ``intents``: news resting only on a weak day word is dropped."""
    evidence = F.col("intent_profile.evidence")["news"]
    phrases = F.transform(evidence, lambda e: text_key(e["phrase"]))
    weak = (F.size(evidence) > 0) & ~F.exists(phrases, lambda p: p != fixed.WEAK_NEWS_PHRASE)
    kept = F.filter(
        "intent_profile.intents",
        lambda r: (F.coalesce(r["id"], F.lit("")) != "") & ~((r["id"] == "news") & F.coalesce(weak, F.lit(False))),
    )
    # not held: named twice each, they are worked out once, and not at all where no one reads the intents
    rows = items.withColumn("_kept", kept)
    total = F.aggregate("_kept", F.lit(0.0), lambda s, r: s + r["share"])
    rows = rows.withColumn("_total", total)
    vector = F.transform(
        "_kept",
        lambda r: F.struct(
            r["id"].alias("id"), r["name"].alias("name"),
            F.when(F.col("_total") > 0, r["share"] / F.col("_total")).otherwise(r["share"]).alias("share"),
        ),
    )
    return rows.withColumn("intents", F.coalesce(vector, F.array().cast(VECTOR))).drop("_kept", "_total")


def text_key(phrase: Column) -> Column:
    """Folding of dictionary phrases inside an array; they are folded already
    but for case and outer blanks."""
    return F.lower(F.trim(phrase))


def with_weights(items: DataFrame) -> DataFrame:
    """Adds rank, confidence weight, demand and freshness with their defaults."""
    pop = F.col("popularity_profile")
    demand = F.when(F.coalesce(pop["available"], F.lit(False)), F.coalesce(pop["demand_signal"], F.lit(0.0))).otherwise(0.25)
    return items.withColumns(
        {
            "rank_weight": wt.rank_weight(F.col("position")),
            "confidence_weight": wt.confidence_weight(F.col("confidence")),
            "demand": demand,
            "freshness": wt.freshness(pop["age_days"]),
        }
    )


def contributions(items: DataFrame, group: list[str]) -> DataFrame:
    """One row per card and category with its contribution."""
    keep = [c for c in items.columns if c != "categories"]
    # outer: a plain explode would test the vector once more to drop empty ones
    rows = items.select(*keep, F.explode_outer("categories").alias("_c"))
    return rows.select(
        *keep, F.col("_c.id").alias("category_id"), F.col("_c.name").alias("category_name"),
        (F.col("_c.share") * F.col("rank_weight") * F.col("confidence_weight")).alias("contribution"),
    ).filter("contribution > 0")


def measures(rows: DataFrame, group: list[str]) -> DataFrame:
    """Interest and weighted demand, freshness and quality per category."""
    c = F.col("contribution")
    return rows.groupBy(*group, "category_id").agg(
        F.sum(c).alias("interest"),
        (F.sum(c * F.col("demand")) / F.sum(c)).alias("demand"),
        (F.sum(c * F.col("freshness")) / F.sum(c)).alias("freshness"),
        (F.sum(c * F.col("confidence_weight")) / F.sum(c)).alias("quality"),
        F.max("category_name").alias("category_name"),
    )


def distribution(measured: DataFrame, group: list[str], zones=wt.SNAPSHOT_ZONES) -> DataFrame:
    """Share, rank, top share and zone; categories per group are bounded."""
    shared = wt.share_in_group(measured, group, "interest", "share")
    whole = W.partitionBy(*group)
    ranked = shared.withColumns(
        {
            "rank": F.row_number().over(whole.orderBy(F.round("share", 9).desc(), F.asc("category_id"))),
            "top_share": F.max("share").over(whole),
        }
    )
    return ranked.withColumn("zone", wt.zone(F.col("rank"), F.col("share"), F.col("top_share"), *zones))


def shape(dist: DataFrame, group: list[str]) -> DataFrame:
    """Diversity, top share, top-3 share and archetype per snapshot."""
    out = dist.groupBy(*group).agg(
        wt.entropy(F.col("share"), F.count("*")).alias("diversity"),
        F.max("share").alias("top_share"),
        F.sum(F.when(F.col("rank") <= 3, F.col("share"))).alias("top3_share"),
        F.min_by(F.coalesce("category_name", "category_id"), "rank").alias("top_name"),
    )
    top, div, name = F.col("top_share"), F.col("diversity"), F.col("top_name")
    archetype = (
        F.when(top.isNull(), "Insufficient signal")
        .when((top >= 0.50) & (div < 0.55), F.concat(F.lit("Specialist — "), name))
        .when((top >= 0.28) & (div >= 0.65), F.concat(name, F.lit("-heavy Variety / Explorer")))
        .when(div >= 0.75, "Variety / Explorer")
        .otherwise("Mixed-interest")
    )
    return out.withColumn("archetype", archetype)


def intent_mix(rows: DataFrame, group: list[str], k: int = 3) -> DataFrame:
    """Leading intents of every category. ``rows`` still carry ``intents``."""
    pairs = rows.select(*group, "category_id", "contribution", F.explode_outer("intents").alias("_i"))
    sums = pairs.groupBy(*group, "category_id", F.col("_i.id").alias("intent_id")).agg(
        F.sum(F.col("contribution") * F.col("_i.share")).alias("w")
    )
    shared = wt.share_in_group(sums, [*group, "category_id"], "w", "share").drop("w")
    return wt.top_k(
        shared, [*group, "category_id"], [F.round("share", 9).desc(), F.asc("intent_id")], k
    )


def sample_items(rows: DataFrame, group: list[str], k: int = 4, tie: list[str] = ("position", "video_id")) -> DataFrame:
    """Cards with the largest contribution per category."""
    order = [F.round("contribution", 9).desc(), *[F.asc(c) for c in tie]]
    return wt.top_k(rows, [*group, "category_id"], order, k)


def directions(dist: DataFrame, tags: DataFrame, intents: DataFrame, group: list[str]) -> DataFrame:
    """Content directions with coherence and opportunity, ranked.

    ``tags``: ranked tag terms per group and category (score, consistency), or per
    category alone; they are averaged before they meet the distribution.
    """
    keys = [*group, "category_id"]
    known = [k for k in keys if k in tags.columns]
    quality = tags.groupBy(*known).agg(
        F.when(F.sum("score") > 0, F.sum(F.col("consistency") * F.col("score")) / F.sum("score")).alias("_tags")
    )
    top = intents.filter(F.col("rank") == 1).select(*keys, "intent_id")
    rows = dist.join(quality, known, "left").join(top, keys, "left")
    fit = F.col("share") / F.col("top_share")
    coherence = wt.clamp(0.70 * F.col("quality") + 0.30 * F.coalesce("_tags", F.lit(0.50)))
    rows = rows.withColumns({"relative_fit": fit, "coherence": coherence})
    opportunity = wt.clamp(
        0.50 * F.col("relative_fit") + 0.25 * F.col("demand") + 0.10 * F.col("freshness") + 0.15 * F.col("coherence")
    )
    intent_name = wt.lookup(F.col("intent_id"), fixed.INTENT_NAME, None)
    name = F.coalesce("category_name", "category_id")
    rows = rows.withColumns(
        {"opportunity": opportunity, "direction": F.concat_ws(" · ", name, F.coalesce(intent_name, F.col("intent_id")))}
    ).drop("_tags")
    order = [F.round("opportunity", 4).desc(), F.asc("rank")]
    return wt.top_k(rows, group, order, None, "direction_rank")


def expansion_candidates(items: DataFrame, dist: DataFrame, group: list[str], k: int = 12, tie: list[str] = ("position", "video_id")) -> DataFrame:
    """Cards whose top category is not core; best ``k`` per snapshot."""
    top = F.get("categories", F.lit(0))["id"]
    cards = items.withColumn("category_id", top).filter(F.col("category_id").isNotNull()).drop("categories", "intents")
    zones = dist.select(*group, "category_id", "zone")
    keys = [*group, "category_id"]
    rest = cards.join(zones, keys, "left").filter(F.col("zone").isNull() | (F.col("zone") != "core"))
    rest = rest.withColumns(
        {
            "zone": F.when(F.col("zone") == "adjacent", "adjacent").otherwise("exploration"),
            "expansion_score": wt.round_even(
                F.col("rank_weight") * (0.65 + 0.25 * F.col("demand") + 0.10 * F.col("freshness")), 4
            ),
        }
    )
    return wt.top_k(rest, group, [F.desc("expansion_score"), *[F.asc(c) for c in tie]], k)


def evidence_quality(items: DataFrame, group: list[str]) -> DataFrame:
    """Counts, rates and certainty of a snapshot."""
    n = F.count("*")
    classified = F.count_if((F.col("confidence") != "unknown") & (F.size("categories") > 0))
    enriched = F.count_if(F.col("mode") == "enriched")
    out = items.groupBy(*group).agg(
        n.alias("video_count"), classified.alias("classified_count"), enriched.alias("enriched_count"),
        F.avg("confidence_weight").alias("average_confidence"),
    )
    n = F.col("video_count")
    certainty = F.least(
        F.lit(0.75),
        0.25 * F.least(F.lit(1.0), n / 50.0) + 0.30 * F.col("classified_count") / n
        + 0.25 * F.col("enriched_count") / n + 0.20 * F.col("average_confidence"),
    )
    return out.withColumn("certainty", certainty)
