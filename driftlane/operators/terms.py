"""Term tables: rows of evidence, aggregated per scope and key, best k kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane.functions import text
from driftlane.functions import weights as wt
from driftlane.functions.plan import hold

SOURCES = ["classifier_evidence", "creator_tag", "hashtag", "youtube_topic"]
SURFACES = ["home", "up_next", "subscriptions"]


def evidence_terms(evidence: Column) -> Column:
    """Phrases of an evidence array, digits-only ones left out, first per key."""
    phrases = F.transform(evidence, lambda e: F.trim(F.coalesce(e["phrase"], F.lit(""))))
    words = F.filter(phrases, lambda p: (p != "") & ~p.rlike(r"^\d+$"))
    return F.coalesce(words, F.array().cast("array<string>"))


def card_terms(cards: DataFrame, scope: list[str], tag_base: float, topic_factor: float, evidence_factor: float,
               hashtag_factor: float | None = None) -> DataFrame:
    """Term rows of classified cards, one per card, category, source and term.

    ``cards`` has the scope columns, video_id, surface, position, title,
    description, tags, youtube_topics, ``categories`` (array of id, name, share),
    ``evidence`` (map) and ``weight``. Terms are built per card before the
    categories multiply them; everything here is map-side.
    """
    empty = F.array().cast("array<string>")
    topics = F.filter(
        F.transform(F.coalesce("youtube_topics", empty), text.topic_label), lambda t: t != ""
    )
    tags = F.filter(F.coalesce("tags", empty), lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")
    found = text.hashtags(F.col("title"), F.col("description")) if hashtag_factor is not None else empty
    base = cards.withColumns({"_topics": topics, "_tags": tags, "_hashtags": found})
    base = hold(base, "_topics", "_tags", "_hashtags").withColumns(
        {
            "_content": text.term_key(
                F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
            ),
            "_topic_text": text.term_key(F.array_join("_topics", " ")),
            "_tag_keys": text.term_keys(F.col("_tags")),
            "_hashtag_keys": text.term_keys(F.col("_hashtags")),
        }
    )
    tag_rows = F.zip_with(
        "_tags", "_tag_keys",
        lambda t, key: F.struct(
            t.alias("value"), F.lit("creator_tag").alias("source"),
            text.tag_consistency(key, F.col("_content"), F.col("_topic_text")).alias("consistency"),
        ),
    )
    base = base.withColumn("_tag_rows", tag_rows)

    def plain(values: Column, source: str) -> Column:
        return F.transform(
            values,
            lambda v: F.struct(v.alias("value"), F.lit(source).alias("source"), F.lit(1.0).alias("consistency")),
        )

    parts = [F.col("_tag_rows"), plain(F.col("_topics"), "youtube_topic")]
    if hashtag_factor is not None:
        parts.append(plain(text.first_per_key(F.col("_hashtags"), F.col("_hashtag_keys")), "hashtag"))
    per_card = hold(base.withColumn("_common", F.concat(*parts)), "_common").select(
        *scope, "video_id", "surface", "position", "weight", "evidence", "_common", F.explode("categories").alias("_c")
    )
    cid = F.col("_c.id")
    rows = per_card.select(
        *scope, cid.alias("category_id"), "video_id", "surface", "position",
        (F.col("weight") * F.col("_c.share")).alias("contribution"),
        F.explode_outer(
            F.concat("_common", plain(evidence_terms(F.col("evidence")[cid]), "classifier_evidence"))
        ).alias("_t"),
    ).filter("contribution > 0")
    factor = (
        F.when(F.col("_t.source") == "creator_tag", tag_base + (1.0 - tag_base) * F.col("_t.consistency"))
        .when(F.col("_t.source") == "youtube_topic", topic_factor)
        .when(F.col("_t.source") == "hashtag", hashtag_factor or 0.0)
        .otherwise(evidence_factor)
    )
    display = F.ltrim(F.trim("_t.value"), F.lit("#"))
    return rows.select(
        *scope, "category_id", "video_id", "surface", "position",
        text.term_key(display).alias("key"), display.alias("value"),
        F.col("_t.source").alias("source"), F.col("_t.consistency").alias("consistency"),
        F.col("contribution"), (F.col("contribution") * factor).alias("score"),
    )


def aggregate(rows: DataFrame, scope: list[str], first: list[str] = ("position",)) -> DataFrame:
    """Score, consistency and support per scope and key.

    ``rows``: scope, key, value, score, consistency, source, surface, video_id.
    The first level is per video, which makes videos countable without a
    distinct; sources and surfaces are fixed lists, so they are plain sums.
    """
    good = rows.filter((F.length("key") >= 2) & (F.col("score") > 0))
    per_video = good.groupBy(*scope, "key", "video_id").agg(
        F.sum("score").alias("score"),
        F.sum(F.col("consistency") * F.col("score")).alias("_c"),
        F.min(F.struct(*first, "value")).alias("_first"),
        *[F.sum(F.when(F.col("source") == s, F.col("score")).otherwise(0.0)).alias(f"source_{s}") for s in SOURCES],
        *[F.bool_or(F.col("surface") == s).alias(f"on_{s}") for s in SURFACES],
    )
    out = per_video.groupBy(*scope, "key").agg(
        F.sum("score").alias("score"),
        (F.sum("_c") / F.sum("score")).alias("consistency"),
        F.count(F.nullif("video_id", F.lit(""))).alias("video_support"),
        F.min("_first").alias("_first"),
        *[F.sum(f"source_{s}").alias(f"source_{s}") for s in SOURCES],
        *[F.bool_or(f"on_{s}").alias(f"on_{s}") for s in SURFACES],
    )
    return out.withColumn("value", F.col("_first.value")).drop("_first")


def in_two_scopes(rows: DataFrame, scope: list[str], inner: str = "category_id", limits: tuple = (15, 40)) -> DataFrame:
    """Ranked terms of every (scope, ``inner``) and of every scope, from one pass: ``level`` is 'inner' or 'outer'.

    Grouping sets make both levels of a row where it is read; the sums per video, the terms and
    the two orders are each one shuffle. ``limits``: rows kept per inner and per outer group.
    """
    good = rows.filter((F.length("key") >= 2) & (F.col("score") > 0))
    keys = [*scope, inner, "key", "video_id"]
    named = good.withColumns({f"_{k}": F.col(k) for k in keys})
    outer = [f"_{k}" for k in keys if k != inner]
    per_video = named.groupingSets([[f"_{k}" for k in keys], outer], *[f"_{k}" for k in keys]).agg(
        F.grouping(f"_{inner}").alias("_outer"), F.sum("score").alias("score"), F.sum(F.col("consistency") * F.col("score")).alias("_c"),
        F.min(F.struct("position", "value")).alias("_first"),
        *[F.sum(F.when(F.col("source") == s, F.col("score")).otherwise(0.0)).alias(f"source_{s}") for s in SOURCES],
    ).withColumnsRenamed({f"_{k}": k for k in keys})
    terms = per_video.groupBy("_outer", *scope, inner, "key").agg(
        wt.round_even(F.sum("score"), 4).alias("score"), wt.round_even(F.sum("_c") / F.sum("score"), 4).alias("consistency"),
        F.count(F.nullif("video_id", F.lit(""))).alias("video_support"), F.min("_first").alias("_first"),
        *[F.sum(f"source_{s}").alias(f"source_{s}") for s in SOURCES],
    ).withColumn("value", F.col("_first.value")).drop("_first")
    order = [F.desc("score"), F.desc("video_support"), F.desc("consistency"), F.asc("key")]
    ranked = wt.top_k(terms, ["_outer", *scope, inner], order, max(limits))
    level = F.when(F.col("_outer") == 1, "outer").otherwise("inner")
    return ranked.withColumn("level", level).filter(F.col("rank") <= F.when(F.col("_outer") == 1, limits[1]).otherwise(limits[0])).drop("_outer")


def rank_snapshot(terms: DataFrame, scope: list[str], limit: int) -> DataFrame:
    """Order of the one-snapshot report: score, support, consistency."""
    rows = terms.withColumns(
        {"score": wt.round_even(F.col("score"), 4), "consistency": wt.round_even(F.col("consistency"), 4)}
    )
    order = [F.desc("score"), F.desc("video_support"), F.desc("consistency"), F.asc("key")]
    return wt.top_k(rows, scope, order, limit)


def rank_session(terms: DataFrame, scope: list[str], limit: int, min_consistency: float = 0.0) -> DataFrame:
    """Order of the session report: terms on two surfaces first, with a bonus."""
    surfaces = sum(F.when(F.col(f"on_{s}"), 1).otherwise(0) for s in SURFACES)
    rows = terms.filter(F.col("consistency") >= min_consistency).withColumn("cross_surface", surfaces >= 2)
    boosted = F.col("score") * F.when(F.col("cross_surface"), 1.12).otherwise(1.0)
    rows = rows.withColumns(
        {"score": wt.round_even(boosted, 4), "consistency": wt.round_even(F.col("consistency"), 4)}
    )
    order = [
        F.desc("cross_surface"), F.desc("score"), F.desc("video_support"), F.desc("consistency"), F.asc("key"),
    ]
    return wt.top_k(rows, scope, order, limit)


def source_map(terms: DataFrame) -> DataFrame:
    """Per-source totals as a map, zeros left out."""
    pairs = F.array(*[F.struct(F.lit(s).alias("k"), wt.round_even(F.col(f"source_{s}"), 4).alias("v")) for s in SOURCES])
    return terms.withColumn("sources", F.map_from_entries(F.filter(pairs, lambda p: p["v"] > 0))).drop(
        *[f"source_{s}" for s in SOURCES]
    )
