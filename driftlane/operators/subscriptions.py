"""Evidence from the subscription feed of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.functions import text
from driftlane.functions import weights as wt
from driftlane.operators.terms import evidence_terms


def category_distribution(items: DataFrame, group: list[str]) -> DataFrame:
    """Share per category; ``items`` carry ``categories`` and ``weight``."""
    rows = items.select(*group, "weight", F.explode("categories").alias("_c")).groupBy(
        *group, F.col("_c.id").alias("key")
    ).agg(F.sum(F.col("weight") * F.col("_c.share")).alias("_w"))
    return wt.share_in_group(rows, group, "_w", "weight").drop("_w")


def term_scores(items: DataFrame, group: list[str]) -> DataFrame:
    """Scores per field ('keyword' or 'tag') and key.

    Phrases count with the contribution of their category; tags with the card's
    weight times their consistency, as a tag in full and as a keyword at .70;
    topics at .90 of the weight.
    """
    empty = F.array().cast("array<string>")
    tags = F.filter(F.coalesce("tags", empty), lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")
    topics = F.filter(F.transform(F.coalesce("youtube_topics", empty), text.topic_label), lambda t: t != "")
    base = items.withColumns({"_tags": tags, "_topics": topics}).withColumns(
        {
            "_tag_keys": text.term_keys(F.col("_tags")),
            "_content": text.term_key(
                F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
            ),
        }
    )

    def row(field, value, score):
        return F.struct(F.lit(field).alias("field"), value.alias("value"), score.alias("score"))

    scored = F.zip_with(
        "_tags", "_tag_keys",
        lambda t, k: F.struct(t.alias("t"), (F.col("weight") * text.tag_consistency(k, F.col("_content"))).alias("s")),
    )
    base = base.withColumn("_scored", scored)
    phrases = F.flatten(
        F.transform(
            "categories",
            lambda c: F.transform(
                evidence_terms(F.col("evidence")[c["id"]]),
                lambda p: row("keyword", p, F.col("weight") * c["share"]),
            ),
        )
    )
    all_rows = F.concat(
        phrases,
        F.transform("_scored", lambda r: row("tag", r["t"], r["s"])),
        F.transform("_scored", lambda r: row("keyword", r["t"], r["s"] * 0.70)),
        F.transform("_topics", lambda t: row("keyword", t, F.col("weight") * 0.90)),
    )
    rows = base.select(*group, "position", F.explode_outer(all_rows).alias("_r"))
    display = F.ltrim(F.trim("_r.value"), F.lit("#"))
    keyed = rows.select(
        *group, "position", F.col("_r.field").alias("field"), text.term_key(display).alias("key"),
        display.alias("value"), F.col("_r.score").alias("score"),
    ).filter((F.length("key") >= 2) & (F.col("score") > 0))
    return keyed.groupBy(*group, "field", "key").agg(
        F.sum("score").alias("score"), F.min_by("value", F.struct("position", "value")).alias("value")
    )
