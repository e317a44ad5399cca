"""Readers: documents and JSON lines to typed DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.functions import fixed, identity
from driftlane.functions.plan import hold
from driftlane.functions.weights import lookup
from driftlane.sources import schemas

BAD_LINE = "_bad_line"


def _schema(ddl: str) -> str:
    return " ".join(ddl.split())


def read_documents(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """One JSON document per file; files that do not parse are dropped."""
    return (
        spark.read.schema(_schema(ddl) + f", {BAD_LINE} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_LINE)
        .json(path, multiLine=True)
        .filter(F.col(BAD_LINE).isNull())
        .drop(BAD_LINE)
    )


def read_lines(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON lines; bad lines are skipped. Files are split between tasks."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return parse_lines(lines, ddl).filter(F.col("_row").isNotNull()).select("_row.*")


def parse_lines(lines: DataFrame, ddl: str) -> DataFrame:
    """Adds the parsed row and the raw key sets to a frame with a text ``value``.

    The keys are taken from the raw text, so a validator still sees fields the
    schema does not name.
    """
    parsed = F.from_json("value", _schema(ddl), {"mode": "PERMISSIVE"})
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    context_keys = F.coalesce(
        F.json_object_keys(F.get_json_object("value", "$.context")), F.array().cast("array<string>")
    )
    rows = lines.select(
        "*",
        F.when(F.json_object_keys("value").isNotNull(), parsed).alias("_row"),
        keys.alias("_keys"),
        context_keys.alias("_context_keys"),
        F.get_json_object("value", "$.context").alias("_context_text"),
    )
    return hold(rows, "_row", "_keys", "_context_keys", "_context_text")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot envelopes with a stable id, the surface and the profile identity."""
    docs = read_documents(spark, path, schemas.SNAPSHOT)
    return with_envelope_columns(docs)


def with_envelope_columns(docs: DataFrame) -> DataFrame:
    who = identity.profile_identity(
        F.col("collector_profile.profile_id"), F.col("collector_profile.profile_label")
    )
    return docs.select(
        F.sha2(F.to_json(F.struct("*")), 256).alias("snapshot_id"),
        lookup(F.col("source"), fixed.SURFACE_OF_SOURCE, None).cast("string").alias("surface"),
        who.alias("profile"),
        who["profile_id"].alias("profile_id"),
        F.col("collection_session_id").alias("session_id"),
        "*",
    )


def explode_cards(snapshots: DataFrame) -> DataFrame:
    """One row per card; the position falls back to the place in the list."""
    envelope = [c for c in snapshots.columns if c not in ("items", "subscription_channels")]
    rows = snapshots.select(*envelope, F.posexplode("items").alias("_index", "_card"))
    place = F.when(F.coalesce(F.col("_card.position"), F.lit(0)) == 0, F.col("_index") + 1).otherwise(
        F.col("_card.position")
    )
    card = [
        F.col(f"_card.{name}").alias(name)
        for name in (
            "video_id", "title", "channel", "url", "metadata_text", "duration_text",
            "subscription_state", "description", "tags", "youtube_category_id",
            "youtube_topics", "published_at", "statistics", "view_count", "like_count", "comment_count",
        )
        if name in snapshots.schema["items"].dataType.elementType.names
    ]
    return rows.select(*envelope, place.cast("int").alias("position"), *card)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, schemas.EVENT)


def read_device_envelopes(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, schemas.DEVICE_ENVELOPE)


def read_device_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, schemas.DEVICE_SNAPSHOT)


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return usable_submission_rows(read_documents(spark, path, schemas.SUBMISSION))


def usable_submission_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(
        (F.coalesce("participant_id", F.lit("")) != "")
        & (F.coalesce("profile_key", F.lit("")) != "")
        & (F.coalesce(F.size("interest_weights"), F.lit(0)) > 0)
    )


def read_daily_observations(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    """Daily table, partitioned by day; bounds prune partitions."""
    rows = spark.read.schema(_schema(schemas.DAILY_OBSERVATION)).parquet(path).filter("day is not null")
    if since is not None:
        rows = rows.filter(F.col("day") >= F.lit(since))
    if until is not None:
        rows = rows.filter(F.col("day") <= F.lit(until))
    return rows


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    edges = read_documents(spark, path, schemas.RELATIONS).select(F.explode("edges").alias("e"))
    return edges.select(
        F.col("e.source").alias("src"), F.col("e.target").alias("dst"),
        F.col("e.weight").alias("weight"), F.coalesce("e.bidirectional", F.lit(False)).alias("both_ways"),
    )


def resolve_surface_rows(raw: DataFrame, classified: DataFrame) -> DataFrame:
    """Classified form of a snapshot where there is one.

    Both frames hold one row per snapshot. Without a classified form only
    subscription snapshots are used as they are.
    """
    found = classified.withColumn("_classified", F.lit(True))
    joined = raw.alias("r").join(found.alias("c"), "snapshot_id", "left")
    picked = [
        F.when(F.col("_classified"), F.col(f"c.{c}")).otherwise(F.col(f"r.{c}")).alias(c)
        if c in classified.columns else F.col(f"r.{c}")
        for c in raw.columns if c != "snapshot_id"
    ]
    return joined.filter(
        F.col("_classified") | (F.col("r.surface") == "subscriptions")
    ).select("snapshot_id", *picked, F.coalesce("_classified", F.lit(False)).alias("is_classified"))
