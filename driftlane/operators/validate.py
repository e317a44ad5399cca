"""Validators: one array column with every error of a row; valid = empty array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane.functions import fixed, identity
from driftlane.functions import weights as wt
from driftlane.functions.plan import hold

EMPTY = "array<string>"


def errors(*checks: tuple[Column, str | Column]) -> Column:
    """Messages of the checks that failed; a null condition counts as failed."""
    found = [
        F.when(F.coalesce(cond, F.lit(True)), message if isinstance(message, Column) else F.lit(message))
        for cond, message in checks
    ]
    return F.filter(F.array(*found), lambda m: m.isNotNull())


def _text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def _length(col: Column, low: int, high: int) -> Column:
    return ~F.length(_text(col)).between(low, high)


def _missing(keys: Column, required: list[str]) -> Column:
    absent = F.array_except(F.array(*[F.lit(k) for k in required]), keys)
    return F.transform(absent, lambda k: F.concat(F.lit("missing "), k))


def _present(keys: Column, forbidden: list[str]) -> Column:
    return F.array_sort(F.array_intersect(keys, F.array(*[F.lit(k) for k in forbidden])))


def split(df: DataFrame, column: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine with all messages)."""
    ok = F.size(column) == 0
    return df.filter(ok).drop(column), df.filter(~ok)


# ------------------------------------------------------------------ interactions
EVENT_REQUIRED = [
    "schema_version", "event_id", "participant_id", "device_id", "profile_id", "platform",
    "captured_at", "event_type", "engagement_score", "score_model", "source",
]


def event_rules(row) -> list[tuple[Column, str]]:
    """Checks on the fields of an interaction; ``row(name)`` gives a column."""
    score = row("engagement_score").try_cast("double")
    sure = F.coalesce(row("confidence"), F.lit("1.0")).try_cast("double")
    return [
        (_text(row("schema_version")) != fixed.SCHEMA_VERSION, "unsupported schema_version"),
        (_text(row("score_model")) != fixed.SCORE_MODEL, "unsupported score_model"),
        (_text(row("source")) != fixed.EVENT_SOURCE, "invalid source"),
        (~_text(row("platform")).isin(*fixed.EVENT_PLATFORMS), "invalid platform"),
        (~_text(row("event_type")).isin(*fixed.EVENT_SCORE), "invalid event_type"),
        (
            ~F.coalesce(F.nullif(row("channel_subscription_state"), F.lit("")), F.lit("unknown"))
            .isin(*fixed.SUBSCRIPTION_STATES),
            "invalid channel_subscription_state",
        ),
        (_length(row("event_id"), 8, 120), "invalid event_id"),
        (_length(row("participant_id"), 4, 200), "invalid participant_id"),
        (_length(row("device_id"), 4, 200), "invalid device_id"),
        (_length(row("profile_id"), 1, 200), "invalid profile_id"),
        (identity.parse_instant(row("captured_at")).isNull(), "invalid captured_at"),
        (identity.parse_instant(row("captured_at")).isNotNull() & identity.event_day(row("captured_at")).isNull(), "invalid_interaction_day"),
        (score.isNull(), "invalid engagement_score"),
        (score.isNotNull() & ~score.between(-2.0, 2.0), "engagement_score outside [-2,2]"),
        (sure.isNull(), "invalid confidence"),
        (sure.isNotNull() & ~sure.between(0.0, 1.0), "confidence outside [0,1]"),
    ]


def validate_events(parsed: DataFrame) -> DataFrame:
    """Adds ``errors`` to the output of ``readers.parse_lines``.

    Forbidden keys are looked for in the raw key sets, before the typed row
    drops fields it does not know.
    """
    row = lambda name: F.col("_row")[name]
    bad, bad_context = (
        _present(F.col(c), fixed.FORBIDDEN_EVENT_KEYS) for c in ("_keys", "_context_keys")
    )
    extra = errors(
        (
            F.size(bad) > 0,
            F.concat(F.lit("comment/text content is forbidden: "), F.array_join(bad, ", ")),
        ),
        (
            F.col("_context_text").isNotNull() & ~F.startswith(F.ltrim("_context_text"), F.lit("{")),
            "context must be an object",
        ),
        (F.size(bad_context) > 0, "comment/text content is forbidden in context"),
    )
    found = F.concat(_missing(F.col("_keys"), EVENT_REQUIRED), errors(*event_rules(row)), extra)
    checked = parsed.withColumn(
        "errors", F.when(F.col("_row").isNull(), F.array(F.lit("payload must be an object"))).otherwise(found)
    )
    return hold(checked, "errors")


def sanitize_events(rows: DataFrame) -> DataFrame:
    """Clips, blanks to null, rounds; adds the event day. Rows are the typed events."""

    def clip(name: str, n: int) -> Column:
        return F.nullif(F.substring(F.coalesce(F.col(name), F.lit("")), 1, n), F.lit(""))

    return rows.select(
        F.lit(fixed.SCHEMA_VERSION).alias("schema_version"),
        F.substring("event_id", 1, 120).alias("event_id"),
        F.substring("participant_id", 1, 200).alias("participant_id"),
        F.substring("device_id", 1, 200).alias("device_id"),
        F.substring("profile_id", 1, 200).alias("profile_id"),
        clip("profile_slot", 120).alias("profile_slot"),
        "platform",
        F.substring("captured_at", 1, 80).alias("captured_at"),
        "event_type",
        wt.round_even(F.col("engagement_score").try_cast("double"), 4).alias("engagement_score"),
        F.lit(fixed.SCORE_MODEL).alias("score_model"),
        F.lit(fixed.EVENT_SOURCE).alias("source"),
        clip("video_id", 32).alias("video_id"),
        clip("video_title", 300).alias("video_title"),
        clip("channel", 240).alias("channel"),
        F.coalesce(F.nullif("channel_subscription_state", F.lit("")), F.lit("unknown")).alias("channel_subscription_state"),
        clip("surface", 80).alias("surface"),
        wt.round_even(F.coalesce(F.col("confidence").try_cast("double"), F.lit(1.0)), 4).alias("confidence"),
        "context",
        identity.event_day(F.col("captured_at")).alias("day"),
    )


# ------------------------------------------------------------------- submissions
SUBMISSION_REQUIRED = [
    "schema_version", "participant_id", "device_id", "profile_id", "profile_key", "updated_at",
    "certainty_score", "interest_weights",
]


def submission_errors(keys: Column | None = None, checked: int | None = None) -> Column:
    """Errors of a submission row; ``keys`` are its raw top-level keys.

    Every interest is checked; ``checked`` limits that to the first ones, as a
    server that answers at once may want.
    """
    rows = F.col("interest_weights") if checked is None else F.slice("interest_weights", 1, checked)
    bad = F.filter(
        F.transform(
            rows,
            lambda r, i: F.when(
                F.coalesce(r["id"], F.lit("")) == "", F.concat(F.lit("invalid interest_weights["), i.cast("string"), F.lit("]"))
            ).when(
                ~F.coalesce(r["predicted_weight"], F.lit(0.0)).between(0.0, 1.0),
                F.concat(F.lit("interest_weights["), i.cast("string"), F.lit("].predicted_weight outside [0,1]")),
            ),
        ),
        lambda m: m.isNotNull(),
    )
    found = F.concat(
        errors(
            (_text(F.col("schema_version")) != fixed.SCHEMA_VERSION, "unsupported schema_version"),
            *[(_length(F.col(c), 4, 200), f"invalid {c}") for c in ("participant_id", "device_id", "profile_id", "profile_key")],
            (~F.coalesce("certainty_score", F.lit(0.0)).between(0.0, 1.0), "certainty_score outside [0,1]"),
            (F.coalesce(F.size("interest_weights"), F.lit(0)) <= 0, "interest_weights must be a non-empty list"),
        ),
        F.coalesce(bad, F.array().cast(EMPTY)),
        errors(
            (
                ~F.coalesce(F.nullif("collector.platform", F.lit("")), F.lit("other")).isin(*fixed.SUBMISSION_PLATFORMS),
                "invalid collector.platform",
            )
        ),
    )
    if keys is None:
        return found
    forbidden = _present(keys, fixed.FORBIDDEN_SUBMISSION_KEYS)
    top = errors(
        (F.size(forbidden) > 0, F.concat(F.lit("forbidden top-level fields: "), F.array_join(forbidden, ", ")))
    )
    return F.concat(_missing(keys, SUBMISSION_REQUIRED), found, top)


def build_submissions(profiles: DataFrame) -> DataFrame:
    """Sanitised submission of a profile: clamped weights, clipped text, capped
    arrays. Labels, raw cards and channels are not carried over."""
    weights = ["today_weight", "weight_7d", "weight_30d", "long_term_weight"]

    def clip(col: Column, n: int) -> Column:
        return F.nullif(F.substring(F.coalesce(col, F.lit("")), 1, n), F.lit(""))

    def kept(name: str, field: str, n: int) -> Column:
        return F.slice(F.filter(name, lambda r: F.trim(F.coalesce(r[field], F.lit(""))) != ""), 1, n)

    def interest(r: Column) -> Column:
        numbers = ["predicted_weight", *weights]
        tail = ["home_weight", "up_next_weight", "subscription_weight"]
        return F.struct(
            F.substring(r["id"], 1, 120).alias("id"), clip(r["name_vi"], 160).alias("name_vi"),
            *[wt.bounded_number(r[c]).alias(c) for c in numbers],
            clip(r["trend_state"], 40).alias("trend_state"),
            *[wt.bounded_number(r[c]).alias(c) for c in tail],
        )

    def intent(r: Column) -> Column:
        return F.struct(
            F.substring(r["id"], 1, 80).alias("id"), clip(r["label"], 120).alias("label"),
            wt.bounded_number(r["weight"]).alias("weight"),
        )

    def term(r: Column) -> Column:
        return F.struct(
            F.substring(F.trim(r["value"]), 1, 200).alias("value"),
            *[wt.bounded_number(r[c]).alias(c) for c in ["weight", *weights]],
            clip(r["trend_state"], 40).alias("trend_state"),
        )

    return profiles.filter(F.trim(F.coalesce("profile_id", F.lit(""))) != "").select(
        F.lit(fixed.SCHEMA_VERSION).alias("schema_version"),
        "participant_id", "device_id", F.trim("profile_id").alias("profile_id"),
        identity.profile_key(F.col("participant_id"), F.trim("profile_id")).alias("profile_key"),
        clip(F.col("behavior_profile_name"), 160).alias("behavior_profile_name"),
        clip(F.col("analysis_version"), 40).alias("analysis_version"),
        F.coalesce("updated_at", F.lit("")).alias("updated_at"),
        wt.bounded_number(F.col("certainty_score")).alias("certainty_score"),
        F.greatest(F.lit(0), F.coalesce("daily_observation_count", F.lit(0))).alias("daily_observation_count"),
        F.struct(
            F.col("platform"), F.col("agent_version"), F.lit("sanitized_profile_summary").alias("submission_mode")
        ).alias("collector"),
        F.transform(kept("interest_weights", "id", 36), interest).alias("interest_weights"),
        F.transform(kept("intent_weights", "id", 16), intent).alias("intent_weights"),
        F.transform(kept("keyword_trends", "value", 50), term).alias("keyword_trends"),
        F.transform(kept("tag_trends", "value", 50), term).alias("tag_trends"),
    )


# ------------------------------------------------------------- device, snapshots
DEVICE_REQUIRED = ["schema_version", "participant_id", "device_id", "profile_slot", "sent_at", "snapshot"]


def device_errors(keys: Column | None = None) -> Column:
    """Errors of a device envelope row."""
    s = lambda name: F.col("snapshot")[name]
    nodes = F.when(s("nodes").isNotNull(), F.size(s("nodes")))
    count = s("node_count")
    in_range = count.between(0, fixed.MAX_NODES)
    body = errors(
        (_text(s("schema_version")) != fixed.SCHEMA_VERSION, "unsupported snapshot.schema_version"),
        (_text(s("platform")) != "android", "snapshot.platform must be android"),
        (_text(s("source_package")) != fixed.DEVICE_PACKAGE, "snapshot.source_package is not the observed app"),
        (_text(s("extraction_mode")) != fixed.DEVICE_EXTRACTION_MODE, "invalid snapshot.extraction_mode"),
        (~F.substring(_text(s("captured_at")), 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), "invalid snapshot.captured_at"),
        (_length(s("tree_signature"), 8, 128), "invalid snapshot.tree_signature"),
        (nodes.isNull(), "snapshot.nodes must be a list"),
        (F.coalesce(nodes > fixed.MAX_NODES, F.lit(False)), f"snapshot.nodes exceeds {fixed.MAX_NODES}"),
        (count.isNull(), "invalid snapshot.node_count"),
        (F.coalesce(~in_range, F.lit(False)), f"snapshot.node_count outside [0,{fixed.MAX_NODES}]"),
        (F.coalesce(in_range & (count != nodes), F.lit(False)), "snapshot.node_count does not match nodes length"),
        (_text(s("surface_guess")["surface"]) == "", "invalid snapshot.surface_guess"),
    )
    head = errors(
        (_text(F.col("schema_version")) != fixed.SCHEMA_VERSION, "unsupported schema_version"),
        (_length(F.col("participant_id"), 4, 200), "invalid participant_id"),
        (_length(F.col("device_id"), 4, 200), "invalid device_id"),
        (_length(F.col("profile_slot"), 1, 120), "invalid profile_slot"),
    )
    found = F.when(F.col("snapshot").isNull(), F.concat(head, F.array(F.lit("snapshot must be an object")))).otherwise(
        F.concat(head, body)
    )
    return found if keys is None else F.concat(_missing(keys, DEVICE_REQUIRED), found)


def snapshot_errors() -> Column:
    """Errors of a surface snapshot envelope; the first failed check is reported."""
    source = _text(F.col("source"))
    found = errors(
        (
            ~source.isin(*fixed.SURFACE_OF_SOURCE) | F.col("items").isNull(),
            "invalid_snapshot_schema",
        ),
        (
            (source == "youtube_up_next") & (_text(F.col("parent_video_id")) == ""),
            "missing_parent_video_id",
        ),
        (F.trim(_text(F.col("collection_session_id"))) == "", "missing_collection_session_id"),
    )
    return F.slice(found, 1, 1)
