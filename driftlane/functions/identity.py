"""Keys, names, days and click labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlane.functions import fixed
from driftlane.functions.weights import lookup


def short_hash(col: Column, length: int) -> Column:
    return F.substring(F.sha2(col, 256), 1, length)


def profile_key(participant_id: Column, profile_id: Column) -> Column:
    return F.concat(
        F.lit(fixed.PROFILE_KEY_PREFIX), short_hash(F.concat_ws("|", participant_id, profile_id), 24)
    )


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def safe_token(col: Column, limit: int = 48) -> Column:
    token = F.substring(F.regexp_replace(F.coalesce(col, F.lit("")), "[^A-Za-z0-9_-]", ""), 1, limit)
    return F.coalesce(blank_to_null(token), F.lit("unknown"))


def profile_short_id(profile_id: Column) -> Column:
    text = F.regexp_replace(F.trim(F.coalesce(profile_id, F.lit(""))), "^browser-", "")
    return F.coalesce(
        blank_to_null(F.substring(F.regexp_replace(text, "[^A-Za-z0-9]", ""), 1, 8)), F.lit("legacy")
    )


def profile_identity(profile_id: Column, label: Column) -> Column:
    """struct(profile_id, profile_label, profile_short_id) with defaults."""
    pid = F.trim(F.coalesce(blank_to_null(profile_id), F.lit("legacy-unidentified")))
    short = profile_short_id(pid)
    name = F.substring(
        F.trim(F.coalesce(blank_to_null(label), F.concat(F.lit("Profile "), short))), 1, 60
    )
    return F.struct(
        pid.alias("profile_id"), name.alias("profile_label"), short.alias("profile_short_id")
    )


def event_day(captured_at: Column) -> Column:
    """Calendar day as written: the first ten characters, no zone conversion."""
    return F.substring(captured_at, 1, 10).try_cast("date")


def parse_instant(value: Column) -> Column:
    """ISO text to timestamp; 'Z' or offset is honoured, naive text is UTC."""
    return F.try_to_timestamp(blank_to_null(value))


def event_score(event_type: Column) -> Column:
    return lookup(event_type, fixed.EVENT_SCORE, None).cast("double")


def browser_click_event(label: Column, in_comment_box: Column, pressed: Column) -> Column:
    """struct(event_type, confidence) of a click in a page, null if it is none.

    ``pressed`` is the toggle state after the click ('true', 'false' or null).
    """
    text = F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))
    sure = F.when(pressed.isNull(), 0.7).otherwise(0.95)
    off = F.coalesce(pressed == "false", F.lit(False))

    def event(name: Column, confidence: Column) -> Column:
        return F.struct(name.alias("event_type"), confidence.cast("double").alias("confidence"))

    return (
        F.when(
            F.coalesce(in_comment_box, F.lit(False)) & text.rlike(fixed.BROWSER_COMMENT_LABEL),
            event(F.lit("comment_submit"), F.lit(0.95)),
        )
        .when(
            text.rlike(fixed.DISLIKE_LABEL),
            event(F.when(off, "undislike").otherwise("dislike"), sure),
        )
        .when(
            text.rlike(fixed.LIKE_LABEL),
            event(F.when(off, "unlike").otherwise("like"), sure),
        )
    )


def device_click_event(label: Column, selected: Column) -> Column:
    """struct(event_type, score, confidence) of a click on a device, null if none."""
    text = F.lower(F.substring(F.trim(F.regexp_replace(label, r"\s+", " ")), 1, 500))
    on = F.coalesce(selected, F.lit(False))

    def event(name: Column, confidence: float) -> Column:
        return F.struct(
            name.alias("event_type"),
            event_score(name).alias("score"),
            F.lit(confidence).alias("confidence"),
        )

    submit = F.lit(False)
    for words in fixed.DEVICE_COMMENT_LABELS:
        submit = submit | F.contains(text, F.lit(words))
    return (
        F.when(text.rlike(fixed.DISLIKE_LABEL), event(F.when(on, "dislike").otherwise("undislike"), 0.75))
        .when(text.rlike(fixed.LIKE_LABEL), event(F.when(on, "like").otherwise("unlike"), 0.75))
        .when(submit, event(F.lit("comment_submit"), 0.9))
    )
