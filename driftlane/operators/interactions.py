"""Interaction events: exact de-duplication, daily roll-up, look-back windows.

The daily table is the state: windows are computed from it for any evaluation
day, and late events only touch the day they belong to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlane.functions import fixed
from driftlane.functions import weights as wt

PROFILE = ["participant_id", "device_id", "profile_id"]
TYPES = list(fixed.EVENT_SCORE)
STATES = fixed.SUBSCRIPTION_STATES


def dedup(events: DataFrame, keys: list[str] = (*PROFILE, "day", "event_id"), order: list[str] = ("captured_at",)) -> DataFrame:
    """First event per key. The key holds the event id, so groups are small
    whatever share one profile has; map partitions are cut to one row per key."""
    return wt.top_k(events, list(keys), [F.col(c) for c in order], 1, "_n").drop("_n")


def new_events(batch: DataFrame, stored: DataFrame, keys: list[str] = (*PROFILE, "day", "event_id")) -> DataFrame:
    """Events of a batch that are not stored yet."""
    return dedup(batch, keys).join(stored.select(*keys), list(keys), "left_anti")


def daily(
    events: DataFrame, group: list[str] = tuple(PROFILE), types: list[str] = tuple(TYPES),
    open_type: str = "video_open", states: list[str] = tuple(STATES),
) -> DataFrame:
    """Counters per profile and day: one partial + final aggregate, the counts
    of the known types as columns (``n_<type>``, ``open_<state>``)."""
    opened = F.col("event_type") == open_type
    state = F.coalesce(F.nullif("channel_subscription_state", F.lit("")), F.lit("unknown"))
    return events.groupBy(*group, "day").agg(
        F.count("*").alias("event_count"),
        wt.round_even(F.sum("engagement_score"), 4).alias("score_total"),
        *[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in types],
        *[F.count_if(opened & (state == s)).alias(f"open_{s}") for s in states],
    )


def _counters(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c.startswith(("n_", "open_"))]


def window(daily_rows: DataFrame, as_of, days: int, group: list[str] = tuple(PROFILE)) -> DataFrame:
    """Sums over the last ``days`` days up to ``as_of``; later days are left out."""
    end = F.lit(as_of).cast("date") if not isinstance(as_of, Column) else as_of
    inside = daily_rows.filter((F.col("day") <= end) & (F.col("day") > F.date_sub(end, days)))
    return inside.groupBy(*group).agg(
        F.count("*").alias("observed_days"),
        F.sum("event_count").alias("event_count"),
        wt.round_even(F.sum("score_total"), 4).alias("score_total"),
        *[F.sum(c).alias(c) for c in _counters(daily_rows)],
    ).withColumn("window_days", F.lit(days))


def running_window(daily_rows: DataFrame, days: int, group: list[str] = tuple(PROFILE)) -> DataFrame:
    """The same sums for every observed day; a profile has one row per day."""
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    rows = daily_rows.withColumn("_number", number)
    frame = W.partitionBy(*group).orderBy("_number").rangeBetween(-(days - 1), 0)
    return rows.select(
        *group, "day",
        F.count("*").over(frame).alias("observed_days"),
        F.sum("event_count").over(frame).alias("event_count"),
        wt.round_even(F.sum("score_total").over(frame), 4).alias("score_total"),
    )


def as_maps(rows: DataFrame) -> DataFrame:
    """Counter columns folded into the two maps of a summary, zeros left out."""
    def folded(prefix: str) -> Column:
        names = [c for c in rows.columns if c.startswith(prefix)]
        pairs = F.array(*[F.struct(F.lit(c[len(prefix):]).alias("k"), F.col(c).alias("v")) for c in names])
        return F.map_from_entries(F.filter(pairs, lambda p: p["v"] > 0))

    return rows.withColumns(
        {"event_counts": folded("n_"), "video_open_subscription_counts": folded("open_")}
    ).drop(*_counters(rows))


def profile_summary(daily_rows: DataFrame, latest: DataFrame, as_of) -> DataFrame:
    """7-day and 30-day totals of the device a profile was last seen on.

    ``latest``: profile_id with the participant and device of its newest event.
    """
    keyed = daily_rows.join(latest, PROFILE, "left_semi")
    week, month = (window(keyed, as_of, n) for n in (7, 30))
    return (
        latest.join(week.select(*PROFILE, F.struct("observed_days", "event_count", "score_total").alias("rolling_7d")), PROFILE, "left")
        .join(month.select(*PROFILE, F.struct("observed_days", "event_count", "score_total").alias("rolling_30d")), PROFILE, "left")
    )


def latest_device(events: DataFrame, order: str = "captured_at") -> DataFrame:
    """Participant and device of the newest event per profile id.

    An aggregate, not a window: a hot profile is reduced before the shuffle.
    """
    newest = F.max(F.struct(order, "participant_id", "device_id")).alias("_m")
    return events.groupBy("profile_id").agg(newest).select(
        F.col("_m.participant_id").alias("participant_id"), F.col("_m.device_id").alias("device_id"), "profile_id"
    )


def attach(profiles: DataFrame, summary: DataFrame) -> DataFrame:
    """Profiles with their interaction summary, where there is one."""
    packed = summary.select(
        "profile_id", F.struct(F.lit(fixed.SCORE_MODEL).alias("score_model"), "rolling_7d", "rolling_30d").alias("natural_interactions")
    )
    return profiles.join(packed, "profile_id", "left")
