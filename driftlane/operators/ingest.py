"""Collection-side operators: enrichment, cleaning, quotas, latest states."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlane.functions import fixed, text
from driftlane.functions import weights as wt
from driftlane.functions.plan import micros
from driftlane.operators import joins
from driftlane.operators.sequence import with_previous

METADATA = [
    "description", "tags", "youtube_category_id", "youtube_topics", "published_at", "statistics",
]


# --------------------------------------------------------------------- enrichment
def enrich(cards: DataFrame, metadata: DataFrame, key: str = "video_id", fields: list[str] = tuple(METADATA)) -> DataFrame:
    """Cards with the metadata of their video; unmatched cards keep their own.

    Adds ``enriched``. A video may be on any share of the cards: see joins.lookup.
    """
    one = metadata.groupBy(key).agg(F.max(F.struct(*fields)).alias("_meta"))
    joined = joins.lookup(cards, one, key)
    found = F.col("_meta").isNotNull()
    replaced = {
        c: F.when(found, F.col("_meta")[c]).otherwise(F.col(c) if c in cards.columns else F.lit(None))
        for c in fields
    }
    return joined.withColumns({**replaced, "enriched": found}).drop("_meta")


def enrichment_coverage(enriched: DataFrame, key: str = "video_id") -> DataFrame:
    """Requested and matched videos, counted after one row per video."""
    per_video = enriched.filter(F.col(key).isNotNull()).groupBy(key).agg(F.bool_or("enriched").alias("hit"))
    return per_video.agg(
        F.count("*").alias("requested_video_count"), F.count_if("hit").alias("enriched_video_count")
    )


# ------------------------------------------------------------------------ cleaning
def valid_title(title: Column) -> Column:
    """Trimmed title, or null for blanks, bare action words and durations."""
    clean = F.trim(F.coalesce(title, F.lit("")))
    bad = (
        (clean == "") | F.lower(clean).rlike(fixed.BLANK_TITLE_LABELS) | clean.rlike(fixed.DURATION_TITLE)
    )
    return F.when(~bad, clean)


def clean_cards(cards: DataFrame, snapshot: str = "snapshot_id", limit: int = 120) -> DataFrame:
    """Valid cards, first occurrence per video, re-ranked, first ``limit`` kept.

    A snapshot is one page (bounded); the group-limited windows still cut map
    partitions before the shuffle.
    """
    rows = cards.withColumn("title", valid_title(F.col("title"))).filter(
        F.col("title").isNotNull() & F.col("video_id").rlike(fixed.VIDEO_ID)
    )
    first = wt.top_k(rows, [snapshot, "video_id"], [F.col("position")], 1, "_n").drop("_n")
    ranked = wt.top_k(first, [snapshot], [F.col("position"), F.col("video_id")], limit, "_rank")
    return ranked.withColumn("position", F.col("_rank")).drop("_rank")


def drop_parent(cards: DataFrame, snapshot: str = "snapshot_id", parent: str = "parent_video_id") -> DataFrame:
    """Up-next cards without the video they belong to; applied after the limit."""
    rows = cards.filter(~F.coalesce(F.col("video_id") == F.col(parent), F.lit(False)))
    ranked = wt.top_k(rows, [snapshot], [F.col("position"), F.col("video_id")], None, "_rank")
    return ranked.withColumn("position", F.col("_rank")).drop("_rank")


def channel_rows(snapshots: DataFrame, limit: int = 200) -> DataFrame:
    """Channels of a snapshot: first row per id or folded name, ``limit`` kept."""
    listed = snapshots.filter(F.size("subscription_channels") > 0).withColumn(
        "_names", text.term_keys(F.transform("subscription_channels", lambda c: F.coalesce(c["name"], F.lit(""))))
    )
    keyed = F.zip_with(
        "subscription_channels", "_names",
        lambda c, n: F.struct(
            c.alias("channel"),
            F.coalesce(F.nullif(F.trim(F.coalesce(c["channel_id"], F.lit(""))), F.lit("")), n).alias("key"),
        ),
    )
    listed = listed.withColumn("_rows", keyed)
    listed = listed.withColumn("_keys", F.transform("_rows", lambda r: r["key"]))
    first = F.filter("_rows", lambda r, i: (r["key"] != "") & (F.array_position("_keys", r["key"]) == i + 1))
    return listed.select(
        "profile_id", "session_id", "snapshot_id", "captured_at", F.explode(F.slice(first, 1, limit)).alias("_r")
    ).select(
        "profile_id", "session_id", "snapshot_id", "captured_at", F.col("_r.key").alias("key"),
        F.nullif(F.trim(F.coalesce("_r.channel.channel_id", F.lit(""))), F.lit("")).alias("channel_id"),
        F.coalesce(
            F.nullif(F.trim(F.coalesce("_r.channel.name", F.lit(""))), F.lit("")), F.col("_r.channel.channel_id"),
            F.lit("Unknown channel"),
        ).alias("name"),
        F.col("_r.channel.url").alias("url"),
    )


def page_channels(rows: DataFrame, snapshot: str = "snapshot_id", limit: int = 200) -> DataFrame:
    """Channel links of a page: first row per channel id or path, ``limit`` kept.

    ``rows``: snapshot, position, path, name.
    """
    cid = F.when(F.startswith("path", F.lit("/channel/")), F.get(F.split("path", "/"), F.lit(2)))
    keyed = rows.withColumn("channel_id", F.nullif(cid, F.lit(""))).withColumn("key", F.coalesce("channel_id", "path"))
    first = wt.top_k(keyed.filter("key <> ''"), [snapshot, "key"], [F.col("position")], 1, "_n").drop("_n")
    named = first.withColumn(
        "name", F.coalesce(valid_title(F.col("name")), F.regexp_replace("path", "^/@?", ""))
    )
    return wt.top_k(named, [snapshot], [F.col("position")], limit)


def annotate_subscription(cards: DataFrame, known: DataFrame, profile: str = "profile_id") -> DataFrame:
    """``subscription_state`` of a card from the profile's known channels.

    ``known``: profile, key (folded channel name). The join key has the channel
    in it, so a hot profile spreads over its channels.
    """
    name = F.trim(F.regexp_replace(F.lower(F.coalesce("channel", F.lit(""))), r"\s+", " "))
    state = F.col("subscription_state") if "subscription_state" in cards.columns else F.lit(None).cast("string")
    rows = cards.withColumn("_channel", name)
    hits = known.select(profile, F.col("key").alias("_channel"), F.lit(True).alias("_known")).filter("_channel <> ''").distinct()
    return rows.join(hits, [profile, "_channel"], "left").withColumn(
        "subscription_state",
        F.when(F.col("_known"), "subscribed").otherwise(F.coalesce(F.nullif(state, F.lit("")), F.lit("unknown"))),
    ).drop("_channel", "_known")


# ---------------------------------------------------------------- repeats, quotas
def drop_repeat_opens(
    opens: DataFrame, group: list[str], time: str, tie: list[str], video: str, bucket_seconds: int = 3600
) -> DataFrame:
    """Opens of a video other than the one opened just before."""
    rows = with_previous(opens, group, time, tie, F.col(video), "_prev", bucket_seconds)
    return rows.filter(F.col("_prev").isNull() | (F.col("_prev") != F.col(video))).drop("_prev")


def watch_opens(
    snapshots: DataFrame, group: list[str], time: str, tie: list[str], surface: str = "surface",
    window_change: str = "window_change", quiet_seconds: float = 4.0, bucket_seconds: int = 3600,
) -> DataFrame:
    """Opens seen on a device: a change into the watch surface, or a window
    change on it more than ``quiet_seconds`` after the last counted open.

    Candidates closer than that to the one before form a burst. Only inside a burst
    does a decision depend on the one before, so bursts are dealt to tasks, sorted
    and read in one pass that remembers the last counted open: a device is
    spread over its bursts, and a burst of any length takes no memory.
    """
    rows = with_previous(snapshots, group, time, tie, F.col(surface), "_prev", bucket_seconds)
    watch = F.col(surface) == "watch"
    entered = watch & (F.coalesce("_prev", F.lit("")) != "watch")
    rows = rows.withColumn("_entered", entered).filter(
        F.col("_entered") | (watch & F.coalesce(window_change, F.lit(False)))
    )
    gap_rows = with_previous(rows, group, time, tie, F.col(time), "_before", bucket_seconds)
    gap = micros(time) - micros("_before")
    limit = int(quiet_seconds * 1_000_000)
    head = F.col("_entered") | F.col("_before").isNull() | (gap > limit)
    heads = gap_rows.withColumn("_head", head)
    marked = with_last_head(heads, group, time, tie, bucket_seconds)
    keys = [*group, "_burst"]
    ordered = marked.select(*keys, time, *tie, micros(time).alias("_t"), F.col("_entered").alias("_e")).repartition(*keys).sortWithinPartitions(*keys, time, *tie)
    n = len(keys)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, None
        for batch in batches:
            keep = []
            for *key, at, entered in zip(*(batch.column(k).to_pylist() for k in [*range(n), batch.num_columns - 2, batch.num_columns - 1])):
                if key != current:
                    current, last = key, None
                keep.append(entered or last is None or at - last > limit)
                if keep[-1]:
                    last = at
            yield batch.filter(pa.array(keep, pa.bool_()))

    kept = ordered.mapInArrow(counted, ordered.schema)
    return kept.select(*group, time, *tie, F.when(F.col("_e"), 0.7).otherwise(0.55).alias("confidence"))


def with_last_head(rows: DataFrame, group: list[str], time: str, tie: list[str], bucket_seconds: int) -> DataFrame:
    """Adds ``_burst``: the time of the latest head row up to this one, by
    buckets: inside a bucket a running window, across buckets a carried value."""
    bucket = F.floor(micros(time) / (bucket_seconds * 1_000_000))
    marked = rows.withColumns({"_bucket": bucket, "_mark": F.when(F.col("_head"), F.col(time))})
    part = [*group, "_bucket"]
    inside = W.partitionBy(*part).orderBy(time, *tie).rowsBetween(W.unboundedPreceding, 0)
    local = marked.withColumn("_local", F.last("_mark", ignorenulls=True).over(inside))
    ends = marked.groupBy(*part).agg(F.max("_mark").alias("_end"))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("_carry", F.max("_end").over(before)).drop("_end")
    return local.join(carried, part, "left").withColumn("_burst", F.coalesce("_local", "_carry")).drop(
        "_bucket", "_mark", "_local", "_carry"
    )


def apply_quota(
    snapshots: DataFrame, device: list[str], surface: str, day: str, time: str, tie: list[str],
    signature: str | None, caps: dict[str, int], other_cap: int, bucket_seconds: int = 3600,
) -> DataFrame:
    """Snapshots a device store accepts: not the same tree as the stored one
    before it on that surface and day, and within the surface's daily cap."""
    group = [*device, surface, day]
    rows = snapshots
    if signature is not None:
        rows = with_previous(rows, group, time, tie, F.col(signature), "_prev", bucket_seconds)
        rows = rows.filter(F.col("_prev").isNull() | (F.col("_prev") != F.col(signature))).drop("_prev")
    cap = wt.lookup(F.col(surface), caps, other_cap)
    biggest = max([*caps.values(), other_cap])
    ranked = wt.top_k(rows, group, [F.col(time), *[F.col(t) for t in tie]], biggest, "_n")
    return ranked.filter(F.col("_n") <= cap).drop("_n")


def dedup_signature(envelopes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First envelope per signature within participant, device, slot and day."""
    return wt.top_k(envelopes, keys, [F.col(c) for c in order], 1, "_n").drop("_n")


# -------------------------------------------------------------------- latest state
def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key; map partitions are cut to one row per key."""
    return wt.top_k(rows, keys, [F.desc(c) for c in order], 1, "_n").drop("_n")


def session_manifest(snapshots: DataFrame) -> DataFrame:
    """Surfaces of a session with entry, card and channel counts and times."""
    return snapshots.groupBy("profile_id", "session_id", "surface").agg(
        F.count("*").alias("entries"),
        F.sum(F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0))).alias("item_count"),
        F.sum(F.greatest(F.coalesce(F.size("subscription_channels"), F.lit(0)), F.lit(0))).alias("channel_count"),
        F.min("captured_at").alias("first_captured_at"),
        F.max("captured_at").alias("last_captured_at"),
    )


def library_index(profiles: DataFrame) -> DataFrame:
    """Newest state of every profile with its four leading interests."""
    newest = latest(profiles, ["profile_id"], ["updated_at"])
    top = F.transform(
        F.slice("interest_weights", 1, 4),
        lambda r: F.struct(
            r["id"].alias("id"), r["name_vi"].alias("name_vi"),
            r["predicted_weight"].alias("weight"), r["trend_state"].alias("trend_state"),
        ),
    )
    return newest.select(
        "profile_id", "profile_short_id", "profile_label", "behavior_profile_name", "certainty_score",
        "daily_observation_count", top.alias("top_interests"), "updated_at",
    )
