"""Session profile: the home feed plus replayed up-next lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlane.functions import fixed, text
from driftlane.functions import weights as wt
from driftlane.functions.plan import hold
from driftlane.operators import longitudinal as lg
from driftlane.operators.exposure import blend_categories


def item_categories(items: DataFrame) -> DataFrame:
    """Adds ``categories``: .85 content + .15 target, renormalised."""
    return blend_categories(items, F.col("classification.categories"), F.col("target_profile.categories"), 0.85, 0.15)


def select_surfaces(snapshots: DataFrame) -> DataFrame:
    """Last home, last subscriptions and every up-next snapshot of a session.

    The rank runs on envelopes, before cards are exploded, and is group-limited.
    """
    newest = [F.desc("captured_at"), F.desc("snapshot_id")]
    single = snapshots.filter(F.col("surface").isin("home", "subscriptions"))
    last = wt.top_k(single, ["profile_id", "session_id", "surface"], newest, 1, "_n").drop("_n")
    return last.unionByName(snapshots.filter("surface = 'up_next'"))


# --------------------------------------------------------------- distributions
def key_sums(rows: DataFrame, group: list[str], key: str = "key", weight: str = "weight") -> DataFrame:
    return rows.groupBy(*group, key).agg(F.sum(weight).alias(weight))


def seed_mean(rows: DataFrame, session: list[str], seed: str = "seed", key: str = "key") -> DataFrame:
    """Mean of the seeds' distributions (absent keys count as 0).

    Replays of a seed share its weight, which cancels in the seed's shares. The
    shares of a seed sum to 1, so dividing by the session total is the mean.
    """
    per_seed = wt.share_in_group(key_sums(rows, [*session, seed], key), [*session, seed], "weight", "share")
    summed = per_seed.groupBy(*session, key).agg(F.sum("share").alias("_sum"))
    return wt.share_in_group(summed, session, "_sum", "share").drop("_sum")


def blend_surfaces(home: DataFrame, up_next: DataFrame, session: list[str], key: str = "key", bonus: bool = True) -> DataFrame:
    """.62 home + .38 up-next with a bonus for keys on both; one surface alone
    passes through. Both inputs: session, key, share.

    A union with one aggregate does the work of a full outer join.
    """
    rows = home.select(*session, key, F.col("share").alias("_h"), F.lit(0.0).alias("_u")).unionByName(
        up_next.select(*session, key, F.lit(0.0).alias("_h"), F.col("share").alias("_u"))
    )
    both = rows.groupBy(*session, key).agg(F.sum("_h").alias("home"), F.sum("_u").alias("up_next"))
    whole = W.partitionBy(*session)
    flags = both.withColumns(
        {"_has_home": F.bool_or(F.col("home") > 0).over(whole), "_has_up": F.bool_or(F.col("up_next") > 0).over(whole)}
    )
    h, u = F.col("home"), F.col("up_next")
    cross = (h > 0) & (u > 0)
    mixed = (
        fixed.SESSION_SURFACE_WEIGHT["home"] * h + fixed.SESSION_SURFACE_WEIGHT["up_next"] * u
    ) * (F.when(cross, fixed.BOTH_SURFACES_BONUS).otherwise(1.0) if bonus else F.lit(1.0))
    flags = flags.withColumns(
        {"_mix": F.when(F.col("_has_home") & F.col("_has_up"), mixed).otherwise(h + u), "cross_surface": cross}
    )
    return wt.share_in_group(flags, session, "_mix", "share").drop("_mix", "_has_home", "_has_up")


def interest_rows(blended: DataFrame, demand: DataFrame, session: list[str], key: str = "key") -> DataFrame:
    """Zone, stability and opportunity of every interest of a session.

    ``demand``: session, key, demand (contribution-weighted mean).
    """
    whole = W.partitionBy(*session)
    rows = blended.join(demand, [*session, key], "left").withColumns(
        {
            "rank": F.row_number().over(whole.orderBy(F.round("share", 9).desc(), F.asc(key))),
            "top_share": F.max("share").over(whole),
            "demand": F.coalesce("demand", F.lit(0.25)),
        }
    )
    share, top, up = F.col("share"), F.col("top_share"), F.col("up_next")
    rows = rows.withColumns(
        {
            "zone": wt.zone(F.col("rank"), share, top, *wt.SESSION_ZONES),
            "stability": F.when(up > 0, F.least(F.lit(1.0), up / F.greatest(F.lit(0.001), share))).otherwise(0.0),
        }
    )
    opportunity = (
        0.58 * share / top + 0.20 * F.col("demand") + 0.14 * F.col("stability")
        + 0.08 * F.when(F.col("cross_surface"), 1.0).otherwise(0.35)
    )
    return rows.withColumn("opportunity", wt.clamp(opportunity))


def weighted_demand(rows: DataFrame, session: list[str], key: str = "key") -> DataFrame:
    """Mean demand per key, weighted by contribution; 0 and null count as .25."""
    w = F.col("weight")
    return rows.filter(w > 0).groupBy(*session, key).agg(
        (F.sum(w * wt.or_default(F.col("demand"), 0.25)) / F.sum(w)).alias("demand")
    )


# ------------------------------------------------------------------ stable items
def stable_items(rows: DataFrame, session: list[str], seed: str = "seed", replay: str = "replay", item: str = "item") -> DataFrame:
    """Appearance rate and mean position of every item of a seed.

    An item counts once per replay, at its first place. The rate is rounded
    before it is compared, so 2 of 3 replays are not stable. Rows without session
    or seed belong to no list. The first item of a replay counts it, blank or not,
    so the rows are read once; rows that lie together by session and seed need no
    further shuffle.
    """
    lists = [*session, seed]
    known = rows
    for c in lists:
        known = known.filter(F.col(c).isNotNull())
    once = known.groupBy(*lists, replay, item).agg(F.min("position").alias("position"))
    first = F.row_number().over(W.partitionBy(*lists, replay).orderBy(item)) == 1
    per_item = once.withColumn("_first", first).groupBy(*lists, item).agg(
        F.count("*").alias("appearances"), F.avg("position").alias("mean_position"), F.count_if("_first").alias("_replays")
    )
    counted = per_item.withColumn("replay_count", F.sum("_replays").over(W.partitionBy(*lists))).drop("_replays")
    out = counted.filter(F.coalesce(F.col(item).cast("string"), F.lit("")) != "")
    rate = wt.round_even(F.col("appearances") / F.col("replay_count"), 4)
    return out.withColumns(
        {
            "appearance_rate": rate,
            "mean_position": wt.round_even(F.col("mean_position"), 2),
            "stable": rate >= 0.67,
        }
    )


def top_stable(items: DataFrame, session: list[str], seed: str = "seed", item: str = "item", k: int = 40) -> DataFrame:
    order = [F.desc("appearance_rate"), F.asc("mean_position"), F.asc(seed), F.asc(item)]
    return wt.top_k(items, session, order, k)


def surface_counts(rows: DataFrame, session: list[str]) -> DataFrame:
    """Home items, up-next items, seeds and replays per session.

    ``rows``: session, surface, seed, replay, one per card. Counted over
    (surface, seed, replay) groups, so no distinct is needed.
    """
    up = F.col("surface") == "up_next"
    per_list = rows.groupBy(*session, "surface", "seed", "replay").agg(F.count("*").alias("n"))
    per_seed = per_list.groupBy(*session, "surface", "seed").agg(F.sum("n").alias("n"), F.count("*").alias("lists"))
    return per_seed.groupBy(*session).agg(
        F.sum(F.when(~up, F.col("n")).otherwise(0)).alias("home_items"),
        F.sum(F.when(up, F.col("n")).otherwise(0)).alias("up_next_items"),
        F.count_if(up).alias("seeds"),
        F.sum(F.when(up, F.col("lists")).otherwise(0)).alias("replays"),
    )


def certainty(counts: DataFrame, items: DataFrame, session: list[str]) -> DataFrame:
    """Certainty of a session from its sample, surfaces, replays and stability."""
    stable = items.groupBy(*session).agg(
        F.count_if("stable").alias("stable_count"), (F.count_if("stable") / F.count("*")).alias("stable_ratio")
    )
    rows = counts.join(stable, session, "left").withColumns(
        {"stable_ratio": F.coalesce("stable_ratio", F.lit(0.0)), "stable_count": F.coalesce("stable_count", F.lit(0))}
    )
    sample = F.least(F.lit(1.0), (F.col("home_items") + F.least(F.col("up_next_items"), F.lit(120))) / 100.0)
    surface = F.when((F.col("home_items") > 0) & (F.col("seeds") > 0), 1.0).otherwise(0.65)
    replay = F.when(
        F.col("seeds") > 0, F.least(F.lit(1.0), F.col("replays") / F.greatest(F.lit(1), F.col("seeds") * 3))
    ).otherwise(0.0)
    return rows.withColumn(
        "certainty",
        F.least(F.lit(0.82), 0.20 + 0.25 * sample + 0.20 * surface + 0.18 * replay + 0.17 * F.col("stable_ratio")),
    )


# ------------------------------------------------------------- names and packaging
def behavior_name(category: Column, intent_id: Column, diversity: Column, top_share: Column) -> Column:
    label = wt.lookup(intent_id, fixed.INTENT_LABEL, fixed.OTHER_INTENT_LABEL)
    return lg.candidate_name(category, label, top_share, diversity)


def lane_plan(interests: DataFrame, session: list[str]) -> DataFrame:
    """Anchor, bridge (on both surfaces) and expansion (exploration zone)."""
    return lg.lane_plan(interests, session, bridge=F.col("cross_surface"), expansion=F.col("zone") == "exploration")


def packaging(lanes: DataFrame) -> DataFrame:
    """Title, description and tag terms of a lane from its ``keywords`` and
    ``tags`` arrays (best first, capped by the term tables)."""
    rows = hold(lanes.withColumns({"_kk": text.term_keys(F.col("keywords")), "_tk": text.term_keys(F.col("tags"))}), "_kk", "_tk")
    rows = rows.withColumns(
        {
            "keywords": F.slice(text.first_per_key(F.col("keywords"), F.col("_kk")), 1, 10),
            "_kk": F.slice(F.filter(F.array_distinct("_kk"), lambda k: k != ""), 1, 10),
            "tags": F.slice(text.first_per_key(F.col("tags"), F.col("_tk")), 1, 12),
            "_tk": F.slice(F.filter(F.array_distinct("_tk"), lambda k: k != ""), 1, 12),
        }
    )
    primary = F.coalesce(F.get("keywords", F.lit(0)), F.col("direction"))
    rows = rows.withColumns({"primary_term": primary, "supporting_terms": F.slice("keywords", 2, 5)})
    unseen = F.filter("keywords", lambda _, i: ~F.array_contains("_tk", F.get("_kk", i)))
    return rows.withColumns(
        {
            "title_terms": F.concat(F.array("primary_term"), F.slice("supporting_terms", 1, 2)),
            "description_terms": F.concat(F.array("primary_term"), F.slice("supporting_terms", 1, 5)),
            "context_terms": F.slice("supporting_terms", 2, 4),
            "observed_tags": F.slice("tags", 1, 10),
            "semantic_tags": F.slice(unseen, 1, 6),
        }
    ).drop("_kk", "_tk")


def title_suggestions(lanes: DataFrame) -> DataFrame:
    """Adds ``titles``: up to three filled patterns of the lane's intent.

    ``lanes`` has direction, intent_id and keywords. The pattern table is a
    fixed literal, so no join is needed.
    """
    patterns = F.array(*[F.lit(p) for p in fixed.TITLE_PATTERNS[""]])
    for intent, rows in fixed.TITLE_PATTERNS.items():
        if intent:
            patterns = F.when(F.col("intent_id") == intent, F.array(*[F.lit(p) for p in rows])).otherwise(patterns)
    primary = F.coalesce(F.get("keywords", F.lit(0)), F.col("direction"))
    # held: what a lambda reads would be computed again for each element, folding included
    df = hold(lanes.withColumns({"_keys": text.term_keys(F.col("keywords")), "_patterns": patterns, "_primary": primary}), "_keys", "_patterns", "_primary")
    df = hold(df.withColumn("_first_key", F.get("_keys", F.lit(0))), "_first_key")
    others = F.filter("keywords", lambda _, i: F.get("_keys", i) != F.col("_first_key"))
    df = hold(df.withColumn("_secondary", F.coalesce(F.get(others, F.lit(0)), F.col("direction"))), "_secondary")

    def filled(pattern: Column) -> Column:
        # the pattern is cut at its markers, so filled text is never read again
        parts = F.transform(
            F.split(pattern, r"\{primary\}"), lambda p: F.array_join(F.split(p, r"\{secondary\}"), "\x00")
        )
        whole = F.replace(F.array_join(parts, "\x01"), F.lit("\x00"), F.col("_secondary"))
        whole = F.replace(whole, F.lit("\x01"), F.col("_primary"))
        return F.btrim(F.regexp_replace(whole, r"\s+", " "), F.lit(" -–—:|"))

    df = hold(df.withColumn("_titles", F.transform("_patterns", filled)), "_titles")
    df = hold(df.withColumn("_title_keys", text.term_keys(F.col("_titles"))), "_title_keys")
    return df.withColumn(
        "titles", F.slice(text.first_per_key(F.col("_titles"), F.col("_title_keys")), 1, 3)
    ).drop("_keys", "_patterns", "_primary", "_first_key", "_secondary", "_titles", "_title_keys")


def sample_seeds(items: DataFrame, session: list[str], item: str, n: int, seed: int = 0) -> DataFrame:
    """n items per session without replacement; the same seed picks the same items."""
    order = F.xxhash64(F.col(item), F.lit(seed))
    once = items.dropDuplicates([*session, item])
    return wt.top_k(once, session, [order, F.col(item)], n, "_n").drop("_n")
