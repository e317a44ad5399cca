"""Time series over daily observations: decayed windows, trends, names, lanes.

Input is the long daily table (profile, day, key, weight), one row per profile,
day and key. The evaluation day is a parameter: one day or a range of days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlane.functions import fixed
from driftlane.functions import weights as wt

WINDOW_NAMES = list(fixed.WINDOWS)


# ------------------------------------------------------------- daily vectors
def combine_surfaces(rows: DataFrame, group: list[str], key: str = "key") -> DataFrame:
    """Blend surface distributions with their priors, renormalised over the
    surfaces present. ``rows``: group, surface, key, weight (one per surface
    and key); keys per group are bounded by the dictionary.

    Result: group, key, weight (rounded to 6) and a surfaces map.
    """
    dist = wt.share_in_group(rows, [*group, "surface"], "weight", "share")
    prior = wt.lookup(F.col("surface"), fixed.SURFACE_PRIOR, 0.0)
    mixed = dist.groupBy(*group, key).agg(
        F.sum(prior * F.col("share")).alias("_mix"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("surface", wt.round_even(F.col("share"), 6))))
        ).alias("surfaces"),
    )
    # the sum of applied priors cancels here: every mix is divided by its group total
    return wt.share_in_group(mixed, group, "_mix", "_share").select(
        *group, key, wt.round_even(F.col("_share"), 6).alias("weight"), "surfaces"
    )


def applied_priors(rows: DataFrame, group: list[str]) -> DataFrame:
    """Prior of each surface present, renormalised within the group."""
    present = rows.filter(F.col("weight") > 0).select(*group, "surface").distinct()
    prior = wt.lookup(F.col("surface"), fixed.SURFACE_PRIOR, 0.0)
    total = F.sum(prior).over(W.partitionBy(*group))
    return present.select(*group, "surface", wt.round_even(prior / total, 6).alias("applied"))


def blend_terms(
    main: DataFrame, extra: DataFrame, group: list[str], extra_weight: float = 0.15
) -> DataFrame:
    """Term map of a day: main terms and extra terms, each normalised, mixed
    1-w : w and renormalised. Either side alone keeps the whole weight.

    Both inputs: group, key, value, score. Terms per group are unbounded, so
    totals are aggregated and joined rather than taken by window.
    """
    rows = (
        main.select(*group, "key", "value", "score", F.lit(False).alias("_extra"))
        .unionByName(extra.select(*group, "key", "value", "score", F.lit(True).alias("_extra")))
        .filter((F.col("key") != "") & (F.col("score") > 0))
    )
    side = F.col("_extra")
    totals = rows.groupBy(*group).agg(
        F.sum(F.when(~side, F.col("score"))).alias("_main_total"),
        F.sum(F.when(side, F.col("score"))).alias("_extra_total"),
    )
    mix = (
        F.coalesce((1.0 - extra_weight) * F.col("_main") / F.col("_main_total"), F.lit(0.0))
        + F.coalesce(extra_weight * F.col("_extra_sum") / F.col("_extra_total"), F.lit(0.0))
    ) / (
        F.when(F.col("_main_total").isNotNull(), 1.0 - extra_weight).otherwise(0.0)
        + F.when(F.col("_extra_total").isNotNull(), extra_weight).otherwise(0.0)
    )
    keyed = rows.groupBy(*group, "key").agg(
        F.sum(F.when(~side, F.col("score"))).alias("_main"),
        F.sum(F.when(side, F.col("score"))).alias("_extra_sum"),
        F.min_by("value", F.struct("_extra", "value")).alias("value"),
    )
    return keyed.join(totals, group).select(
        *group, "key", "value", wt.round_even(mix, 6).alias("weight")
    )


# ------------------------------------------------------------ decayed windows
def at_days(observations: DataFrame, as_of) -> DataFrame:
    """Adds ``as_of`` and ``age``; several evaluation days multiply the rows.

    ``as_of``: a day (date or Column), or a (first, last) pair for a backfill
    of every day between them. A row only reaches the days it can count for, by
    a map-side sequence rather than a join with a calendar.
    """
    if isinstance(as_of, tuple):
        first, last = (F.lit(d).cast("date") for d in as_of)
        start = F.greatest(F.col("day"), first)
        rows = observations.withColumn(
            "as_of", F.explode(F.when(start <= last, F.sequence(start, last)))
        )
    else:
        rows = observations.withColumn("as_of", F.lit(as_of).cast("date"))
    rows = rows.withColumn("age", F.datediff("as_of", "day"))
    return rows.filter("age >= 0")


def last_day(observations: DataFrame) -> Column:
    """Latest day of the table as a scalar subquery."""
    return observations.agg(F.max("day")).scalar()


def window_table(observations: DataFrame, as_of, extra: list[Column] = (), days: DataFrame | None = None) -> DataFrame:
    """All decayed windows and presence statistics of every profile and key.

    One scan feeds one aggregate with five filtered sums. The decay totals of a
    profile and its number of observed days come from a second aggregate over
    (profile, day) and are joined back, so a hot profile stays split by key.
    ``days`` (profile_id, day) lists all observations of the profiles, for tables
    that hold one field of them; history is then counted on it. A range of
    evaluation days goes through ``window_series``, unless it has ``extra`` columns.
    """
    if isinstance(as_of, tuple) and not extra:
        return window_series(observations, *as_of, days)
    rows = at_days(observations.filter(F.col("weight") > 0), as_of)
    age, weight = F.col("age"), F.col("weight")
    present = weight >= fixed.PRESENCE_THRESHOLD
    keyed = rows.groupBy("profile_id", "as_of", "key").agg(
        *[wt.decayed_sum(weight, age, w).alias(f"_{w}") for w in WINDOW_NAMES],
        F.min(F.when(present, F.col("day"))).alias("first_seen"),
        F.max(F.when(present, F.col("day"))).alias("last_seen"),
        F.max(F.when(present & (age > 0), F.col("day"))).alias("last_before"),
        F.count_if(present).alias("days_present"),
        *extra,
    )
    totals = (
        rows.groupBy("profile_id", "as_of", "day", "age")
        .agg(F.sum("weight").alias("weight"))
        .groupBy("profile_id", "as_of")
        .agg(
            *[wt.decayed_sum(weight, age, w).alias(f"_total_{w}") for w in WINDOW_NAMES],
            F.count_if(age > 0).alias("history_days"),
            F.count("*").alias("observed_days"),
        )
    )
    if days is not None:
        seen = at_days(days.select("profile_id", "day").distinct(), as_of).groupBy("profile_id", "as_of").agg(
            F.count_if(age > 0).alias("history_days"), F.count("*").alias("observed_days")
        )
        totals = totals.drop("history_days", "observed_days").join(seen, ["profile_id", "as_of"])
    out = keyed.join(totals, ["profile_id", "as_of"])
    names = [c for c in keyed.columns if not c.startswith("_")]
    return out.select(
        *names,
        *[
            F.when(F.col(f"_total_{w}") > 0, F.col(f"_{w}") / F.col(f"_total_{w}")).otherwise(0.0).alias(w)
            for w in WINDOW_NAMES
        ],
        "history_days", "observed_days",
    )


def day_number(day: str) -> Column:
    return F.datediff(day, F.lit("1970-01-01"))


def filled_days(rows: DataFrame, group: list[str], first: Column, last: Column, out: str = "as_of") -> DataFrame:
    """Adds ``out``: the row's own day, and the evaluation days up to the group's next row.

    Every evaluation day after a group's first row gets exactly one row, so the
    result is as long as the table that is asked for, however long the history.
    """
    order = W.partitionBy(*group).orderBy("day")
    until = F.least(F.date_sub(F.lead("day").over(order), 1), last)
    start = F.greatest(F.date_add("day", 1), first)
    gap = F.when(start <= until, F.sequence(start, until)).otherwise(F.array().cast("array<date>"))
    return rows.withColumn("_gap", gap).withColumn(out, F.explode(F.concat(F.array("day"), "_gap"))).drop("_gap")


def window_series(observations: DataFrame, first, last, days: DataFrame | None = None) -> DataFrame:
    """``window_table`` for every day from ``first`` to ``last``, without a copy of a row for each later day.

    All sums are taken on the stored rows, in range frames of their key: the unbounded
    one as a running sum of weight * 2**(day / h), counted from ``last`` so that it stays
    in range on any history, the bounded ones as the few rows that they can reach. A day
    between two rows of a key then only scales the one and re-weighs the other. Totals
    are windows over the keys of a profile and day, which the dictionary bounds; the day
    counts of a profile travel with its rows, unless ``days`` has them.
    """
    first, last = (F.lit(d).cast("date") for d in (first, last))
    rows = observations.filter((F.col("weight") > 0) & (F.col("day") <= last)).select("profile_id", "key", "day", "weight", day_number("day").alias("_n"))
    key = W.partitionBy("profile_id", "key").orderBy("_n")
    so_far, half = key.rangeBetween(W.unboundedPreceding, 0), fixed.WINDOWS["long"][1]
    reach = max(oldest for oldest, _, _ in fixed.WINDOWS.values() if oldest is not None)
    present = F.when(F.col("weight") >= fixed.PRESENCE_THRESHOLD, F.col("day"))
    stored = rows.select(
        "profile_id", "key", "day", "_n",
        F.collect_list(F.struct("_n", "weight")).over(key.rangeBetween(-reach, 0)).alias("_recent"),
        F.sum(F.col("weight") * F.pow(F.lit(2.0), (F.col("_n") - day_number(last)) / half)).over(so_far).alias("_running"),
        F.min(present).over(so_far).alias("first_seen"), F.max(present).over(so_far).alias("last_seen"),
        F.max(present).over(key.rangeBetween(W.unboundedPreceding, -1)).alias("_before"), F.count(present).over(so_far).alias("days_present"),
        F.dense_rank().over(W.partitionBy("profile_id").orderBy("day")).cast("bigint").alias("_days"),
    )
    filled = filled_days(stored, ["profile_id", "key"], first, last).filter(F.col("as_of") >= first).withColumn("_at", day_number("as_of"))

    def decayed(name: str) -> Column:
        oldest, half_life, _ = fixed.WINDOWS[name]
        if oldest is None:
            return F.col("_running") * F.pow(F.lit(2.0), (day_number(last) - F.col("_at")) / half_life)
        return F.aggregate("_recent", F.lit(0.0), lambda total, r: total + F.when(
            wt.in_window(F.col("_at") - r["_n"], name), r["weight"] * wt.decay(F.col("_at") - r["_n"], half_life)).otherwise(0.0))

    own = F.col("as_of") == F.col("day")
    keyed = filled.select(
        "profile_id", "as_of", "key", *[decayed(w).alias(f"_{w}") for w in WINDOW_NAMES], "first_seen", "last_seen",
        F.when(own, F.col("_before")).otherwise(F.col("last_seen")).alias("last_before"), "days_present", "_days", own.alias("_own"))
    whole = W.partitionBy("profile_id", "as_of")
    observed = F.max("_days").over(whole)  # the key whose row is the latest knows all days of the profile
    totals = keyed.withColumns({
        **{f"_total_{w}": F.sum(f"_{w}").over(whole) for w in WINDOW_NAMES},
        "observed_days": observed, "history_days": observed - F.max("_own").over(whole).cast("bigint"),
    })
    if days is not None:
        seen = days.filter(F.col("day") <= last).select("profile_id", "day").distinct()
        seen = seen.withColumn("observed_days", F.row_number().over(W.partitionBy("profile_id").orderBy("day")).cast("bigint"))
        seen = filled_days(seen, ["profile_id"], first, last).select(
            "profile_id", "as_of", (F.col("observed_days") - (F.col("as_of") == F.col("day")).cast("bigint")).alias("history_days"), "observed_days")
        totals = totals.drop("history_days", "observed_days").join(seen, ["profile_id", "as_of"])
    return totals.select(
        "profile_id", "as_of", "key", "first_seen", "last_seen", "last_before", "days_present",
        *[F.when(F.col(f"_total_{w}") > 0, F.col(f"_{w}") / F.col(f"_total_{w}")).otherwise(0.0).alias(w) for w in WINDOW_NAMES],
        "history_days", "observed_days",
    )


def composite(windows: DataFrame) -> DataFrame:
    """Adds ``_mix``: the fixed mix of the four windows, not renormalised."""
    mix = sum(F.lit(v) * F.col(k) for k, v in fixed.COMPOSITE_WEIGHT.items())
    return windows.withColumn("_mix", mix)


def composite_share(windows: DataFrame) -> DataFrame:
    """Composite weight and rank per profile; keys bounded by the dictionary."""
    mixed = composite(windows)
    whole = W.partitionBy("profile_id", "as_of")
    ranked = mixed.withColumn("weight", F.col("_mix") / F.sum("_mix").over(whole)).drop("_mix")
    order = whole.orderBy(F.round("weight", 9).desc(), F.col("key"))
    return ranked.withColumns(
        {"rank": F.row_number().over(order), "top_weight": F.max("weight").over(whole)}
    )


# ------------------------------------------------------------------- trends
def interest_trend() -> Column:
    """State of an interest from the columns of ``window_table``; first match wins."""
    today, prev, month = F.col("today"), F.col("prev7d"), F.col("w30d")
    gap = F.datediff("as_of", "last_before")
    return (
        F.when(F.col("history_days") == 0, "baseline")
        .when((today < 0.005) & (month >= 0.02), "dormant")
        .when((today >= 0.02) & (gap >= 7), "revived")
        .when(
            (today >= 0.03) & (F.col("days_present") <= 2) & (F.datediff("as_of", "first_seen") <= 2),
            "emerging",
        )
        .when((prev > 0) & (today >= prev + 0.02) & (today >= prev * 1.18), "rising")
        .when((prev >= 0.02) & (today + 0.02 <= prev) & (today <= prev * 0.82), "cooling")
        .otherwise("stable")
    )


def trend_confidence() -> Column:
    return F.least(
        F.lit(1.0),
        0.20 + 0.12 * F.least(F.lit(6), F.col("history_days"))
        + 0.08 * F.least(F.lit(4), F.col("days_present")),
    )


def interest_trends(observations: DataFrame, as_of, days: DataFrame | None = None) -> DataFrame:
    """Windows, composite weight, presence and trend state of every interest."""
    return composite_share(window_table(observations, as_of, days=days)).withColumns(
        {"trend_state": interest_trend(), "trend_confidence": trend_confidence()}
    )


def facts_as_of(history: DataFrame, as_of) -> DataFrame:
    """Name and demand of each interest as the newest session up to the evaluation day has them.

    ``history``: profile_id, key, day, name, demand, one row per session and interest that it has.
    A newest session without the interest says nothing about it, so older ones stand in. Several
    evaluation days, as (first, last), take no range join: a session's facts hold from its day
    to the day before the next one that has the interest.
    """
    facts = F.struct("name", "demand").alias("facts")
    several = isinstance(as_of, tuple)
    first, last = (F.lit(d).cast("date") for d in (as_of if several else (as_of, as_of)))
    per_day = history.filter(F.col("day") <= last).groupBy("profile_id", "key", "day").agg(F.max(facts).alias("facts"))
    if several:
        rows = filled_days(per_day, ["profile_id", "key"], first, last).filter(F.col("as_of") >= first)
    else:
        rows = per_day.groupBy("profile_id", "key").agg(F.max_by("facts", "day").alias("facts")).withColumn("as_of", last)
    return rows.select("profile_id", "as_of", "key", "facts.name", "facts.demand")


def interest_rows(trends: DataFrame, today: DataFrame, meta: DataFrame) -> DataFrame:
    """Final interest rows: zone, stability, cross-surface flag, opportunity.

    ``today``: profile_id, key, surfaces of the evaluation day. ``meta``:
    profile_id, key, name, demand of the current session, else the last one (see
    ``facts_as_of``); with a column ``as_of`` it holds them for each evaluation day.
    """
    surface = F.col("surfaces")
    home, up, subs = (F.coalesce(surface[s], F.lit(0.0)) for s in ("home", "up_next", "subscriptions"))
    on = ["profile_id", *(["as_of"] if "as_of" in meta.columns else []), "key"]
    joined = trends.join(today.select("profile_id", "key", "surfaces"), ["profile_id", "key"], "left").join(
        meta.select(*on, "name", "demand"), on, "left"
    )
    cross = F.coalesce(F.size(F.map_filter(surface, lambda _, v: v > 0)) >= 2, F.lit(False))
    own = F.when(F.col("today") > 0, F.col("today")).otherwise(
        # today's vector lacks the key: the composite weight stands in
        F.col("weight")
    )
    joined = joined.withColumns(
        {
            "zone": wt.zone(F.col("rank"), F.col("weight"), F.col("top_weight"), *wt.SESSION_ZONES),
            "home_weight": home, "up_next_weight": up, "subscription_weight": subs,
            "cross_surface": cross,
            "demand": wt.or_default(F.col("demand"), 0.25),
            "stability": F.least(F.lit(1.0), up / F.greatest(F.lit(0.001), own)),
            "momentum": wt.lookup(F.col("trend_state"), fixed.PROFILE_MOMENTUM, 0.55),
        }
    )
    opportunity = (
        0.48 * F.col("weight") / F.greatest(F.lit(0.001), F.col("top_weight"))
        + 0.18 * F.col("demand") + 0.10 * F.col("stability")
        + 0.08 * F.when(F.col("cross_surface"), 1.0).otherwise(0.35) + 0.16 * F.col("momentum")
    )
    return joined.withColumns(
        {"opportunity": wt.clamp(opportunity), "name": F.coalesce("name", "key")}
    ).drop("surfaces")


def term_state() -> Column:
    today, prev = F.col("today"), F.col("prev7d")
    return (
        F.when(F.col("observed_days") <= 1, "baseline")
        .when((today >= 0.01) & (prev == 0), "emerging")
        .when((prev > 0) & (today >= prev * 1.25) & (today >= prev + 0.005), "rising")
        .when((prev >= 0.005) & (today <= prev * 0.75), "cooling")
        .otherwise("stable")
    )


def term_trends(observations: DataFrame, as_of, limit: int, days: DataFrame | None = None) -> DataFrame:
    """Trend rows of terms: the ``limit`` heaviest per profile.

    ``observations`` may have a ``value`` column with the display form; the
    latest day's form is shown. Weight is not renormalised here.
    """
    value = F.col("value") if "value" in observations.columns else F.col("key")
    shown = F.max_by(value, F.struct("day", value)).alias("value")
    rows = composite(window_table(observations, as_of, [shown], days))
    rows = rows.withColumns({"weight": wt.round_even(F.col("_mix"), 4), "trend_state": term_state()}).drop("_mix")
    return wt.top_k(rows, ["profile_id", "as_of"], [F.desc("weight"), F.asc("key")], limit)


# ----------------------------------------------------------------- channels
def channel_history(channels: DataFrame, as_of, limit: int = 60) -> DataFrame:
    """Observed days of every subscribed channel; a missing channel is never
    read as unsubscribed.

    ``channels``: profile_id, day, key, name, url. Repeats within a day are
    merged first, so the second aggregate counts days without a distinct.
    """
    rows = at_days(channels.filter("key <> ''"), as_of)
    per_day = rows.groupBy("profile_id", "as_of", "key", "day").agg(
        F.max("url").alias("url"), F.min("name").alias("name")
    )
    stats = per_day.groupBy("profile_id", "as_of", "key").agg(
        F.min_by("name", "day").alias("name"),
        F.max_by("url", F.when(F.coalesce("url", F.lit("")) != "", F.col("day"))).alias("url"),
        F.count("*").alias("observed_days"),
        F.min("day").alias("first_seen"),
        F.max("day").alias("last_seen"),
        F.bool_or(F.col("day") == F.col("as_of")).alias("observed_today"),
    )
    order = [F.desc("observed_today"), F.desc("observed_days"), F.desc("name"), F.asc("key")]
    return wt.top_k(stats, ["profile_id", "as_of"], order, limit)


# -------------------------------------------------------------------- names
def stable_names(candidates: DataFrame, needed: int = 3) -> DataFrame:
    """Stable profile name per observation day.

    A new name replaces the old one after ``needed`` observations in a row.
    Closed form: the candidate of the latest day whose streak is long enough,
    else the first candidate. ``candidates``: profile_id, day, candidate (one
    row per profile and day, so a window holds at most one row per day).
    """
    days = W.partitionBy("profile_id").orderBy("day")
    change = F.coalesce(F.lag("candidate").over(days) != F.col("candidate"), F.lit(True)).cast("int")
    runs = candidates.withColumn("_change", change).withColumn("_run", F.sum("_change").over(days))
    run = W.partitionBy("profile_id", "_run").orderBy("day")
    rows = runs.withColumn("streak", F.row_number().over(run))
    so_far = days.rowsBetween(W.unboundedPreceding, 0)
    promoted = F.last(
        F.when(F.col("streak") >= needed, F.col("candidate")), ignorenulls=True
    ).over(so_far)
    rows = rows.withColumn("stable_name", F.coalesce(promoted, F.first("candidate").over(so_far)))
    before = F.lag("stable_name").over(days)
    status = (
        F.when(before.isNull(), "initialized")
        .when(before == F.col("candidate"), "stable")
        .when(F.col("streak") >= needed, "promoted_after_3_daily_observations")
        .otherwise("candidate_waiting_for_stability")
    )
    return rows.withColumns({"status": status, "_before": before}).drop("_change", "_run")


def previous_names(named: DataFrame, keep: int = 10) -> DataFrame:
    """Up to ``keep`` last distinct names a profile has given up, oldest first."""
    dropped = named.filter(F.col("_before").isNotNull() & (F.col("_before") != F.col("stable_name")))
    first = dropped.groupBy("profile_id", F.col("_before").alias("name")).agg(F.min("day").alias("day"))
    last = wt.top_k(first, ["profile_id"], [F.desc("day")], keep)
    return last.groupBy("profile_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("day", "name"))), lambda r: r["name"]).alias("previous_names")
    )


def next_stable_name(candidate: Column, streak: Column, previous: Column) -> Column:
    """One step of the rule, for a stored previous name."""
    return F.when(previous.isNull() | (previous == "") | (streak >= 3), candidate).otherwise(previous)


def candidate_name(category: Column, intent_label: Column, top_share: Column, diversity: Column) -> Column:
    label = F.coalesce(intent_label, F.lit(fixed.OTHER_INTENT_LABEL))
    return (
        F.when(top_share >= 0.34, F.concat_ws(" · ", category, label))
        .when(diversity >= 0.72, F.concat(F.lit("Multi-interest · "), label))
        .otherwise(F.concat(category, F.lit("-leaning · "), label))
    )


def profile_shape(interests: DataFrame) -> DataFrame:
    """Top interest, its share and the diversity per profile, on rounded weights."""
    w = wt.round_even(F.col("weight"), 4)
    share = F.when(w > 0, w)
    return interests.groupBy("profile_id", "as_of").agg(
        F.min_by(F.coalesce("name", "key") if "name" in interests.columns else F.col("key"), "rank").alias("top_name"),
        F.max(w).alias("top_share"),
        wt.entropy(share, F.count(share)).alias("diversity"),
        F.max("observed_days").alias("observed_days"),
    )


def certainty(session: Column, observed_days: Column, channels_seen: Column) -> Column:
    bonus = 0.08 * F.least(F.lit(1.0), F.greatest(F.lit(0), observed_days - 1) / 7.0)
    seen = F.when(channels_seen, 0.04).otherwise(0.0)
    return F.least(F.lit(0.86), F.coalesce(session, F.lit(0.0)) + bonus + seen)


# -------------------------------------------------------------------- lanes
def lane_plan(interests: DataFrame, group: list[str], bridge: Column, expansion: Column, active: Column | None = None) -> DataFrame:
    """Anchor, bridge and expansion key per group, from ranked interests.

    Rows with ``active`` false are skipped unless nothing is active. Bridge is
    the first matching row after the anchor, else the second; expansion the
    first matching row from the third on, else the third. Ranks among active
    rows need one window; keys per group are bounded by the dictionary.
    """
    whole = W.partitionBy(*group)
    act = F.lit(True) if active is None else active
    rows = interests.withColumn("_active", act)
    rows = rows.withColumn("_any", F.bool_or("_active").over(whole)).filter(
        F.col("_active") | ~F.col("_any")
    )
    place = F.row_number().over(whole.orderBy("rank"))
    rows = rows.withColumns({"_place": place, "_bridge": bridge, "_expand": expansion})

    def pick(cond: Column, start: int) -> Column:
        # matching rows sort before the fallback row at the start position
        order = F.when((F.col("_place") >= start) & cond, F.col("_place")).when(
            F.col("_place") == start, F.lit(1_000_000)
        )
        return F.min_by("key", order)

    lanes = rows.groupBy(*group).agg(
        pick(F.lit(False), 1).alias("anchor"),
        pick(F.coalesce("_bridge", F.lit(False)), 2).alias("bridge"),
        pick(F.coalesce("_expand", F.lit(False)), 3).alias("controlled_expansion"),
    )
    return lanes


def trend_lanes(interests: DataFrame) -> DataFrame:
    state = F.col("trend_state")
    return lane_plan(
        interests, ["profile_id", "as_of"],
        bridge=F.col("cross_surface") & state.isin(*fixed.BRIDGE_TRENDS),
        expansion=state.isin(*fixed.POSITIVE_TRENDS),
        active=state != "dormant",
    )
