"""Community report: every participant carries the same total weight.

Input is one row per profile with bounded arrays (36 interests, 16 intents, 50
keywords, 50 tags after sanitising). Lanes, terms and intents are expanded from
those arrays on the map side; no profile is ever joined with other profiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlane.functions import fixed, text
from driftlane.functions import weights as wt
from driftlane.functions.plan import hold

MATCH = 0.08
USABLE = 0.30


def quality(certainty: Column, observed_days: Column) -> Column:
    sure = wt.clamp(F.coalesce(certainty, F.lit(0.0)))
    days = F.greatest(F.lit(0), F.coalesce(observed_days, F.lit(0)))
    return F.greatest(F.lit(0.08), sure * (0.55 + 0.45 * F.least(F.lit(1.0), days / 7.0)))


def usable(profiles: DataFrame) -> DataFrame:
    return profiles.filter(
        (F.coalesce("certainty_score", F.lit(0.0)) >= USABLE)
        & (F.coalesce(F.size("interest_weights"), F.lit(0)) > 0)
    )


def balanced_weights(profiles: DataFrame) -> DataFrame:
    """Adds ``pweight``: 1/participants, split by quality within a participant.

    Participant totals are a partial + final aggregate joined back, so one
    participant may own any part of the profiles.
    """
    rows = profiles.withColumn("_q", quality(F.col("certainty_score"), F.col("daily_observation_count")))
    totals = rows.groupBy("participant_id").agg(F.sum("_q").alias("_q_total"))
    participants = totals.agg(F.count("*")).scalar()
    return rows.join(totals, "participant_id").withColumn(
        "pweight", F.col("_q") / F.col("_q_total") / participants
    ).drop("_q", "_q_total")


def _last_by_id(rows: Column) -> Column:
    """Rows with an id; of rows with the same id the last one."""
    trimmed = F.filter(rows, lambda r: F.trim(F.coalesce(r["id"], F.lit(""))) != "")
    ids = F.transform(trimmed, lambda r: F.trim(r["id"]))
    size = F.size(ids)
    last = F.filter(
        trimmed,
        lambda r, i: F.array_position(F.reverse(ids), F.trim(r["id"])) == (size - i).cast("bigint"),
    )
    # repeated ids are rare; without them no position has to be looked up
    return F.when(F.size(F.array_distinct(ids)) == size, trimmed).otherwise(last)


def interest_rows(weighted: DataFrame) -> DataFrame:
    """One row per profile and category: interest, trend, matched flag."""
    rows = weighted.select(
        "participant_id", "profile_key", "pweight",
        F.explode_outer(_last_by_id(F.col("interest_weights"))).alias("_i"),
    ).filter("_i is not null")
    interest = wt.clamp(F.coalesce("_i.predicted_weight", F.lit(0.0)))
    return rows.select(
        "participant_id", "profile_key", "pweight",
        F.trim("_i.id").alias("category_id"),
        F.coalesce("_i.name_vi", F.trim("_i.id")).alias("category_name"),
        interest.alias("interest"),
        F.coalesce(F.nullif("_i.trend_state", F.lit("")), F.lit("baseline")).alias("trend"),
        (interest >= MATCH).alias("matched"),
    )


def lanes(weighted: DataFrame) -> DataFrame:
    """One row per category with a matched profile.

    One scan feeds two groupings: by participant, which makes participants countable
    without a distinct, and by trend name, whatever names there are. The second level has as
    many groups as there are categories. Adds ``trend_counts``, a map without zeros, and
    ``n_<state>`` for the known states.
    """
    rows = interest_rows(weighted)
    w, hit = F.col("pweight"), F.col("matched")
    trend = F.col("trend")
    positive = trend.isin(*fixed.POSITIVE_TRENDS)
    negative = trend.isin(*fixed.NEGATIVE_TRENDS)

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, w).otherwise(0.0))

    sums = ["interest", "coverage", "positive", "negative", "steady"]
    first = rows.withColumns({"_participant": F.col("participant_id"), "_trend": trend}).groupingSets(
        [["category_id", "_participant"], ["category_id", "_trend"]], "category_id", "_participant", "_trend",
    ).agg(
        F.grouping("_trend").alias("_by_participant"), F.count_if(hit).alias("matched"),
        F.sum(w * F.col("interest")).alias("interest"), total(hit).alias("coverage"), total(hit & positive).alias("positive"),
        total(hit & negative).alias("negative"), total(hit & ~positive & ~negative).alias("steady"),
        F.min("category_name").alias("category_name"),
    )
    person = F.col("_by_participant") == 1
    named = F.when(~person & (F.col("matched") > 0), F.struct(F.col("_trend").alias("k"), F.col("matched").alias("v")))
    lane = first.groupBy("category_id").agg(
        F.min("category_name").alias("category_name"),
        F.sum(F.when(person, F.col("matched"))).alias("matched_profiles"),
        F.count_if(person & (F.col("matched") > 0)).alias("matched_participants"),
        *[F.sum(F.when(person, F.col(c))).alias({"interest": "weighted_interest", "coverage": "weighted_coverage"}.get(c, c)) for c in sums],
        F.map_from_entries(F.array_sort(F.collect_list(named))).alias("trend_counts"),
    ).filter("matched_profiles > 0")
    return lane.withColumns({
        f"n_{s}": F.coalesce(F.try_element_at("trend_counts", F.lit(s)), F.lit(0)) for s in fixed.COMMUNITY_TREND_VALUE})


def lane_scores(lane: DataFrame, weighted: DataFrame) -> DataFrame:
    """Coverage ratios, momentum, opportunity, band and rank of every lane."""
    people = counts(weighted)
    profiles_n = people.select("profiles").scalar()
    participants_n = people.select("participants").scalar()
    scored = lane.withColumns(
        {
            "profile_coverage": F.col("matched_profiles") / F.greatest(F.lit(1), profiles_n),
            "participant_coverage": F.col("matched_participants") / F.greatest(F.lit(1), participants_n),
            "momentum": wt.clamp(
                (F.col("positive") + 0.55 * F.col("steady") + 0.10 * F.col("negative"))
                / F.greatest(F.lit(1e-9), F.col("weighted_coverage"))
            ),
        }
    )
    scored = scored.withColumn(
        "opportunity",
        wt.clamp(
            0.42 * F.col("weighted_coverage") + 0.28 * F.col("participant_coverage")
            + 0.18 * F.least(F.lit(1.0), F.col("weighted_interest") / 0.25) + 0.12 * F.col("momentum")
        ),
    )
    band = (
        F.when((F.col("opportunity") >= 0.67) & (F.col("participant_coverage") >= 0.50), "strong")
        .when(F.col("opportunity") >= 0.45, "promising")
        .when(F.col("opportunity") >= 0.28, "experimental")
        .otherwise("weak")
    )
    order = [
        wt.round_even(F.col("opportunity"), 4).desc(), F.desc("matched_participants"),
        wt.round_even(F.col("weighted_coverage"), 4).desc(), F.asc("category_id"),
    ]
    # one row per category: the single-group rank sees the dictionary's size at most
    return wt.top_k(scored.withColumn("band", band).withColumn("_all", F.lit(0)), ["_all"], order, None).drop("_all")


def counts(profiles: DataFrame) -> DataFrame:
    """Participants and profiles, by two aggregation levels."""
    return (
        profiles.groupBy("participant_id").agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("profiles"), F.count("*").alias("participants"))
    )


def community_counts(profiles: DataFrame) -> DataFrame:
    """All and usable participants and profiles in one pass."""
    ok = (F.coalesce("certainty_score", F.lit(0.0)) >= USABLE) & (
        F.coalesce(F.size("interest_weights"), F.lit(0)) > 0
    )
    per = profiles.groupBy("participant_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"))
    return per.agg(
        F.count("*").alias("participant_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("profile_count"),
        F.count_if(F.col("ok") > 0).alias("usable_participant_count"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("usable_profile_count"),
    )


def _matched_lanes() -> Column:
    rows = F.filter(
        _last_by_id(F.col("interest_weights")),
        lambda r: wt.clamp(F.coalesce(r["predicted_weight"], F.lit(0.0))) >= MATCH,
    )
    return F.transform(rows, lambda r: F.trim(r["id"]))


def lane_term_rows(weighted: DataFrame, field: str) -> DataFrame:
    """Lane x term rows of every profile, from its own two arrays.

    Of rows with the same key in one profile only the first counts, and it is
    chosen before any filter.
    """
    base = weighted.filter(F.col("pweight") > 0).select(
        "participant_id", "profile_key", "pweight", _matched_lanes().alias("_lanes"),
        F.filter(F.col(field), lambda r: r["value"].isNotNull()).alias("_terms"),
    )
    base = hold(base, "_lanes", "_terms").filter(F.size("_lanes") > 0)
    base = hold(base.withColumn("_keys", text.term_keys(F.transform("_terms", lambda r: r["value"]))), "_keys")
    keyed = F.zip_with("_terms", "_keys", lambda r, k: F.struct(r.alias("row"), k.alias("key")))
    first = text.first_per_key(keyed, F.col("_keys"))
    rows = base.withColumn("_first", first).select(
        "participant_id", "profile_key", "pweight", "_lanes", F.explode_outer("_first").alias("_t")
    ).filter("_t is not null")
    trend = F.coalesce(F.nullif("_t.row.trend_state", F.lit("")), F.lit("baseline"))
    rows = rows.select(
        "participant_id", "profile_key", "pweight", "_lanes",
        F.col("_t.key").alias("key"), F.trim("_t.row.value").alias("value"), trend.alias("trend"),
        wt.clamp(F.coalesce("_t.row.weight", F.lit(0.0))).alias("weight"),
    ).filter("weight > 0")
    return rows.select("*", F.explode("_lanes").alias("category_id")).drop("_lanes")


def aggregate_terms(rows: DataFrame, limit: int | None = 12, positive_only: bool = False) -> DataFrame:
    """Terms per lane with score, trend strength and support; best ``limit``."""
    if positive_only:
        rows = rows.filter(F.col("trend").isin(*fixed.POSITIVE_TRENDS))
    strength = wt.lookup(F.col("trend"), fixed.COMMUNITY_TREND_VALUE, fixed.COMMUNITY_TREND_OTHER)
    per_person = rows.groupBy("category_id", "key", "participant_id").agg(
        F.sum(F.col("pweight") * F.col("weight")).alias("score"),
        F.sum(F.col("pweight") * strength).alias("trend_strength"),
        F.count("*").alias("profiles"),  # a profile has one row per lane and key
        F.max_by("value", F.struct("profile_key", "value")).alias("value"),
        F.max("profile_key").alias("_last"),
    )
    terms = per_person.groupBy("category_id", "key").agg(
        wt.round_even(F.sum("score"), 6).alias("score"),
        wt.round_even(F.sum("trend_strength"), 6).alias("trend_strength"),
        F.sum("profiles").alias("profiles"),
        F.count("*").alias("participants"),
        F.max_by("value", "_last").alias("value"),
    )
    order = [F.desc("participants"), F.desc("profiles"), F.desc("score"), F.desc("trend_strength"), F.asc("key")]
    return wt.top_k(terms, ["category_id"], order, limit)


def core_and_expansion(rows: DataFrame, limit: int = 12, keep: int = 8, leading: int = 6) -> DataFrame:
    """Core and expansion terms of every lane from one aggregation: ``set`` says which.

    Sums over all rows and over growing ones are taken side by side, so the terms are
    shuffled once; both orders are one window, cut to ``limit`` per lane and set before
    its shuffle. What is left of a lane, twice ``limit`` rows at most, settles the expansion.
    """
    strength = wt.lookup(F.col("trend"), fixed.COMMUNITY_TREND_VALUE, fixed.COMMUNITY_TREND_OTHER)
    sides = {"core": F.lit(True), "growing": F.col("trend").isin(*fixed.POSITIVE_TRENDS)}

    def over(side: str, value: Column) -> Column:
        return F.when(sides[side], value)

    per_person = rows.groupBy("category_id", "key", "participant_id").agg(*[
        F.struct(
            F.sum(over(s, F.col("pweight") * F.col("weight"))).alias("score"), F.sum(over(s, F.col("pweight") * strength)).alias("trend_strength"),
            F.count(over(s, F.lit(1))).alias("profiles"), F.max_by("value", over(s, F.struct("profile_key", "value"))).alias("value"),
            F.max(over(s, F.col("profile_key"))).alias("last"),
        ).alias(s) for s in sides])
    terms = per_person.groupBy("category_id", "key").agg(*[
        F.struct(
            F.lit(s).alias("set"), wt.round_even(F.sum(f"{s}.score"), 6).alias("score"), wt.round_even(F.sum(f"{s}.trend_strength"), 6).alias("trend_strength"),
            F.sum(f"{s}.profiles").alias("profiles"), F.count_if(F.col(f"{s}.profiles") > 0).alias("participants"),
            F.max_by(f"{s}.value", f"{s}.last").alias("value"),
        ).alias(s) for s in sides])
    both = terms.select("category_id", "key", F.explode(F.array("core", "growing")).alias("t")).select("category_id", "key", "t.*").filter("profiles > 0")
    order = [F.desc("participants"), F.desc("profiles"), F.desc("score"), F.desc("trend_strength"), F.asc("key")]
    ranked = wt.top_k(both, ["category_id", "set"], order, limit)
    lead = F.collect_set(F.when((F.col("set") == "core") & (F.col("rank") <= leading), F.col("key"))).over(W.partitionBy("category_id"))
    left = ranked.withColumn("_lead", lead).filter((F.col("set") == "core") | ~F.array_contains("_lead", F.col("key")))
    named = left.withColumn("set", F.when(F.col("set") == "core", "core").otherwise("expansion")).withColumnRenamed("rank", "_before").drop("_lead")
    return wt.top_k(named, ["category_id", "set"], [F.asc("_before")], None).drop("_before").filter(
        (F.col("set") == "core") | (F.col("rank") <= keep))


def expansion_terms(rows: DataFrame, core: DataFrame, keep: int = 8, leading: int = 6) -> DataFrame:
    """Growing terms of a lane that are not among its leading core terms.

    Cut to 12 before the subtraction, to ``keep`` after it.
    """
    rising = aggregate_terms(rows, 12, positive_only=True).withColumnRenamed("rank", "_before")
    lead = core.filter(F.col("rank") <= leading).select("category_id", "key")
    left = rising.join(lead, ["category_id", "key"], "left_anti")
    return wt.top_k(left, ["category_id"], [F.asc("_before")], keep).drop("_before")


def lane_intents(weighted: DataFrame) -> DataFrame:
    """Intent mix per lane with rank 1 for the top intent."""
    rows = weighted.select(
        "pweight", _matched_lanes().alias("_lanes"), "intent_weights"
    )
    rows = hold(rows, "_lanes").select("pweight", "_lanes", F.explode("intent_weights").alias("_i")).filter(F.trim(F.coalesce("_i.id", F.lit(""))) != "")
    rows = rows.select(
        F.explode("_lanes").alias("category_id"), F.trim("_i.id").alias("intent_id"),
        F.coalesce("_i.label", "_i.id").alias("label"),
        (F.col("pweight") * wt.clamp(F.coalesce("_i.weight", F.lit(0.0)))).alias("w"),
    )
    sums = rows.groupBy("category_id", "intent_id").agg(F.sum("w").alias("w"), F.max("label").alias("label"))
    mixed = wt.share_in_group(sums, ["category_id"], "w", "weight").withColumn(
        "weight", wt.round_even(F.col("weight"), 4)
    )
    return wt.top_k(mixed.drop("w"), ["category_id"], [F.desc("weight"), F.asc("intent_id")], None)


def with_segment(scored: DataFrame, intents: DataFrame) -> DataFrame:
    top = intents.filter(F.col("rank") == 1).select("category_id", F.col("intent_id").alias("top_intent"))
    return scored.join(top, "category_id", "left").withColumn(
        "segment_key", F.concat_ws("::", "category_id", "top_intent")
    )


def creator_summary(scored: DataFrame) -> DataFrame:
    """Anchor, bridge and expansion lane: one row, no ordering of the lanes."""
    growing = sum(F.col(f"n_{s}") for s in fixed.POSITIVE_TRENDS) > 0
    rank, lane = F.col("rank"), F.col("category_id")
    order = F.when((rank >= 3) & growing, rank).when(rank == 3, F.lit(1_000_000))
    return scored.agg(
        F.min_by(lane, F.when(rank == 1, rank)).alias("recommended_anchor"),
        F.min_by(lane, F.when(rank == 2, rank)).alias("recommended_bridge"),
        F.min_by(lane, order).alias("controlled_expansion"),
    )


def report(profiles: DataFrame) -> dict[str, DataFrame]:
    """All tables of the report from one profile table."""
    weighted = balanced_weights(usable(profiles))
    keyword_rows = lane_term_rows(weighted, "keyword_trends")
    keywords = core_and_expansion(keyword_rows)
    intents = lane_intents(weighted)
    scored = with_segment(lane_scores(lanes(weighted), weighted), intents)
    return {
        "community": community_counts(profiles),
        "lanes": scored,
        "core_keywords": keywords.filter("set = 'core'").drop("set"),
        "core_tags": aggregate_terms(lane_term_rows(weighted, "tag_trends")),
        "expansion_keywords": keywords.filter("set = 'expansion'").drop("set"),
        "intents": intents,
        "summary": creator_summary(scored),
    }
