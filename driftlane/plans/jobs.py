"""The pipeline as four jobs over tables.

Every job is a function from tables to tables for all profiles at once. Results
that several later steps read are staged; see ``staging.stage``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane.functions import fixed, identity
from driftlane.functions import weights as wt
from driftlane.operators import classify, ingest, session, subscriptions, terms
from driftlane.operators import longitudinal as lg
from driftlane.plans.staging import stage
from driftlane.sources import sinks
from driftlane.sources.readers import explode_cards
from driftlane.sources.rulebook import RuleBook

SESSION = ["profile_id", "session_id"]


# ------------------------------------------------------------------ 1. snapshots
def classified_items(
    snapshots: DataFrame, book: RuleBook, as_of: Column, metadata: DataFrame | None = None
) -> DataFrame:
    """Cards of valid snapshots, enriched where metadata exists, classified."""
    cards = explode_cards(snapshots)
    if metadata is not None:
        cards = ingest.enrich(cards, metadata)
    return classify.classify(cards, book, as_of)


# -------------------------------------------------------------------- 2. sessions
def _weighted_cards(items: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Cards of the selected surfaces with seed, replay and weight; up-next cards
    share the weight of their seed's replays."""
    chosen = session.select_surfaces(
        envelopes.select(*SESSION, "snapshot_id", "surface", "captured_at", "parent_video_id")
    )
    seed = F.coalesce(identity.blank_to_null(F.col("parent_video_id")), F.lit("unknown"))
    chosen = chosen.withColumn("seed", F.when(F.col("surface") == "up_next", seed).otherwise(""))
    replays = chosen.groupBy(*SESSION, "surface", "seed").agg(F.count("*").alias("replays"))
    lists = chosen.join(replays, [*SESSION, "surface", "seed"]).select("snapshot_id", "seed", "replays")
    cards = items.join(lists, "snapshot_id").withColumn("replay", F.col("snapshot_id"))
    conf = wt.confidence_weight(F.col("classification.confidence"))
    share = F.when(F.col("surface") == "up_next", F.col("replays")).otherwise(1)
    cards = session.item_categories(cards).withColumns(
        {
            "weight": wt.rank_weight(F.col("position")) * conf / share,
            "evidence": F.col("classification.evidence"),
            "demand": F.col("popularity_profile.demand_signal"),
            "intents": F.col("intent_profile.intents"),
        }
    )
    return cards.select(
        *SESSION, "surface", "seed", "replay", "video_id", "title", "channel", "description", "tags", "youtube_topics",
        "position", "weight", "categories", "evidence", "demand", "intents",
    )


def _blend(cards: DataFrame, vector: str, bonus: bool) -> tuple[DataFrame, DataFrame]:
    rows = cards.select(
        *SESSION, "surface", "seed", "weight", "demand", F.explode(vector).alias("_c")
    ).select(
        *SESSION, "surface", "seed", "demand", F.col("_c.id").alias("key"), F.col("_c.name").alias("name"),
        (F.col("weight") * F.col("_c.share")).alias("weight"),
    )
    home = wt.share_in_group(
        session.key_sums(rows.filter("surface = 'home'"), SESSION), SESSION, "weight", "share"
    ).drop("weight")
    up = session.seed_mean(rows.filter("surface = 'up_next'"), SESSION)
    return rows, session.blend_surfaces(home, up, SESSION, bonus=bonus)


def session_profiles(items: DataFrame, envelopes: DataFrame) -> dict[str, DataFrame]:
    """Session tables: interests, intents, terms, stable items, lanes, summary."""
    everything = stage(_weighted_cards(items, envelopes))
    cards = everything.filter("surface in ('home', 'up_next')")

    rows, blended = _blend(cards, "categories", bonus=True)
    names = rows.groupBy(*SESSION, "key").agg(F.max("name").alias("name"))
    interests = session.interest_rows(blended, session.weighted_demand(rows, SESSION), SESSION)
    interests = stage(interests.join(names, [*SESSION, "key"], "left"))
    _, intents = _blend(cards, "intents", bonus=False)
    top_intent = intents.groupBy(*SESSION).agg(F.min_by("key", F.struct(-F.round("share", 9), "key")).alias("top_intent"))

    rows_of_terms = stage(terms.card_terms(cards, SESSION, 0.35, 1.10, 1.15))
    per_category = [*SESSION, "category_id"]
    tag_rows = rows_of_terms.filter("source = 'creator_tag'")
    topic_rows = rows_of_terms.filter("source = 'youtube_topic'").withColumn("score", F.col("contribution") * 1.2)
    first = ["surface", "position"]
    category_keywords = terms.rank_session(terms.aggregate(rows_of_terms, per_category, first), per_category, 14)
    category_tags = terms.rank_session(terms.aggregate(tag_rows, per_category, first), per_category, 14, 0.55)
    keywords = terms.rank_session(terms.aggregate(rows_of_terms, SESSION, first), SESSION, 36, 0.45)
    tags = terms.rank_session(terms.aggregate(tag_rows, SESSION, first), SESSION, 30, 0.60)
    topics = terms.rank_session(terms.aggregate(topic_rows, SESSION, first), SESSION, 24)

    up = cards.filter("surface = 'up_next'").withColumnRenamed("video_id", "item")
    stable = session.stable_items(up, SESSION)
    counts = session.surface_counts(cards, SESSION)
    certainty = session.certainty(counts, stable, SESSION)
    shape = interests.groupBy(*SESSION).agg(
        F.min_by(F.coalesce("name", "key"), "rank").alias("top_name"),
        F.max("share").alias("top_share"),
        wt.entropy(F.col("share"), F.count("*")).alias("diversity"),
    )
    summary = certainty.join(shape, SESSION, "left").join(top_intent, SESSION, "left").withColumn(
        "behavior_profile_name",
        session.behavior_name(
            F.coalesce("top_name", F.lit("Insufficient signal")), F.col("top_intent"),
            F.coalesce("diversity", F.lit(0.0)), F.coalesce("top_share", F.lit(0.0)),
        ),
    )
    return {
        "cards": everything, "interests": interests, "intents": intents, "summary": summary,
        "category_keywords": category_keywords, "category_tags": category_tags,
        "keywords": keywords, "tags": tags, "topics": topics,
        "stable_items": session.top_stable(stable, SESSION), "lanes": session.lane_plan(interests, SESSION),
    }


def blueprints(lanes: DataFrame, interests: DataFrame, keywords: DataFrame, tags: DataFrame, top_intent: DataFrame, group: list[str]) -> DataFrame:
    """Packaging of every lane: terms for title, description and tags, titles.

    Term arrays are collected after the per-category cut (14 rows each).
    """
    def ranked(table: DataFrame, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("rank", "value")))
        return table.groupBy(*group, F.col("category_id").alias("key")).agg(
            F.transform(rows, lambda r: r["value"]).alias(name)
        )

    roles = ["anchor", "bridge", "controlled_expansion"]
    long = lanes.select(
        *group,
        F.explode(F.array(*[F.struct(F.lit(n + 1).alias("phase"), F.lit(r).alias("role"), F.col(r).alias("key")) for n, r in enumerate(roles)])).alias("_l"),
    ).select(*group, "_l.*").filter("key is not null")
    none = F.array().cast("array<string>")
    rows = (
        long.join(interests.select(*group, "key", F.coalesce("name", "key").alias("direction"), "opportunity"), [*group, "key"], "left")
        .join(ranked(keywords, "keywords"), [*group, "key"], "left")
        .join(ranked(tags, "tags"), [*group, "key"], "left")
        .join(top_intent.select(*group, F.col("top_intent").alias("intent_id")), group, "left")
        .withColumns({"keywords": F.coalesce("keywords", none), "tags": F.coalesce("tags", none)})
    )
    return session.title_suggestions(session.packaging(rows))


# ------------------------------------------------------------------------ 3. days
def daily_observations(tables: dict[str, DataFrame], envelopes: DataFrame) -> DataFrame:
    """Daily rows (interests, keywords, tags) of every session's day."""
    when = envelopes.groupBy(*SESSION).agg(F.max("captured_at").alias("recorded_at"))
    when = when.withColumn("day", identity.event_day(F.col("recorded_at"))).filter("day is not null")
    feed = tables["cards"].filter("surface = 'subscriptions'")

    spread = F.array(
        F.struct(F.lit("home").alias("surface"), wt.round_even(F.col("home"), 4).alias("weight")),
        F.struct(F.lit("up_next").alias("surface"), wt.round_even(F.col("up_next"), 4).alias("weight")),
    )
    own = tables["interests"].select(*SESSION, "key", F.explode(spread).alias("_s")).select(
        *SESSION, "_s.surface", "key", "_s.weight"
    )
    subs = subscriptions.category_distribution(feed, SESSION).select(
        *SESSION, F.lit("subscriptions").alias("surface"), "key", "weight"
    )
    mixed = lg.combine_surfaces(own.unionByName(subs).filter("weight > 0"), SESSION)
    interest = mixed.select(
        *SESSION, F.lit("interest").alias("field"), "key", F.col("key").alias("value"), "weight", "surfaces"
    )
    extra = stage(subscriptions.term_scores(feed, SESSION))

    def term_field(name: str, table: DataFrame) -> DataFrame:
        main = table.select(*SESSION, "key", "value", "score")
        side = extra.filter(F.col("field") == name).select(*SESSION, "key", "value", "score")
        return lg.blend_terms(main, side, SESSION).select(
            *SESSION, F.lit(name).alias("field"), "key", "value", "weight",
            F.lit(None).cast("map<string,double>").alias("surfaces"),
        )

    rows = interest.unionByName(term_field("keyword", tables["keywords"])).unionByName(term_field("tag", tables["tags"]))
    names = tables["summary"].select(*SESSION, F.col("behavior_profile_name").alias("candidate_name"))
    dated = rows.join(when, SESSION).join(names, SESSION, "left")
    # of several sessions of a profile's day the newest counts
    return sinks.latest_collection(dated).select(
        "profile_id", "day", "recorded_at", "candidate_name", "field", "key", "value", "weight", "surfaces"
    )


# ---------------------------------------------------------------- 4. longitudinal
def longitudinal(
    daily: DataFrame, as_of, meta: DataFrame, channels: DataFrame | None = None, previous: DataFrame | None = None, history: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Interest, term, name and lane tables on one evaluation day.

    ``meta``: profile_id, key, name, demand of the newest session. ``previous``: the
    same of the last profile, for interests the newest session lacks. ``history``, the
    facts of all sessions (profile_id, key, day, name, demand), takes the place of both.
    """
    facts = ["profile_id", "key", "name", "demand"]
    if history is not None:
        meta, previous = lg.facts_as_of(history, as_of), None
    if previous is not None:
        meta = meta.select(facts).unionByName(previous.select(facts).join(meta.select("profile_id", "key"), ["profile_id", "key"], "left_anti"))
    days = daily.select("profile_id", "day").distinct()
    interest = daily.filter("field = 'interest'")
    today = interest.filter(F.col("day") == F.lit(as_of).cast("date"))
    trends = lg.interest_trends(interest, as_of, days)
    rows = stage(lg.interest_rows(trends, today, meta))
    candidates = daily.filter("candidate_name is not null").groupBy("profile_id", "day").agg(
        F.max_by("candidate_name", "recorded_at").alias("candidate")
    )
    names = lg.stable_names(candidates)
    out = {
        "interests": rows,
        "keywords": lg.term_trends(daily.filter("field = 'keyword'"), as_of, 40, days),
        "tags": lg.term_trends(daily.filter("field = 'tag'"), as_of, 35, days),
        "names": names,
        "previous_names": lg.previous_names(names),
        "shape": lg.profile_shape(rows),
        "lanes": lg.trend_lanes(rows),
    }
    if channels is not None:
        out["channels"] = lg.channel_history(channels, as_of)
    return out


def submissions(
    tables: dict[str, DataFrame], identities: DataFrame, session_certainty: DataFrame, intents: DataFrame,
    platform: str = "browser", agent_version: str | None = None,
) -> DataFrame:
    """Profile rows in the shape the sanitiser takes.

    ``identities``: profile_id, participant_id, device_id. ``session_certainty``:
    profile_id, certainty. ``intents``: profile_id, key, share. Arrays are
    collected from tables already cut per profile.
    """
    def packed(rows: DataFrame, order: str, struct: Column, name: str) -> DataFrame:
        return rows.groupBy("profile_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct(order, struct.alias("_v")))), lambda r: r["_v"]).alias(name)
        )

    interest = F.struct(
        F.col("key").alias("id"), F.col("name").alias("name_vi"), F.col("weight").alias("predicted_weight"),
        F.col("today").alias("today_weight"), F.col("w7d").alias("weight_7d"), F.col("w30d").alias("weight_30d"),
        F.col("long").alias("long_term_weight"), "trend_state", "home_weight", "up_next_weight", "subscription_weight",
    )
    term = F.struct(
        "value", "weight", F.col("today").alias("today_weight"), F.col("w7d").alias("weight_7d"),
        F.col("w30d").alias("weight_30d"), F.col("long").alias("long_term_weight"), "trend_state",
    )
    label = wt.lookup(F.col("key"), fixed.INTENT_LABEL, None)
    intent = F.struct(F.col("key").alias("id"), F.coalesce(label, "key").alias("label"), F.col("share").alias("weight"))
    shape = tables["shape"]
    seen = tables["channels"].select("profile_id").distinct().withColumn("_seen", F.lit(True)) if "channels" in tables else None
    base = shape.join(session_certainty, "profile_id", "left")
    base = base.join(seen, "profile_id", "left") if seen is not None else base.withColumn("_seen", F.lit(False))
    newest = tables["names"].groupBy("profile_id").agg(F.max_by("stable_name", "day").alias("behavior_profile_name"))
    return (
        base.join(identities, "profile_id")
        .join(newest, "profile_id", "left")
        .join(packed(tables["interests"], "rank", interest, "interest_weights"), "profile_id", "left")
        .join(packed(intents.withColumn("_o", -F.col("share")), "_o", intent, "intent_weights"), "profile_id", "left")
        .join(packed(tables["keywords"], "rank", term, "keyword_trends"), "profile_id", "left")
        .join(packed(tables["tags"], "rank", term, "tag_trends"), "profile_id", "left")
        .select(
            "participant_id", "device_id", "profile_id", "behavior_profile_name",
            F.lit("2.5.0").alias("analysis_version"), F.col("as_of").cast("string").alias("updated_at"),
            lg.certainty(F.col("certainty"), F.col("observed_days"), F.coalesce("_seen", F.lit(False))).alias("certainty_score"),
            F.col("observed_days").cast("int").alias("daily_observation_count"),
            F.lit(platform).alias("platform"), F.lit(agent_version).cast("string").alias("agent_version"),
            "interest_weights", "intent_weights", "keyword_trends", "tag_trends",
        )
    )
