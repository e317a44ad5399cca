"""Community report over profiles derived from ``events``.

Profile = user, participant = user % 40, certainty = (user % 10) / 10, interests
= share of value per k % 18, keywords = share per event type and k % 50.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlane.bindings import bound
from driftlane.bindings.events import DAILY, daily, events
from driftlane.bindings.longitudinal import WINDOW_SQL
from driftlane.functions import weights as wt
from driftlane.operators import community as cm
from driftlane.operators import longitudinal as lg


def profiles(spark, sf_dir):
    """One row per profile with interest, intent and keyword arrays.

    Arrays are collected per profile from rows that are already aggregated and
    cut to the caps of a submission.
    """
    obs = daily(spark, sf_dir)
    trends = lg.interest_trends(obs, lg.last_day(events(spark, sf_dir)))
    interests = trends.groupBy("profile_id").agg(
        F.collect_list(
            F.struct(
                F.col("key").cast("string").alias("id"), F.lit(None).cast("string").alias("name_vi"),
                F.col("weight").alias("predicted_weight"), F.col("trend_state"),
            )
        ).alias("interest_weights"),
        F.max("observed_days").alias("days"),
    )
    ev = events(spark, sf_dir)
    intents = wt.share_in_group(
        ev.groupBy(F.col("user_id").alias("profile_id"), F.col("event_type").alias("id")).agg(F.sum("value").alias("v")),
        ["profile_id"], "v", "weight",
    ).groupBy("profile_id").agg(
        F.collect_list(F.struct("id", F.col("id").alias("label"), F.round("weight", 6).alias("weight"))).alias("intent_weights")
    )
    terms = wt.share_in_group(
        ev.groupBy(F.col("user_id").alias("profile_id"), F.concat_ws(" ", "event_type", F.col("k") % 50).alias("value"))
        .agg(F.sum("value").alias("v"), F.count("*").alias("n")),
        ["profile_id"], "v", "weight",
    )
    state = F.when(F.col("n") >= 3, "rising").when(F.col("n") == 2, "emerging").otherwise("stable")
    kept = wt.top_k(terms, ["profile_id"], [F.round("weight", 9).desc(), F.asc("value")], 50)
    keywords = kept.groupBy("profile_id").agg(
        F.collect_list(F.struct("value", F.round("weight", 6).alias("weight"), state.alias("trend_state"))).alias("keyword_trends")
    )
    pid = F.col("profile_id")
    return (
        interests.join(intents, "profile_id").join(keywords, "profile_id")
        .select(
            (pid % 40).alias("participant_id"), pid.alias("profile_key"),
            ((pid % 10) / 10).alias("certainty_score"), F.col("days").cast("int").alias("daily_observation_count"),
            "interest_weights", "intent_weights", "keyword_trends",
        )
    )


PROFILES = f"""
{DAILY}, {WINDOW_SQL},
prof2 AS (SELECT profile_id AS profile_key, profile_id % 40 AS participant_id, (profile_id % 10) / 10.0 AS certainty,
                 max(observed_days) AS days FROM trend GROUP BY ALL),
q AS (SELECT *, greatest(0.08, certainty * (0.55 + 0.45 * least(1.0, days / 7.0))) AS q FROM prof2 WHERE certainty >= 0.3),
weighted AS (SELECT *, q / sum(q) OVER (PARTITION BY participant_id) / (SELECT count(DISTINCT participant_id) FROM q) AS pweight FROM q),
interest AS (SELECT w.*, CAST(t.key AS VARCHAR) AS category_id, least(1.0, greatest(0.0, t.weight)) AS interest, trend_state AS trend
             FROM weighted w JOIN trend t ON t.profile_id = w.profile_key),
lane AS (
  SELECT category_id, count(*) FILTER (interest >= 0.08) AS matched_profiles,
    count(DISTINCT participant_id) FILTER (interest >= 0.08) AS matched_participants,
    sum(pweight * interest) AS wi, coalesce(sum(pweight) FILTER (interest >= 0.08), 0) AS wc,
    coalesce(sum(pweight) FILTER (interest >= 0.08 AND trend IN ('rising','emerging','revived')), 0) AS pos,
    coalesce(sum(pweight) FILTER (interest >= 0.08 AND trend IN ('cooling','dormant')), 0) AS neg,
    coalesce(sum(pweight) FILTER (interest >= 0.08 AND trend NOT IN ('rising','emerging','revived','cooling','dormant')), 0) AS steady,
    count(*) FILTER (interest >= 0.08 AND trend IN ('rising','emerging','revived')) AS n_pos,
    count(*) FILTER (interest >= 0.08 AND trend = 'dormant') AS n_dormant
  FROM interest GROUP BY ALL HAVING count(*) FILTER (interest >= 0.08) > 0),
tot AS (SELECT count(*) AS n, count(DISTINCT participant_id) AS p FROM weighted),
sc0 AS (SELECT lane.*, matched_profiles / greatest(1, n) AS profile_coverage, matched_participants / greatest(1, p) AS participant_coverage,
          least(1.0, greatest(0.0, (pos + 0.55 * steady + 0.10 * neg) / greatest(1e-9, wc))) AS momentum FROM lane, tot),
sc1 AS (SELECT *, least(1.0, greatest(0.0, 0.42 * wc + 0.28 * participant_coverage + 0.18 * least(1.0, wi / 0.25) + 0.12 * momentum)) AS opportunity FROM sc0),
scored AS (SELECT *, CASE WHEN opportunity >= 0.67 AND participant_coverage >= 0.50 THEN 'strong' WHEN opportunity >= 0.45 THEN 'promising'
                          WHEN opportunity >= 0.28 THEN 'experimental' ELSE 'weak' END AS band,
             row_number() OVER (ORDER BY round_even(CAST(opportunity AS DOUBLE), 4) DESC, matched_participants DESC,
                                round_even(CAST(wc AS DOUBLE), 4) DESC, category_id) AS rank FROM sc1),
terms0 AS (SELECT user_id AS profile_key, concat(event_type, ' ', k % 50) AS key, sum(value) AS v, count(*) AS n FROM ev GROUP BY ALL),
terms1 AS (SELECT *, v / sum(v) OVER (PARTITION BY profile_key) AS w FROM terms0 WHERE v > 0),
terms2 AS (SELECT profile_key, key, round(w, 6) AS weight, CASE WHEN n >= 3 THEN 'rising' WHEN n = 2 THEN 'emerging' ELSE 'stable' END AS trend
           FROM terms1 QUALIFY row_number() OVER (PARTITION BY profile_key ORDER BY round(w, 9) DESC, key) <= 50),
lt AS (SELECT i.category_id, t.key, i.participant_id, i.profile_key, i.pweight, t.weight, t.trend
       FROM interest i JOIN terms2 t USING (profile_key) WHERE i.interest >= 0.08 AND t.weight > 0),
core0 AS (SELECT category_id, key, round_even(CAST(sum(pweight * weight) AS DOUBLE), 6) AS score, count(DISTINCT profile_key) AS profiles,
            count(DISTINCT participant_id) AS participants,
            round_even(CAST(sum(pweight * CASE trend WHEN 'rising' THEN 1.0 WHEN 'emerging' THEN 0.85 ELSE 0.55 END) AS DOUBLE), 6) AS trend_strength
          FROM lt GROUP BY ALL),
core AS (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY participants DESC, profiles DESC, score DESC, trend_strength DESC, key) AS rank
         FROM core0 QUALIFY rank <= 12),
up0 AS (SELECT category_id, key, round_even(CAST(sum(pweight * weight) AS DOUBLE), 6) AS score, count(DISTINCT profile_key) AS profiles,
            count(DISTINCT participant_id) AS participants,
            round_even(CAST(sum(pweight * CASE trend WHEN 'rising' THEN 1.0 ELSE 0.85 END) AS DOUBLE), 6) AS trend_strength
        FROM lt WHERE trend IN ('rising', 'emerging') GROUP BY ALL),
up AS (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY participants DESC, profiles DESC, score DESC, trend_strength DESC, key) AS r0
       FROM up0 QUALIFY r0 <= 12),
expansion AS (SELECT u.* FROM up u ANTI JOIN (SELECT * FROM core WHERE rank <= 6) c ON u.category_id = c.category_id AND u.key = c.key),
iw AS (SELECT user_id AS profile_key, event_type AS intent_id, sum(value) AS v FROM ev GROUP BY ALL),
iw2 AS (SELECT profile_key, intent_id, round(v / sum(v) OVER (PARTITION BY profile_key), 6) AS w FROM iw),
li AS (SELECT category_id, intent_id, sum(pweight * w) AS w FROM interest JOIN iw2 USING (profile_key) WHERE interest >= 0.08 GROUP BY ALL),
lane_intent AS (SELECT category_id, intent_id, round_even(CAST(w / sum(w) OVER (PARTITION BY category_id) AS DOUBLE), 4) AS weight FROM li),
lane_intent2 AS (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY weight DESC, intent_id) AS rank FROM lane_intent)
"""


def weighted(spark, sf_dir):
    """Usable profiles with their weight; the profile table is staged, as the
    report reads it several times."""
    return cm.balanced_weights(cm.usable(profiles(spark, sf_dir)))


def _long(name):
    return F.col(name).cast("bigint").alias(name)


def _r(name, digits=6):
    return F.round(name, digits).alias(name)


@bound("balanced_weights", f"""
WITH {PROFILES} SELECT profile_key, participant_id, round(pweight, 8) AS pweight FROM weighted
""")
def balanced_weights(spark, sf_dir):
    return weighted(spark, sf_dir).select("profile_key", "participant_id", _r("pweight", 8))


@bound("participant_totals", f"""
WITH {PROFILES} SELECT participant_id, round(sum(pweight), 8) AS total FROM weighted GROUP BY ALL
""")
def participant_totals(spark, sf_dir):
    return weighted(spark, sf_dir).groupBy("participant_id").agg(F.round(F.sum("pweight"), 8).alias("total"))


@bound("lanes", f"""
WITH {PROFILES}
SELECT category_id, matched_profiles, matched_participants, round(profile_coverage, 6) AS profile_coverage,
  round(participant_coverage, 6) AS participant_coverage, round(wc, 6) AS weighted_coverage, round(wi, 6) AS weighted_interest,
  round(momentum, 6) AS momentum, round(opportunity, 6) AS opportunity, band, rank, n_dormant FROM scored
""")
def lanes(spark, sf_dir):
    w = weighted(spark, sf_dir)
    return cm.lane_scores(cm.lanes(w), w).select(
        "category_id", "matched_profiles", "matched_participants", _r("profile_coverage"), _r("participant_coverage"),
        _r("weighted_coverage"), _r("weighted_interest"), _r("momentum"), _r("opportunity"), "band", _long("rank"), "n_dormant",
    )


@bound("lane_terms", f"""
WITH {PROFILES} SELECT category_id, key, score, profiles, participants, trend_strength, rank FROM core
""")
def lane_terms(spark, sf_dir):
    rows = cm.lane_term_rows(weighted(spark, sf_dir), "keyword_trends")
    return cm.aggregate_terms(rows).select(
        "category_id", "key", "score", "profiles", "participants", "trend_strength", _long("rank")
    )


@bound("expansion_terms", f"""
WITH {PROFILES}
SELECT category_id, key, score, row_number() OVER (PARTITION BY category_id ORDER BY r0) AS rank
FROM expansion QUALIFY rank <= 8
""")
def expansion_terms(spark, sf_dir):
    rows = cm.lane_term_rows(weighted(spark, sf_dir), "keyword_trends")
    return cm.core_and_expansion(rows).filter("set = 'expansion'").select("category_id", "key", "score", _long("rank"))


@bound("lane_trends", f"""
WITH {PROFILES}
SELECT category_id, CASE WHEN trend = 'stable' AND profile_key % 3 = 0 THEN 'plateau' ELSE trend END AS trend, count(*) AS profiles
FROM interest WHERE interest >= 0.08 GROUP BY ALL
""")
def lane_trends(spark, sf_dir):
    """Trend histogram of every lane; one trend name is none of the known ones."""
    def renamed(r):
        return F.when((r["trend_state"] == "stable") & (F.col("profile_key") % 3 == 0), r.withField("trend_state", F.lit("plateau"))).otherwise(r)

    w = weighted(spark, sf_dir).withColumn("interest_weights", F.transform("interest_weights", renamed))
    return cm.lanes(w).select("category_id", F.explode("trend_counts").alias("trend", "profiles"))


@bound("lane_intents", f"""
WITH {PROFILES} SELECT category_id, intent_id, weight, rank FROM lane_intent2
""")
def lane_intents(spark, sf_dir):
    return cm.lane_intents(weighted(spark, sf_dir)).select("category_id", "intent_id", "weight", _long("rank"))


@bound("lane_segments", f"""
WITH {PROFILES}
SELECT category_id, CASE WHEN intent_id IS NULL THEN category_id ELSE concat(category_id, '::', intent_id) END AS segment_key
FROM scored LEFT JOIN (SELECT * FROM lane_intent2 WHERE rank = 1) USING (category_id)
""")
def lane_segments(spark, sf_dir):
    w = weighted(spark, sf_dir)
    return cm.with_segment(cm.lanes(w), cm.lane_intents(w)).select("category_id", "segment_key")


@bound("creator_summary", f"""
WITH {PROFILES}
SELECT min(category_id) FILTER (rank = 1) AS recommended_anchor, min(category_id) FILTER (rank = 2) AS recommended_bridge,
  coalesce(arg_min(category_id, rank) FILTER (rank >= 3 AND n_pos > 0), min(category_id) FILTER (rank = 3)) AS controlled_expansion
FROM scored
""")
def creator_summary(spark, sf_dir):
    w = weighted(spark, sf_dir)
    return cm.creator_summary(cm.lane_scores(cm.lanes(w), w))


@bound("community_counts", f"""
WITH {PROFILES}
SELECT count(DISTINCT participant_id) AS participant_count, count(*) AS profile_count,
  count(DISTINCT participant_id) FILTER (certainty >= 0.3) AS usable_participant_count,
  count(*) FILTER (certainty >= 0.3) AS usable_profile_count FROM prof2
""")
def community_counts(spark, sf_dir):
    return cm.community_counts(profiles(spark, sf_dir))
