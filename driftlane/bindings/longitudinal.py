"""Longitudinal operators over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlane.bindings import bound
from driftlane.bindings.events import DAILY, EV, SURFACE_OF_TYPE, daily, events
from driftlane.functions import weights as wt
from driftlane.operators import longitudinal as lg


def _day(name: str):
    return F.col(name).cast("string").alias(name)


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


@bound("daily_distribution", f"""
WITH {DAILY}
SELECT profile_id, CAST(day AS VARCHAR) AS day, key, weight FROM daily
""")
def daily_distribution(spark, sf_dir):
    return daily(spark, sf_dir).select("profile_id", _day("day"), "key", "weight")


WINDOW_SQL = """
aged AS (SELECT d.*, as_of, datediff('day', day, as_of) AS age FROM daily d, evalday WHERE day <= as_of AND weight > 0),
keyed AS (
  SELECT profile_id, as_of, key,
    coalesce(sum(weight) FILTER (age = 0), 0) AS s0,
    coalesce(sum(weight * pow(0.5, age / 3.5)) FILTER (age <= 6), 0) AS s7,
    coalesce(sum(weight * pow(0.5, age / 14.0)) FILTER (age <= 29), 0) AS s30,
    sum(weight * pow(0.5, age / 60.0)) AS sl,
    coalesce(sum(weight * pow(0.5, age / 3.5)) FILTER (age BETWEEN 1 AND 7), 0) AS sp,
    min(day) FILTER (weight >= 0.012) AS first_seen,
    max(day) FILTER (weight >= 0.012) AS last_seen,
    max(day) FILTER (weight >= 0.012 AND age > 0) AS last_before,
    count(*) FILTER (weight >= 0.012) AS days_present
  FROM aged GROUP BY ALL),
prof AS (SELECT profile_id, as_of, count(DISTINCT day) FILTER (age > 0) AS history_days,
                count(DISTINCT day) AS observed_days FROM aged GROUP BY ALL),
wins AS (
  SELECT k.*, history_days, observed_days,
    coalesce(s0 / nullif(sum(s0) OVER p, 0), 0) AS today,
    coalesce(s7 / nullif(sum(s7) OVER p, 0), 0) AS w7d,
    coalesce(s30 / nullif(sum(s30) OVER p, 0), 0) AS w30d,
    coalesce(sl / nullif(sum(sl) OVER p, 0), 0) AS long,
    coalesce(sp / nullif(sum(sp) OVER p, 0), 0) AS prev7d
  FROM keyed k JOIN prof USING (profile_id, as_of)
  WINDOW p AS (PARTITION BY profile_id, as_of)),
mixed AS (SELECT *, 0.5 * today + 0.3 * w7d + 0.15 * w30d + 0.05 * long AS mix FROM wins),
trend AS (
  SELECT *, mix / sum(mix) OVER (PARTITION BY profile_id, as_of) AS weight,
    CASE WHEN history_days = 0 THEN 'baseline'
         WHEN today < 0.005 AND w30d >= 0.02 THEN 'dormant'
         WHEN today >= 0.02 AND datediff('day', last_before, as_of) >= 7 THEN 'revived'
         WHEN today >= 0.03 AND days_present <= 2 AND datediff('day', first_seen, as_of) <= 2 THEN 'emerging'
         WHEN prev7d > 0 AND today >= prev7d + 0.02 AND today >= prev7d * 1.18 THEN 'rising'
         WHEN prev7d >= 0.02 AND today + 0.02 <= prev7d AND today <= prev7d * 0.82 THEN 'cooling'
         ELSE 'stable' END AS trend_state,
    least(1.0, 0.20 + 0.12 * least(6, history_days) + 0.08 * least(4, days_present)) AS trend_confidence
  FROM mixed)
"""


def _trends(spark, sf_dir):
    # the newest day comes from the events themselves, not from the derived table
    return lg.interest_trends(daily(spark, sf_dir), lg.last_day(events(spark, sf_dir)))


@bound("decayed_windows", f"""
WITH {DAILY}, {WINDOW_SQL}
SELECT profile_id, key, round(today, 6) AS today, round(w7d, 6) AS w7d, round(w30d, 6) AS w30d,
       round(long, 6) AS long, round(prev7d, 6) AS prev7d FROM wins
""")
def decayed_windows(spark, sf_dir):
    return lg.window_table(daily(spark, sf_dir), lg.last_day(events(spark, sf_dir))).select(
        "profile_id", "key", *[_r(w) for w in ("today", "w7d", "w30d", "long", "prev7d")]
    )


@bound("composite_weights", f"""
WITH {DAILY}, {WINDOW_SQL}
SELECT profile_id, key, round(weight, 6) AS weight,
       row_number() OVER (PARTITION BY profile_id ORDER BY round(weight, 9) DESC, key) AS rank FROM trend
""")
def composite_weights(spark, sf_dir):
    return _trends(spark, sf_dir).select("profile_id", "key", _r("weight"), F.col("rank").cast("bigint").alias("rank"))


@bound("presence_stats", f"""
WITH {DAILY}, {WINDOW_SQL}
SELECT profile_id, key, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen,
       CAST(last_before AS VARCHAR) AS last_before, days_present, history_days FROM wins
""")
def presence_stats(spark, sf_dir):
    return lg.window_table(daily(spark, sf_dir), lg.last_day(events(spark, sf_dir))).select(
        "profile_id", "key", _day("first_seen"), _day("last_seen"), _day("last_before"), "days_present", "history_days"
    )


@bound("trend_states", f"""
WITH {DAILY}, {WINDOW_SQL}
SELECT profile_id, key, trend_state, round(trend_confidence, 6) AS trend_confidence,
       round(weight, 6) AS weight FROM trend
""")
def trend_states(spark, sf_dir):
    return _trends(spark, sf_dir).select(
        "profile_id", "key", "trend_state", _r("trend_confidence"), _r("weight")
    )


@bound("trend_backfill", f"""
WITH {DAILY.replace("evalday AS (SELECT max(day) AS as_of FROM daily)",
     "evalday AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS as_of FROM daily)")},
{WINDOW_SQL}
SELECT CAST(as_of AS VARCHAR) AS as_of, profile_id, key, trend_state, round(weight, 6) AS weight FROM trend
""")
def trend_backfill(spark, sf_dir):
    first, last = (events(spark, sf_dir).agg(f("day")).scalar() for f in (F.min, F.max))
    return lg.interest_trends(daily(spark, sf_dir), (first, last)).select(
        _day("as_of"), "profile_id", "key", "trend_state", _r("weight")
    )


TERM_DAILY = EV + """,
t0 AS (SELECT user_id AS profile_id, day, concat(event_type, ' ', k) AS key, sum(value) AS v FROM ev GROUP BY ALL),
daily AS (SELECT profile_id, day, key, round_even(CAST(v / sum(v) OVER (PARTITION BY profile_id, day) AS DOUBLE), 6) AS weight FROM t0),
evalday AS (SELECT max(day) AS as_of FROM daily)
"""


def term_daily(spark, sf_dir):
    sums = (
        events(spark, sf_dir)
        .groupBy(F.col("user_id").alias("profile_id"), "day", F.concat_ws(" ", "event_type", "k").alias("key"))
        .agg(F.sum("value").alias("v"))
    )
    return wt.share_in_open_group(sums, ["profile_id", "day"], "v", "_w").select(
        "profile_id", "day", "key", wt.round_even(F.col("_w"), 6).alias("weight")
    )


@bound("term_trends", f"""
WITH {TERM_DAILY}, {WINDOW_SQL},
terms AS (
  SELECT profile_id, key, round(mix, 4) AS weight,
    CASE WHEN observed_days <= 1 THEN 'baseline'
         WHEN today >= 0.01 AND prev7d = 0 THEN 'emerging'
         WHEN prev7d > 0 AND today >= prev7d * 1.25 AND today >= prev7d + 0.005 THEN 'rising'
         WHEN prev7d >= 0.005 AND today <= prev7d * 0.75 THEN 'cooling'
         ELSE 'stable' END AS trend_state
  FROM mixed)
SELECT * FROM terms QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY weight DESC, key) <= 40
""")
def term_trends(spark, sf_dir):
    return lg.term_trends(term_daily(spark, sf_dir), lg.last_day(events(spark, sf_dir)), 40).select("profile_id", "key", "weight", "trend_state")


SURF = EV + """,
s0 AS (SELECT user_id AS profile_id, day,
         CASE event_type WHEN 'view' THEN 'home' WHEN 'click' THEN 'up_next' ELSE 'subscriptions' END AS surface,
         k % 18 AS key, sum(value) AS v
       FROM ev GROUP BY ALL),
dist AS (SELECT *, v / sum(v) OVER (PARTITION BY profile_id, day, surface) AS share,
         CASE surface WHEN 'home' THEN 0.53 WHEN 'up_next' THEN 0.32 ELSE 0.15 END AS prior FROM s0 WHERE v > 0)
"""


def surface_rows(spark, sf_dir):
    surface = wt.lookup(F.col("event_type"), SURFACE_OF_TYPE, "subscriptions")
    return (
        events(spark, sf_dir)
        .groupBy(F.col("user_id").alias("profile_id"), "day", surface.alias("surface"), (F.col("k") % 18).alias("key"))
        .agg(F.sum("value").alias("weight"))
    )


@bound("surface_combine", f"""
WITH {SURF},
mix AS (SELECT profile_id, day, key, sum(prior * share) AS m,
          round_even(CAST(coalesce(sum(share) FILTER (surface = 'home'), 0) AS DOUBLE), 6) AS home,
          round_even(CAST(coalesce(sum(share) FILTER (surface = 'up_next'), 0) AS DOUBLE), 6) AS up_next,
          round_even(CAST(coalesce(sum(share) FILTER (surface = 'subscriptions'), 0) AS DOUBLE), 6) AS subscriptions
        FROM dist GROUP BY ALL)
SELECT profile_id, CAST(day AS VARCHAR) AS day, key,
       round_even(CAST(m / sum(m) OVER (PARTITION BY profile_id, day) AS DOUBLE), 6) AS weight,
       home, up_next, subscriptions FROM mix
""")
def surface_combine(spark, sf_dir):
    out = lg.combine_surfaces(surface_rows(spark, sf_dir), ["profile_id", "day"])
    return out.select(
        "profile_id", _day("day"), "key", "weight",
        *[F.coalesce(F.col("surfaces")[s], F.lit(0.0)).alias(s) for s in ("home", "up_next", "subscriptions")],
    )


@bound("surface_priors_applied", f"""
WITH {SURF}, present AS (SELECT DISTINCT profile_id, day, surface, prior FROM dist)
SELECT profile_id, CAST(day AS VARCHAR) AS day, surface,
       round_even(CAST(prior / sum(prior) OVER (PARTITION BY profile_id, day) AS DOUBLE), 6) AS applied FROM present
""")
def surface_priors_applied(spark, sf_dir):
    return lg.applied_priors(surface_rows(spark, sf_dir), ["profile_id", "day"]).select(
        "profile_id", _day("day"), "surface", "applied"
    )


@bound("term_map_blend", f"""
WITH {EV},
raw AS (SELECT user_id AS profile_id, day, concat('k', k) AS key, event_type = 'purchase' AS extra, sum(value) AS score
        FROM ev GROUP BY ALL),
tot AS (SELECT *, sum(CASE WHEN NOT extra THEN score END) OVER p AS mt, sum(CASE WHEN extra THEN score END) OVER p AS et
        FROM raw WHERE score > 0 WINDOW p AS (PARTITION BY profile_id, day)),
mixed AS (SELECT profile_id, day, key, mt, et,
            coalesce(0.85 * sum(score) FILTER (NOT extra) / mt, 0) + coalesce(0.15 * sum(score) FILTER (extra) / et, 0) AS m
          FROM tot GROUP BY profile_id, day, key, mt, et)
SELECT profile_id, CAST(day AS VARCHAR) AS day, key,
  round_even(CAST(m / ((CASE WHEN mt IS NOT NULL THEN 0.85 ELSE 0 END) + (CASE WHEN et IS NOT NULL THEN 0.15 ELSE 0 END)) AS DOUBLE), 6) AS weight
FROM mixed
""")
def term_map_blend(spark, sf_dir):
    def side(chosen):
        key = F.concat(F.lit("k"), F.col("k"))
        return (
            events(spark, sf_dir).filter(chosen)
            .groupBy(F.col("user_id").alias("profile_id"), "day", key.alias("key"))
            .agg(F.sum("value").alias("score"))
            .withColumn("value", F.col("key"))
        )

    return lg.blend_terms(side(F.col("event_type") != "purchase"), side(F.col("event_type") == "purchase"), ["profile_id", "day"]).select(
        "profile_id", _day("day"), "key", "weight"
    )


@bound("channel_history", f"""
WITH {EV}, evalday AS (SELECT max(day) AS as_of FROM ev),
stats AS (SELECT user_id AS profile_id, concat(event_type, '/', k % 20) AS key, count(DISTINCT day) AS observed_days,
            min(day) AS first_seen, max(day) AS last_seen, bool_or(day = as_of) AS observed_today
          FROM ev, evalday GROUP BY ALL)
SELECT profile_id, key, observed_days, CAST(first_seen AS VARCHAR) AS first_seen,
       CAST(last_seen AS VARCHAR) AS last_seen, observed_today
FROM stats QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY observed_today DESC, observed_days DESC, key DESC) <= 60
""")
def channel_history(spark, sf_dir):
    ev = events(spark, sf_dir)
    key = F.concat_ws("/", "event_type", F.col("k") % 20)
    rows = ev.select(
        F.col("user_id").alias("profile_id"), "day", key.alias("key"), key.alias("name"), F.lit(None).cast("string").alias("url")
    )
    return lg.channel_history(rows, ev.agg(F.max("day")).scalar()).select(
        "profile_id", "key", "observed_days", _day("first_seen"), _day("last_seen"), "observed_today"
    )


NAMES_SQL = f"""
{EV},
c0 AS (SELECT user_id AS profile_id, day, event_type AS candidate, sum(value) AS v FROM ev GROUP BY ALL),
cand AS (SELECT profile_id, day, candidate FROM c0
         QUALIFY row_number() OVER (PARTITION BY profile_id, day ORDER BY v DESC, candidate) = 1),
chg AS (SELECT *, CASE WHEN lag(candidate) OVER w IS NOT DISTINCT FROM candidate THEN 0 ELSE 1 END AS c FROM cand
        WINDOW w AS (PARTITION BY profile_id ORDER BY day)),
runs AS (SELECT *, sum(c) OVER (PARTITION BY profile_id ORDER BY day) AS run FROM chg),
streaks AS (SELECT *, row_number() OVER (PARTITION BY profile_id, run ORDER BY day) AS streak FROM runs),
named AS (SELECT *, coalesce(last_value(CASE WHEN streak >= 3 THEN candidate END IGNORE NULLS) OVER w,
                             first_value(candidate) OVER w) AS stable_name FROM streaks
          WINDOW w AS (PARTITION BY profile_id ORDER BY day ROWS UNBOUNDED PRECEDING)),
prevd AS (SELECT *, lag(stable_name) OVER (PARTITION BY profile_id ORDER BY day) AS before FROM named)
"""


def _candidates(spark, sf_dir):
    sums = events(spark, sf_dir).groupBy(
        F.col("user_id").alias("profile_id"), "day", F.col("event_type").alias("candidate")
    ).agg(F.sum("value").alias("v"))
    return sums.groupBy("profile_id", "day").agg(
        F.min_by("candidate", F.struct(-F.col("v"), "candidate")).alias("candidate")
    )


@bound("stable_name", f"""
WITH {NAMES_SQL}
SELECT profile_id, CAST(day AS VARCHAR) AS day, candidate, streak, stable_name,
  CASE WHEN before IS NULL THEN 'initialized' WHEN before = candidate THEN 'stable'
       WHEN streak >= 3 THEN 'promoted_after_3_daily_observations'
       ELSE 'candidate_waiting_for_stability' END AS status
FROM prevd
""")
def stable_name(spark, sf_dir):
    return lg.stable_names(_candidates(spark, sf_dir)).select(
        "profile_id", _day("day"), "candidate", F.col("streak").cast("bigint").alias("streak"), "stable_name", "status"
    )


@bound("previous_names", f"""
WITH {NAMES_SQL},
gone AS (SELECT profile_id, before AS name, min(day) AS day FROM prevd WHERE before <> stable_name GROUP BY ALL),
kept AS (SELECT * FROM gone QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY day DESC) <= 10)
SELECT profile_id, string_agg(name, '|' ORDER BY day, name) AS previous_names FROM kept GROUP BY ALL
""")
def previous_names(spark, sf_dir):
    out = lg.previous_names(lg.stable_names(_candidates(spark, sf_dir)))
    return out.select("profile_id", F.array_join("previous_names", "|").alias("previous_names"))


@bound("interest_facts", f"""
WITH {EV},
sess AS (SELECT user_id AS profile_id, k % 18 AS key, day, max(event_type) AS name, round(least(1.0, log10(1 + avg(value)) / 3), 6) AS demand FROM ev GROUP BY ALL),
cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS as_of FROM ev),
evals AS (SELECT profile_id, key, as_of FROM (SELECT DISTINCT profile_id, key FROM sess), cal)
SELECT CAST(e.as_of AS VARCHAR) AS as_of, e.profile_id, e.key, name, demand
FROM evals e ASOF JOIN sess s ON e.profile_id = s.profile_id AND e.key = s.key AND e.as_of >= s.day
""")
def interest_facts(spark, sf_dir):
    """Name and demand of each interest on every day: of the newest session that has it."""
    ev = events(spark, sf_dir)
    history = ev.groupBy(F.col("user_id").alias("profile_id"), (F.col("k") % 18).alias("key"), "day").agg(
        F.max("event_type").alias("name"), F.least(F.lit(1.0), F.log10(1 + F.avg("value")) / 3).alias("demand"))
    first, last = (ev.agg(f("day")).scalar() for f in (F.min, F.max))
    return lg.facts_as_of(history, (first, last)).select(_day("as_of"), "profile_id", "key", "name", _r("demand"))


FLAGSHIP_SQL = f"""
WITH {DAILY}, {WINDOW_SQL}, {SURF.replace(EV + ",", "")},
today_dist AS (SELECT d.*, round_even(CAST(share AS DOUBLE), 6) AS rshare FROM dist d JOIN evalday ON day = as_of),
today_s AS (SELECT profile_id, key, sum(rshare) FILTER (surface = 'up_next') AS up, count(*) FILTER (rshare > 0) AS surfaces
            FROM today_dist GROUP BY ALL),
dem AS (SELECT user_id AS profile_id, k % 18 AS key, least(1.0, log10(1 + avg(value)) / 3) AS demand FROM ev GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY round(weight, 9) DESC, key) AS rank,
             max(weight) OVER (PARTITION BY profile_id) AS top FROM trend)
"""


def _interest_rows(spark, sf_dir):
    obs = daily(spark, sf_dir)
    as_of = lg.last_day(events(spark, sf_dir))
    today_rows = surface_rows(spark, sf_dir)
    today_rows = today_rows.filter(F.col("day") == as_of)
    today = lg.combine_surfaces(today_rows, ["profile_id", "day"])
    demand = F.least(F.lit(1.0), F.log10(1 + F.avg("value")) / 3)
    meta = events(spark, sf_dir).groupBy(
        F.col("user_id").alias("profile_id"), (F.col("k") % 18).alias("key")
    ).agg(demand.alias("demand"), F.lit(None).cast("string").alias("name"))
    return lg.interest_rows(lg.interest_trends(obs, as_of), today, meta)


INTEREST_SQL = f"""{FLAGSHIP_SQL},
rows_ AS (
SELECT r.profile_id, r.key, rank, r.weight, trend_state, top, observed_days,
  CASE WHEN rank = 1 OR r.weight >= greatest(0.18, top * 0.55) THEN 'core'
       WHEN r.weight >= greatest(0.065, top * 0.22) THEN 'adjacent' ELSE 'exploration' END AS zone,
  coalesce(surfaces, 0) >= 2 AS cross_surface,
  CASE WHEN demand IS NULL OR demand = 0 THEN 0.25 ELSE demand END AS demand,
  least(1.0, coalesce(up, 0) / greatest(0.001, CASE WHEN today > 0 THEN today ELSE r.weight END)) AS stability,
  CASE trend_state WHEN 'rising' THEN 1.0 WHEN 'emerging' THEN 0.9 WHEN 'revived' THEN 0.85 WHEN 'stable' THEN 0.62
       WHEN 'cooling' THEN 0.28 WHEN 'dormant' THEN 0.1 ELSE 0.55 END AS momentum
FROM ranked r LEFT JOIN today_s t USING (profile_id, key) LEFT JOIN dem USING (profile_id, key)),
scored AS (SELECT *, least(1.0, greatest(0.0, 0.48 * weight / greatest(0.001, top) + 0.18 * demand + 0.10 * stability
  + 0.08 * CASE WHEN cross_surface THEN 1.0 ELSE 0.35 END + 0.16 * momentum)) AS opportunity FROM rows_)
"""


@bound("temporal_interests", f"""
{INTEREST_SQL}
SELECT profile_id, key, rank, round(weight, 6) AS weight, trend_state, zone, cross_surface,
       round(stability, 6) AS stability, round(opportunity, 6) AS opportunity FROM scored
""")
def temporal_interests(spark, sf_dir):
    return _interest_rows(spark, sf_dir).select(
        "profile_id", "key", F.col("rank").cast("bigint").alias("rank"), _r("weight"), "trend_state", "zone",
        "cross_surface", _r("stability"), _r("opportunity"),
    )


@bound("trend_lanes", f"""
{INTEREST_SQL},
act AS (SELECT *, trend_state <> 'dormant' AS a, bool_or(trend_state <> 'dormant') OVER (PARTITION BY profile_id) AS any_a FROM scored),
pl AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY rank) AS place FROM act WHERE a OR NOT any_a)
SELECT profile_id, min(key) FILTER (place = 1) AS anchor,
  coalesce(arg_min(key, place) FILTER (place >= 2 AND cross_surface AND trend_state IN ('rising','stable','emerging','revived','baseline')),
           min(key) FILTER (place = 2)) AS bridge,
  coalesce(arg_min(key, place) FILTER (place >= 3 AND trend_state IN ('rising','emerging','revived')),
           min(key) FILTER (place = 3)) AS controlled_expansion
FROM pl GROUP BY ALL
""")
def trend_lanes(spark, sf_dir):
    return lg.trend_lanes(_interest_rows(spark, sf_dir)).drop("as_of")


@bound("profile_shape", f"""
{INTEREST_SQL},
w AS (SELECT profile_id, key, rank, observed_days, round_even(CAST(weight AS DOUBLE), 4) AS rw FROM scored),
shape AS (SELECT profile_id, min(key) FILTER (rank = 1) AS top_key, max(rw) AS top_share, max(observed_days) AS observed_days,
  CASE WHEN count(*) FILTER (rw > 0) > 1
       THEN -sum(rw * ln(rw)) FILTER (rw > 0) / ln(count(*) FILTER (rw > 0)) ELSE 0 END AS diversity FROM w GROUP BY profile_id)
SELECT profile_id, round(top_share, 4) AS top_share, round(diversity, 6) AS diversity, observed_days,
  CASE WHEN top_share >= 0.34 THEN concat(top_key, ' · Explorer')
       WHEN diversity >= 0.72 THEN 'Multi-interest · Explorer'
       ELSE concat(top_key, '-leaning · Explorer') END AS candidate_name,
  round(least(0.86, (profile_id % 10) / 10.0 + 0.08 * least(1.0, greatest(0, observed_days - 1) / 7.0) + 0.04), 6) AS certainty
FROM shape
""")
def profile_shape(spark, sf_dir):
    shape = lg.profile_shape(_interest_rows(spark, sf_dir).withColumn("name", F.col("key").cast("string")))
    name = lg.candidate_name(F.col("top_name"), F.lit(None).cast("string"), F.col("top_share"), F.col("diversity"))
    sure = lg.certainty((F.col("profile_id") % 10) / 10, F.col("observed_days"), F.lit(True))
    return shape.select(
        "profile_id", _r("top_share", 4), _r("diversity"), "observed_days",
        name.alias("candidate_name"), F.round(sure, 6).alias("certainty"),
    )
