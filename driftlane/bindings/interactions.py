"""Interaction operators over ``events``.

The user is participant, device and profile at once; the event type keeps its
own name, with the score of the type it stands for.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlane.bindings import bound
from driftlane.bindings.events import EV, events
from driftlane.functions import identity
from driftlane.functions import weights as wt
from driftlane.functions.plan import spread
from driftlane.operators import ingest, validate
from driftlane.operators import interactions as ia
from driftlane.sources import readers, schemas

TYPES = ["view", "click", "error", "purchase", "signup"]
SCORES = {"view": 0.25, "click": 1.0, "error": -1.0, "purchase": 1.0, "signup": 1.0}
STATES = ["subscribed", "not_subscribed", "unknown"]

IEV = EV + """,
iev AS (SELECT *, CASE event_type WHEN 'view' THEN 0.25 WHEN 'error' THEN -1.0 ELSE 1.0 END AS score,
          CASE WHEN k % 3 = 0 THEN 'subscribed' WHEN k % 3 = 1 THEN 'not_subscribed' ELSE 'unknown' END AS state FROM ev)
"""

DAILY_COLS = ["n_view", "n_click", "n_error", "n_purchase", "n_signup", "open_subscribed", "open_not_subscribed", "open_unknown"]
DAILY_SQL = IEV + """,
iday AS (SELECT user_id AS profile_id, day, count(*) AS event_count, round_even(CAST(sum(score) AS DOUBLE), 4) AS score_total,
  count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'click') AS n_click,
  count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'purchase') AS n_purchase,
  count(*) FILTER (event_type = 'signup') AS n_signup,
  count(*) FILTER (event_type = 'view' AND state = 'subscribed') AS open_subscribed,
  count(*) FILTER (event_type = 'view' AND state = 'not_subscribed') AS open_not_subscribed,
  count(*) FILTER (event_type = 'view' AND state = 'unknown') AS open_unknown
  FROM iev GROUP BY ALL), evalday AS (SELECT max(day) AS as_of FROM iday)
"""


def interaction_rows(spark, sf_dir):
    k = F.col("k")
    state = F.when(k % 3 == 0, "subscribed").when(k % 3 == 1, "not_subscribed").otherwise("unknown")
    return events(spark, sf_dir).select(
        "event_id", "ts", "event_type", "day", "k", F.col("user_id").alias("profile_id"),
        wt.lookup(F.col("event_type"), SCORES, 0.0).alias("engagement_score"), state.alias("channel_subscription_state"),
    )


def interaction_days(spark, sf_dir):
    return ia.daily(interaction_rows(spark, sf_dir), ["profile_id"], TYPES, "view", STATES)


def _day(name):
    return F.col(name).cast("string").alias(name)


@bound("interaction_daily", f"""
WITH {DAILY_SQL} SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM iday
""")
def interaction_daily(spark, sf_dir):
    return interaction_days(spark, sf_dir).withColumn("day", _day("day"))


def _window_sql(days):
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in DAILY_COLS)
    return f"""
WITH {DAILY_SQL}
SELECT profile_id, count(*) AS observed_days, CAST(sum(event_count) AS BIGINT) AS event_count,
  round_even(CAST(sum(score_total) AS DOUBLE), 4) AS score_total, {sums}
FROM iday, evalday WHERE day <= as_of AND day > as_of - INTERVAL {days} DAY GROUP BY profile_id
"""


def _rolling(spark, sf_dir, days):
    rows = interaction_days(spark, sf_dir)
    return ia.window(rows, rows.agg(F.max("day")).scalar(), days, ["profile_id"]).drop("window_days")


@bound("interaction_rolling_7d", _window_sql(7))
def interaction_rolling_7d(spark, sf_dir):
    return _rolling(spark, sf_dir, 7)


@bound("interaction_rolling_30d", _window_sql(30))
def interaction_rolling_30d(spark, sf_dir):
    return _rolling(spark, sf_dir, 30)


@bound("interaction_running_7d", f"""
WITH {DAILY_SQL}
SELECT profile_id, CAST(day AS VARCHAR) AS day, count(*) OVER w AS observed_days,
  CAST(sum(event_count) OVER w AS BIGINT) AS event_count, round_even(CAST(sum(score_total) OVER w AS DOUBLE), 4) AS score_total
FROM iday WINDOW w AS (PARTITION BY profile_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)
""")
def interaction_running_7d(spark, sf_dir):
    return ia.running_window(interaction_days(spark, sf_dir), 7, ["profile_id"]).withColumn("day", _day("day"))


@bound("interaction_maps", f"""
WITH {DAILY_SQL}
SELECT profile_id, CAST(day AS VARCHAR) AS day,
  concat_ws(',', CASE WHEN n_click > 0 THEN concat('click=', n_click) END, CASE WHEN n_error > 0 THEN concat('error=', n_error) END,
    CASE WHEN n_purchase > 0 THEN concat('purchase=', n_purchase) END, CASE WHEN n_signup > 0 THEN concat('signup=', n_signup) END,
    CASE WHEN n_view > 0 THEN concat('view=', n_view) END) AS event_counts
FROM iday
""")
def interaction_maps(spark, sf_dir):
    rows = ia.as_maps(interaction_days(spark, sf_dir))
    entries = F.transform(F.array_sort(F.map_entries("event_counts")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rows.select("profile_id", _day("day"), F.array_join(entries, ",").alias("event_counts"))


@bound("interaction_dedup", f"""
WITH {EV} SELECT user_id AS profile_id, CAST(day AS VARCHAR) AS day, count(DISTINCT event_id) AS events FROM ev GROUP BY ALL
""")
def interaction_dedup(spark, sf_dir):
    ev = interaction_rows(spark, sf_dir)
    doubled = ev.unionByName(ev.filter("k < 40")).unionByName(ev.filter("k < 10"))
    once = ia.dedup(doubled, ["profile_id", "day", "event_id"], ["ts"])
    return once.groupBy("profile_id", _day("day")).agg(F.count("*").alias("events"))


@bound("interaction_new_events", f"""
WITH {EV} SELECT event_id, user_id AS profile_id FROM ev WHERE NOT (k < 40)
""")
def interaction_new_events(spark, sf_dir):
    ev = interaction_rows(spark, sf_dir)
    keys = ["profile_id", "day", "event_id"]
    batch = ev.withColumn("captured_at", F.col("ts")).unionByName(ev.filter("k > 90").withColumn("captured_at", F.col("ts")))
    return ia.new_events(batch, ev.filter("k < 40"), keys).select("event_id", "profile_id")


@bound("profile_latest_device", f"""
WITH {EV} SELECT user_id AS profile_id, arg_max(user_id % 40, ts) AS participant_id,
  arg_max(event_type, ts) AS device_id FROM ev GROUP BY user_id
""")
def profile_latest_device(spark, sf_dir):
    ev = events(spark, sf_dir).select(
        "ts", (F.col("user_id") % 40).alias("participant_id"), F.col("event_type").alias("device_id"), F.col("user_id").alias("profile_id")
    )
    return ia.latest_device(ev, "ts")


@bound("profile_interaction_summary", f"""
WITH {IEV},
pd AS (SELECT user_id % 40 AS participant_id, event_type AS device_id, user_id AS profile_id, day, count(*) AS n,
         round_even(CAST(sum(score) AS DOUBLE), 4) AS s FROM iev GROUP BY ALL),
e AS (SELECT max(day) AS as_of FROM pd),
latest AS (SELECT user_id AS profile_id, arg_max(user_id % 40, ts) AS participant_id, arg_max(event_type, ts) AS device_id FROM ev GROUP BY user_id),
roll AS (SELECT participant_id, device_id, profile_id,
    CAST(sum(n) FILTER (day > as_of - INTERVAL 7 DAY) AS BIGINT) AS n7, sum(s) FILTER (day > as_of - INTERVAL 7 DAY) AS s7,
    CAST(sum(n) FILTER (day > as_of - INTERVAL 30 DAY) AS BIGINT) AS n30, sum(s) FILTER (day > as_of - INTERVAL 30 DAY) AS s30
  FROM pd, e GROUP BY ALL)
SELECT l.profile_id, l.device_id, n7, round_even(CAST(s7 AS DOUBLE), 4) AS s7, n30, round_even(CAST(s30 AS DOUBLE), 4) AS s30
FROM latest l LEFT JOIN roll USING (participant_id, device_id, profile_id)
""")
def profile_interaction_summary(spark, sf_dir):
    rows = interaction_rows(spark, sf_dir).withColumns(
        {"participant_id": F.col("profile_id") % 40, "device_id": F.col("event_type")}
    )
    days = ia.daily(rows, ia.PROFILE, TYPES, "view", STATES)
    out = ia.profile_summary(days, ia.latest_device(rows, "ts"), days.agg(F.max("day")).scalar())
    return out.select(
        "profile_id", "device_id",
        F.col("rolling_7d.event_count").alias("n7"), F.col("rolling_7d.score_total").alias("s7"),
        F.col("rolling_30d.event_count").alias("n30"), F.col("rolling_30d.score_total").alias("s30"),
    )


@bound("repeat_open", f"""
WITH {EV}
SELECT event_id, user_id AS profile_id, event_type FROM ev
QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type
""")
def repeat_open(spark, sf_dir):
    ev = events(spark, sf_dir).select("event_id", "ts", F.col("user_id").alias("profile_id"), "event_type")
    return ingest.drop_repeat_opens(ev, ["profile_id"], "ts", ["event_id"], "event_type").drop("ts")


@bound("device_watch_opens", f"""
WITH {EV},
o AS (SELECT *, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'watch' ELSE 'other' END AS surface, event_type <> 'signup' AS change FROM ev),
p AS (SELECT *, coalesce(lag(surface) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS prev FROM o)
SELECT user_id AS profile_id, event_id, CASE WHEN prev <> 'watch' THEN 0.7 ELSE 0.55 END AS confidence
FROM p WHERE surface = 'watch' AND (prev <> 'watch' OR change)
""")
def device_watch_opens(spark, sf_dir):
    # no two events of a user are within four seconds, so every candidate counts
    ev = events(spark, sf_dir).select(
        "event_id", "ts", F.col("user_id").alias("profile_id"),
        F.when(F.col("event_type").isin("view", "click", "signup"), "watch").otherwise("other").alias("surface"),
        (F.col("event_type") != "signup").alias("window_change"),
    )
    return ingest.watch_opens(ev, ["profile_id"], "ts", ["event_id"]).select("profile_id", "event_id", "confidence")


@bound("device_watch_bursts", f"""
WITH {EV},
o AS (SELECT user_id, event_id, epoch_us(ts) // 10000 AS t, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'watch' ELSE 'other' END AS surface,
  event_type <> 'signup' AS change FROM ev),
p AS (SELECT *, coalesce(lag(surface) OVER (PARTITION BY user_id ORDER BY t, event_id), '') <> 'watch' AS entered FROM o),
f AS (SELECT user_id, list_reduce(list({{t: t, id: event_id, e: entered, kept: []::BIGINT[]}} ORDER BY t, event_id),
    lambda a, x: CASE WHEN x.e OR a.t IS NULL OR x.t - a.t > 4000000 THEN {{t: x.t, id: x.id, e: x.e, kept: list_append(a.kept, x.id)}} ELSE a END,
    {{t: NULL::BIGINT, id: NULL::BIGINT, e: false, kept: []::BIGINT[]}}) AS r
  FROM p WHERE surface = 'watch' AND (entered OR change) GROUP BY user_id)
SELECT user_id AS profile_id, event_id, CASE WHEN entered THEN 0.7 ELSE 0.55 END AS confidence
FROM (SELECT user_id, unnest(r.kept) AS event_id FROM f) JOIN p USING (user_id, event_id)
""")
def device_watch_bursts(spark, sf_dir):
    """The same on a clock ten thousand times as fast, so that opens come in bursts."""
    fast = F.expr("timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, cast(_t / 1000000 as decimal(18, 6)))")
    ev = events(spark, sf_dir).withColumn("_t", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast(ts as timestamp_ntz)) div 10000")).select(
        "event_id", fast.alias("ts"), F.col("user_id").alias("profile_id"),
        F.when(F.col("event_type").isin("view", "click", "signup"), "watch").otherwise("other").alias("surface"),
        (F.col("event_type") != "signup").alias("window_change"),
    )
    return ingest.watch_opens(ev, ["profile_id"], "ts", ["event_id"], bucket_seconds=60).select("profile_id", "event_id", "confidence")


@bound("snapshot_quota", f"""
WITH {EV},
s AS (SELECT *, k % 2 AS sig FROM ev),
c AS (SELECT * FROM s QUALIFY lag(sig) OVER (PARTITION BY user_id, event_type, day ORDER BY ts, event_id) IS DISTINCT FROM sig)
SELECT event_id, user_id AS profile_id, event_type FROM c
QUALIFY row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY ts, event_id)
  <= CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 1 END
""")
def snapshot_quota(spark, sf_dir):
    ev = events(spark, sf_dir).select(
        "event_id", "ts", "day", F.col("user_id").alias("profile_id"), "event_type", (F.col("k") % 2).alias("sig")
    )
    kept = ingest.apply_quota(
        ev, ["profile_id"], "event_type", "day", "ts", ["event_id"], "sig", {"view": 1, "click": 2}, 1
    )
    return kept.select("event_id", "profile_id", "event_type")


@bound("cap_per_day", f"""
WITH {EV}
SELECT event_id, user_id AS profile_id FROM ev
QUALIFY row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY ts, event_id) <= 1
""")
def cap_per_day(spark, sf_dir):
    ev = events(spark, sf_dir).select("event_id", "ts", "day", F.col("user_id").alias("profile_id"), "event_type")
    return ingest.apply_quota(
        ev, ["profile_id"], "event_type", "day", "ts", ["event_id"], None, {}, 1
    ).select("event_id", "profile_id")


@bound("signature_dedup", f"""
WITH {EV}
SELECT min(event_id) AS event_id, user_id AS profile_id, CAST(day AS VARCHAR) AS day, substr(sha256(concat(event_type, k % 5)), 1, 32) AS signature
FROM ev GROUP BY ALL
""")
def signature_dedup(spark, sf_dir):
    ev = events(spark, sf_dir).select(
        "event_id", F.col("user_id").alias("profile_id"), _day("day"),
        identity.short_hash(F.concat("event_type", F.col("k") % 5), 32).alias("signature"),
    )
    return ingest.dedup_signature(ev, ["profile_id", "day", "signature"], ["event_id"])


@bound("subscription_annotation", f"""
WITH {EV},
known AS (SELECT DISTINCT user_id, lower(concat('Channel ', k % 20)) AS ch FROM ev WHERE event_type = 'purchase')
SELECT e.event_id, CASE WHEN known.ch IS NOT NULL THEN 'subscribed' WHEN k % 2 = 0 THEN 'not_subscribed' ELSE 'unknown' END AS subscription_state
FROM ev e LEFT JOIN known ON e.user_id = known.user_id AND known.ch = lower(concat('channel ', k % 20)) WHERE event_type = 'view'
""")
def subscription_annotation(spark, sf_dir):
    ev = events(spark, sf_dir).select(
        "event_id", "event_type", F.col("user_id").alias("profile_id"),
        F.concat(F.lit("Channel  "), F.col("k") % 20).alias("channel"),
        F.when(F.col("k") % 2 == 0, "not_subscribed").alias("subscription_state"),
    )
    known = ev.filter("event_type = 'purchase'").select(
        "profile_id", F.lower(F.regexp_replace("channel", r"\s+", " ")).alias("key")
    )
    return ingest.annotate_subscription(ev.filter("event_type = 'view'"), known).select("event_id", "subscription_state")


def raw_lines(spark, sf_dir):
    """Events as JSON lines, a part of them breaking one rule or another."""
    k, v = F.col("k"), F.col("value")
    body = F.struct(
        F.when(k % 23 == 0, "0.9.0").otherwise("1.0.0").alias("schema_version"),
        F.concat(F.lit("evt-"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("event_id"),
        F.concat(F.lit("user-"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("participant_id"),
        F.when(k % 19 == 0, "d").otherwise("device-1").alias("device_id"),
        F.col("user_id").cast("string").alias("profile_id"),
        F.when(k % 17 == 0, "desktop").otherwise("browser").alias("platform"),
        F.when(k % 13 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("captured_at"),
        F.when(F.col("event_type") == "view", "video_open").when(F.col("event_type") == "click", "like").otherwise(F.col("event_type")).alias("event_type"),
        (v / 100).alias("engagement_score"),
        F.lit("natural_interaction_v1").alias("score_model"),
        F.lit("natural_user_action").alias("source"),
        (k / 90).alias("confidence"),
        F.when(k % 11 == 0, "typed words").alias("text"),
        F.when(k % 7 == 0, F.struct(F.lit("x").alias("message"))).alias("context"),
    )
    return spread(events(spark, sf_dir), "event_id").select("event_id", "user_id", F.to_json(body).alias("value"))


@bound("interaction_validate", f"""
WITH {EV}
SELECT event_id,
  concat_ws('; ',
    CASE WHEN k % 23 = 0 THEN 'unsupported schema_version' END,
    CASE WHEN k % 17 = 0 THEN 'invalid platform' END,
    CASE WHEN event_type NOT IN ('view', 'click') THEN 'invalid event_type' END,
    CASE WHEN k % 19 = 0 THEN 'invalid device_id' END,
    CASE WHEN k % 13 = 0 THEN 'invalid captured_at' END,
    CASE WHEN value / 100 > 2 THEN 'engagement_score outside [-2,2]' END,
    CASE WHEN k / 90.0 > 1 THEN 'confidence outside [0,1]' END,
    CASE WHEN k % 11 = 0 THEN 'comment/text content is forbidden: text' END,
    CASE WHEN k % 7 = 0 THEN 'comment/text content is forbidden in context' END) AS errors
FROM ev
""")
def interaction_validate(spark, sf_dir):
    checked = validate.validate_events(readers.parse_lines(raw_lines(spark, sf_dir), schemas.EVENT))
    return checked.select("event_id", F.array_join("errors", "; ").alias("errors"))


@bound("interaction_sanitize", f"""
WITH {EV}
SELECT concat('evt-', lpad(CAST(event_id AS VARCHAR), 8, '0')) AS event_id, CAST(day AS VARCHAR) AS day,
  CASE event_type WHEN 'view' THEN 'video_open' ELSE 'like' END AS event_type,
  round_even(CAST(value / 100 AS DOUBLE), 4) AS engagement_score, round_even(CAST(k / 90.0 AS DOUBLE), 4) AS confidence,
  'unknown' AS channel_subscription_state
FROM ev WHERE k % 23 <> 0 AND k % 17 <> 0 AND event_type IN ('view', 'click') AND k % 19 <> 0 AND k % 13 <> 0
  AND value / 100 <= 2 AND k <= 90 AND k % 11 <> 0 AND k % 7 <> 0
""")
def interaction_sanitize(spark, sf_dir):
    checked = validate.validate_events(readers.parse_lines(raw_lines(spark, sf_dir), schemas.EVENT))
    valid, _ = validate.split(checked)
    return validate.sanitize_events(valid.select("_row.*")).select(
        "event_id", _day("day"), "event_type", "engagement_score", "confidence", "channel_subscription_state"
    )


CLICK_LABEL = """CASE event_type WHEN 'view' THEN 'Like this  video' WHEN 'click' THEN 'Dislike' WHEN 'error' THEN 'Post comment'
  WHEN 'purchase' THEN 'Unlikely button' ELSE 'Share' END"""


@bound("browser_clicks", f"""
WITH {EV}, c AS (SELECT *, CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS pressed FROM ev),
t AS (SELECT *, CASE event_type WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'comment_submit' END
   WHEN 'click' THEN CASE WHEN pressed = 'false' THEN 'undislike' ELSE 'dislike' END
   WHEN 'view' THEN CASE WHEN pressed = 'false' THEN 'unlike' ELSE 'like' END END AS detected FROM c)
SELECT event_id, detected, CASE detected WHEN 'comment_submit' THEN 0.95 ELSE CASE WHEN pressed IS NULL THEN 0.7 ELSE 0.95 END END AS confidence,
  CASE detected WHEN 'like' THEN 1.0 WHEN 'unlike' THEN -1.0 WHEN 'dislike' THEN -1.0 ELSE 1.0 END AS score
FROM t WHERE detected IS NOT NULL
""")
def browser_clicks(spark, sf_dir):
    label = F.expr(CLICK_LABEL)
    pressed = F.when(F.col("k") % 3 == 0, "true").when(F.col("k") % 3 == 1, "false")
    found = identity.browser_click_event(label, F.col("k") % 2 == 0, pressed)
    rows = events(spark, sf_dir).select("event_id", found.alias("e")).filter("e is not null")
    return rows.select(
        "event_id", F.col("e.event_type").alias("detected"), F.col("e.confidence").alias("confidence"),
        identity.event_score(F.col("e.event_type")).alias("score"),
    )


@bound("device_clicks", f"""
WITH {EV}, t AS (SELECT *, CASE event_type WHEN 'error' THEN 'comment_submit'
   WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'dislike' ELSE 'undislike' END
   WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'like' ELSE 'unlike' END END AS detected FROM ev)
SELECT event_id, detected, CASE detected WHEN 'comment_submit' THEN 0.9 ELSE 0.75 END AS confidence,
  CASE detected WHEN 'like' THEN 1.0 WHEN 'unlike' THEN -1.0 WHEN 'dislike' THEN -1.0 ELSE 1.0 END AS score
FROM t WHERE detected IS NOT NULL
""")
def device_clicks(spark, sf_dir):
    found = identity.device_click_event(F.expr(CLICK_LABEL), F.col("k") % 2 == 0)
    rows = events(spark, sf_dir).select("event_id", found.alias("e")).filter("e is not null")
    return rows.select(
        "event_id", F.col("e.event_type").alias("detected"), F.col("e.confidence").alias("confidence"), F.col("e.score").alias("score")
    )


@bound("event_days", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS day FROM events
""")
def event_days(spark, sf_dir):
    text = F.when(F.col("event_id") % 7 == 0, "not a day").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    return events(spark, sf_dir).select("event_id", identity.event_day(text).cast("string").alias("day"))
