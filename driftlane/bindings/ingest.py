"""Collection-side operators over the business tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlane.bindings import bound, table
from driftlane.bindings.longitudinal import DAILY, WINDOW_SQL
from driftlane.bindings.events import daily, events
from driftlane.functions import identity
from driftlane.operators import ingest, validate
from driftlane.operators import longitudinal as lg
from driftlane.plans.staging import work_folder
from driftlane.sources import current, readers, sinks


def _meta(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size % 3 <> 0").select(
        F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"
    )


@bound("enrich_left", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, coalesce(p_brand, l_shipmode) AS p_brand, p_type, p_partkey IS NOT NULL AS enriched
FROM (SELECT *, 'none' AS l_shipmode FROM lineitem) LEFT JOIN (SELECT * FROM part WHERE p_size % 3 <> 0) ON l_partkey = p_partkey
""")
def enrich_left(spark, sf_dir):
    cards = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.lit("none").alias("p_brand"))
    out = ingest.enrich(cards, _meta(spark, sf_dir), "l_partkey", ["p_brand", "p_type"])
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "p_brand", "p_type", "enriched")


@bound("enrich_coverage", """
SELECT count(DISTINCT l_partkey) AS requested_video_count, count(DISTINCT p_partkey) AS enriched_video_count
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size % 3 <> 0) ON l_partkey = p_partkey
""")
def enrich_coverage(spark, sf_dir):
    cards = table(spark, sf_dir, "lineitem").select("l_partkey")
    return ingest.enrichment_coverage(
        ingest.enrich(cards, _meta(spark, sf_dir), "l_partkey", ["p_brand", "p_type"]), "l_partkey"
    )


@bound("latest_state", """
SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""")
def latest_state(spark, sf_dir):
    return ingest.latest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_orderstatus"
    )


@bound("upsert_latest", """
SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL
""")
def upsert_latest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    current = sinks.upsert_latest(None, orders.filter("o_orderkey % 2 = 0"), ["o_custkey"], ["o_orderkey"])
    return sinks.upsert_latest(current, orders.filter("o_orderkey % 2 = 1"), ["o_custkey"], ["o_orderkey"])


@bound("current_state", """
SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""")
def current_state(spark, sf_dir):
    """Three batches into a versioned table, the second one delivered twice."""
    orders, path = table(spark, sf_dir, "orders"), work_folder(spark)
    for batch in (0, 1, 1, 2):
        current.update(orders.filter(F.col("o_orderkey") % 3 == batch), path, ["o_custkey"], ["o_orderdate", "o_orderkey"], "orders", batch, 8)
    return current.read(spark, path).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@bound("same_day_replace", """
WITH s AS (SELECT o_custkey AS profile_id, o_orderdate AS day, o_orderpriority AS recorded_at, o_orderkey FROM orders)
SELECT profile_id, CAST(CAST(day AS DATE) AS VARCHAR) AS day, o_orderkey FROM s
QUALIFY recorded_at = max(recorded_at) OVER (PARTITION BY profile_id, day)
""")
def same_day_replace(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("profile_id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("recorded_at"), "o_orderkey"
    )
    return sinks.latest_collection(rows).select("profile_id", F.col("day").cast("string").alias("day"), "o_orderkey")


CARDS = """
cd AS (SELECT l_orderkey AS snapshot_id, l_linenumber * 1000000 + l_partkey AS position, lpad(CAST(l_partkey AS VARCHAR), CASE WHEN l_partkey % 13 = 0 THEN 9 ELSE 11 END, '0') AS video_id,
   CASE p_partkey % 11 WHEN 0 THEN ' Live ' WHEN 1 THEN '12:34' WHEN 2 THEN ' ' ELSE concat(' ', p_name, ' ') END AS title FROM lineitem JOIN part ON l_partkey = p_partkey),
ok AS (SELECT snapshot_id, video_id, position, trim(title) AS title FROM cd WHERE trim(title) NOT IN ('', 'Live', '12:34') AND length(video_id) = 11),
fi AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY snapshot_id, video_id ORDER BY position) = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY position, video_id) AS r FROM fi QUALIFY r <= 4)
"""


def _cards(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    key = F.col("p_partkey")
    title = F.when(key % 11 == 0, " Live ").when(key % 11 == 1, "12:34").when(key % 11 == 2, " ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    text = key.cast("string")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == key).select(
        F.col("l_orderkey").alias("snapshot_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("position"),
        F.when(key % 13 == 0, F.lpad(text, 9, "0")).otherwise(F.lpad(text, 11, "0")).alias("video_id"), title.alias("title"),
    )


@bound("clean_cards", f"WITH {CARDS} SELECT snapshot_id, video_id, title, r AS position FROM rk")
def clean_cards(spark, sf_dir):
    out = ingest.clean_cards(_cards(spark, sf_dir), limit=4)
    return out.select("snapshot_id", "video_id", "title", F.col("position").cast("bigint").alias("position"))


@bound("drop_parent", f"""
WITH {CARDS} SELECT snapshot_id, video_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY r, video_id) AS position
FROM rk WHERE video_id <> lpad(CAST(snapshot_id % 2000 AS VARCHAR), 11, '0')
""")
def drop_parent(spark, sf_dir):
    cards = ingest.clean_cards(_cards(spark, sf_dir), limit=4).withColumn(
        "parent_video_id", F.lpad((F.col("snapshot_id") % 2000).cast("string"), 11, "0")
    )
    return ingest.drop_parent(cards).select("snapshot_id", "video_id", F.col("position").cast("bigint").alias("position"))


@bound("page_channels", """
WITH c AS (SELECT user_id AS snapshot_id, event_id AS position, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE event_type WHEN 'view' THEN 'Live' ELSE concat('Channel ', event_type) END AS name FROM events),
p AS (SELECT *, CASE WHEN k % 2 = 0 THEN concat('/channel/UC', k % 30, '/videos') ELSE concat('/@handle', k % 30) END AS path FROM c),
q AS (SELECT *, CASE WHEN k % 2 = 0 THEN concat('UC', k % 30) END AS channel_id FROM p),
f AS (SELECT *, coalesce(channel_id, path) AS key FROM q QUALIFY row_number() OVER (PARTITION BY snapshot_id, key ORDER BY position) = 1)
SELECT snapshot_id, key, channel_id, CASE WHEN name = 'Live' THEN regexp_replace(path, '^/@?', '') ELSE name END AS name FROM f
QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY position) <= 20
""")
def page_channels(spark, sf_dir):
    k = F.col("k")
    rows = events(spark, sf_dir).select(
        F.col("user_id").alias("snapshot_id"), F.col("event_id").alias("position"),
        F.when(k % 2 == 0, F.concat(F.lit("/channel/UC"), k % 30, F.lit("/videos"))).otherwise(F.concat(F.lit("/@handle"), k % 30)).alias("path"),
        F.when(F.col("event_type") == "view", "Live").otherwise(F.concat(F.lit("Channel "), "event_type")).alias("name"),
    )
    return ingest.page_channels(rows, limit=20).select("snapshot_id", "key", "channel_id", "name")


def _documents(spark, sf_dir):
    """Documents as snapshot envelopes: a card per line."""
    card = "array<struct<title:string>>"
    lines = F.transform(F.split("text", "\n"), lambda l: F.struct(l.alias("title"))).cast(card)
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("profile_id"), F.col("lang").alias("session_id"),
        F.when(F.col("doc_id") % 3 == 0, "home").otherwise("up_next").alias("surface"), lines.alias("items"),
        F.array(F.struct(F.col("lang").alias("name"))).alias("subscription_channels"),
        F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("captured_at"),
    )


@bound("session_manifest", """
SELECT source AS profile_id, lang AS session_id, CASE WHEN doc_id % 3 = 0 THEN 'home' ELSE 'up_next' END AS surface, count(*) AS entries,
  CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS item_count, count(*) AS channel_count,
  min(lpad(CAST(doc_id AS VARCHAR), 10, '0')) AS first_captured_at, max(lpad(CAST(doc_id AS VARCHAR), 10, '0')) AS last_captured_at
FROM documents GROUP BY ALL
""")
def session_manifest(spark, sf_dir):
    return ingest.session_manifest(_documents(spark, sf_dir))


@bound("card_positions", r"""
SELECT doc_id AS snapshot_id, generate_subscripts(string_split(text, chr(10)), 1) AS position, unnest(string_split(text, chr(10))) AS title FROM documents
""")
def card_positions(spark, sf_dir):
    cards = F.transform(
        F.split("text", "\n"),
        lambda l: F.named_struct(
            F.lit("position"), F.lit(0), F.lit("title"), l,
            *[x for n in ("video_id", "channel", "url", "metadata_text", "duration_text", "subscription_state", "description", "youtube_category_id", "published_at") for x in (F.lit(n), F.lit(None).cast("string"))],
            F.lit("tags"), F.lit(None).cast("array<string>"), F.lit("youtube_topics"), F.lit(None).cast("array<string>"),
            F.lit("statistics"), F.lit(None).cast("struct<view_count:string>"),
        ),
    )
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("snapshot_id"), cards.alias("items"))
    return readers.explode_cards(docs).select("snapshot_id", F.col("position").cast("bigint").alias("position"), "title")


@bound("resolve_surfaces", """
SELECT o_orderkey AS snapshot_id, CASE WHEN o_orderkey % 3 <> 0 THEN concat('c', o_custkey) ELSE CAST(o_custkey AS VARCHAR) END AS body, o_orderkey % 3 <> 0 AS is_classified
FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderstatus = 'P'
""")
def resolve_surfaces(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    raw = orders.select(
        F.col("o_orderkey").alias("snapshot_id"), F.when(F.col("o_orderstatus") == "P", "subscriptions").otherwise("home").alias("surface"),
        F.col("o_custkey").cast("string").alias("body"),
    )
    done = orders.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("snapshot_id"), F.concat(F.lit("c"), "o_custkey").alias("body"))
    return readers.resolve_surface_rows(raw, done).select("snapshot_id", "body", "is_classified")


@bound("library_index", f"""
WITH {DAILY}, {WINDOW_SQL},
r AS (SELECT profile_id, key, row_number() OVER (PARTITION BY profile_id ORDER BY round(weight, 9) DESC, key) AS rank FROM trend QUALIFY rank <= 4)
SELECT profile_id, string_agg(CAST(key AS VARCHAR), '|' ORDER BY rank) AS top_interests FROM r GROUP BY ALL
""")
def library_index(spark, sf_dir):
    obs = daily(spark, sf_dir)
    rows = lg.interest_trends(obs, lg.last_day(events(spark, sf_dir))).groupBy("profile_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", F.col("key").cast("string").alias("id"), F.col("weight").alias("predicted_weight"), "trend_state"))),
            lambda r: F.struct(r["id"].alias("id"), r["id"].alias("name_vi"), r["predicted_weight"].alias("predicted_weight"), r["trend_state"].alias("trend_state")),
        ).alias("interest_weights")
    )
    who = identity.profile_identity(F.col("profile_id").cast("string"), F.lit(None).cast("string"))
    states = rows.withColumns(
        {
            "profile_short_id": who["profile_short_id"], "profile_label": who["profile_label"], "behavior_profile_name": F.lit("x"),
            "certainty_score": F.lit(0.5), "daily_observation_count": F.lit(1), "updated_at": F.lit("2"),
        }
    )
    older = states.withColumns({"updated_at": F.lit("1"), "interest_weights": F.slice("interest_weights", 1, 1)})
    index = ingest.library_index(states.unionByName(older))
    return index.select("profile_id", F.array_join(F.transform("top_interests", lambda t: t["id"]), "|").alias("top_interests"))


@bound("profile_identities", """
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'legacy-unidentified' ELSE concat('browser-', c_name) END AS profile_id,
  CASE WHEN c_custkey % 7 = 0 THEN 'legacyun' ELSE substr(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g'), 1, 8) END AS profile_short_id,
  CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE concat('Profile ', CASE WHEN c_custkey % 7 = 0 THEN 'legacyun' ELSE substr(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g'), 1, 8) END) END AS profile_label,
  concat('community-profile-', substr(sha256(concat(c_nationkey, '|', c_name)), 1, 24)) AS profile_key,
  substr(regexp_replace(c_name, '[^A-Za-z0-9_-]', '', 'g'), 1, 48) AS token
FROM customer
""")
def profile_identities(spark, sf_dir):
    pid = F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("browser-"), "c_name"))
    who = identity.profile_identity(pid, F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", who["profile_id"].alias("profile_id"), who["profile_short_id"].alias("profile_short_id"),
        who["profile_label"].alias("profile_label"),
        identity.profile_key(F.col("c_nationkey").cast("string"), F.col("c_name")).alias("profile_key"),
        identity.safe_token(F.col("c_name")).alias("token"),
    )


@bound("hashed_ids", """
SELECT c_custkey, substr(sha256(c_name), 1, 12) AS participant_hash, substr(sha256(c_mktsegment), 1, 12) AS device_hash,
  substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 16) AS profile_hash FROM customer
""")
def hashed_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("participant_id"), F.col("c_mktsegment").alias("device_id"), F.col("c_custkey").cast("string").alias("profile_id")
    )
    return sinks.with_hashed_ids(rows).select("c_custkey", "participant_hash", "device_hash", "profile_hash")


def _submissions(spark, sf_dir):
    key = F.col("c_custkey")
    weight = F.col("c_acctbal") / 5000

    def interest(i, w):
        return F.struct(
            i.alias("id"), F.lit("n").alias("name_vi"), w.alias("predicted_weight"),
            *[F.lit(0.5).alias(c) for c in ("today_weight", "weight_7d", "weight_30d", "long_term_weight")],
            F.lit("stable").alias("trend_state"), *[F.lit(2.0).alias(c) for c in ("home_weight", "up_next_weight", "subscription_weight")],
        )

    term = F.struct(
        F.concat(F.lit(" "), F.repeat(F.lit("ab"), 150)).alias("value"), weight.alias("weight"),
        *[F.lit(0.5).alias(c) for c in ("today_weight", "weight_7d", "weight_30d", "long_term_weight")], F.lit("rising").alias("trend_state"),
    )
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(key % 5 == 0, "1").otherwise(F.concat(F.lit("participant-"), key % 40)).alias("participant_id"), F.lit("device-1").alias("device_id"),
        F.when(key % 11 != 0, F.col("c_name")).alias("profile_id"), F.lit("name").alias("behavior_profile_name"), F.lit("2.5.0").alias("analysis_version"),
        F.lit("2024-01-01").alias("updated_at"), weight.alias("certainty_score"), (key % 9 - 2).cast("int").alias("daily_observation_count"),
        F.when(key % 4 == 0, "tv").otherwise("browser").alias("platform"), F.lit("1").alias("agent_version"),
        F.transform(F.sequence(F.lit(1), (key % 50 + 1).cast("int")), lambda i: interest(F.when(i % 4 != 0, i.cast("string")), weight)).alias("interest_weights"),
        F.array(F.struct(F.lit("tutorial").alias("id"), F.lit("T").alias("label"), weight.alias("weight"))).alias("intent_weights"),
        F.array(term, term).alias("keyword_trends"), F.array(term).alias("tag_trends"),
    )


@bound("build_submissions", """
SELECT concat('community-profile-', substr(sha256(concat(CASE WHEN c_custkey % 5 = 0 THEN '1' ELSE concat('participant-', c_custkey % 40) END, '|', c_name)), 1, 24)) AS profile_key,
  round(least(1.0, greatest(0.0, c_acctbal / 5000)), 6) AS certainty_score, CAST(greatest(0, c_custkey % 9 - 2) AS BIGINT) AS daily_observation_count,
  CAST(least(36, (c_custkey % 50 + 1) - (c_custkey % 50 + 1) // 4) AS BIGINT) AS interests, round(least(1.0, greatest(0.0, c_acctbal / 5000)), 6) AS weight, 200 AS term_length
FROM customer WHERE c_custkey % 11 <> 0
""")
def build_submissions(spark, sf_dir):
    out = validate.build_submissions(_submissions(spark, sf_dir))
    return out.select(
        "profile_key", F.round("certainty_score", 6).alias("certainty_score"), F.col("daily_observation_count").cast("bigint").alias("daily_observation_count"),
        F.size("interest_weights").cast("bigint").alias("interests"),
        F.round(F.get("interest_weights", F.lit(0))["predicted_weight"], 6).alias("weight"),
        F.length(F.get("keyword_trends", F.lit(0))["value"]).alias("term_length"),
    )


@bound("submission_errors", """
SELECT concat('community-profile-', substr(sha256(concat(CASE WHEN c_custkey % 5 = 0 THEN '1' ELSE concat('participant-', c_custkey % 40) END, '|', c_name)), 1, 24)) AS profile_key,
  concat_ws('; ', CASE WHEN c_custkey % 5 = 0 THEN 'invalid participant_id' END, CASE WHEN c_custkey % 4 = 0 THEN 'invalid collector.platform' END) AS errors
FROM customer WHERE c_custkey % 11 <> 0
""")
def submission_errors(spark, sf_dir):
    out = validate.build_submissions(_submissions(spark, sf_dir))
    return out.select("profile_key", F.array_join(validate.submission_errors(), "; ").alias("errors"))


@bound("device_errors", """
SELECT o_orderkey, concat_ws('; ', CASE WHEN o_custkey < 1000 THEN 'invalid participant_id' END,
  CASE WHEN o_orderstatus = 'P' THEN 'snapshot.source_package is not the observed app' END,
  CASE WHEN o_orderkey % 5 = 0 THEN 'invalid snapshot.tree_signature' END,
  CASE WHEN o_orderkey % 3 = 0 THEN 'snapshot.node_count does not match nodes length' END) AS errors FROM orders
""")
def device_errors(spark, sf_dir):
    key = F.col("o_orderkey")
    snapshot = F.struct(
        F.lit("1.0.0").alias("schema_version"), F.lit("android").alias("platform"),
        F.when(F.col("o_orderstatus") == "P", "other").otherwise("com.google.android.youtube").alias("source_package"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm").alias("captured_at"), F.lit("android_accessibility_node_tree_read_only").alias("extraction_mode"),
        F.struct(F.lit("home").alias("surface")).alias("surface_guess"), F.when(key % 5 == 0, "short").otherwise("long enough").alias("tree_signature"),
        F.when(key % 3 == 0, 2).otherwise(1).alias("node_count"), F.array(F.lit("node")).alias("nodes"),
    )
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit("1.0.0").alias("schema_version"), F.col("o_custkey").cast("string").alias("participant_id"), F.lit("device-1").alias("device_id"),
        F.lit("slot").alias("profile_slot"), snapshot.alias("snapshot"),
    )
    return rows.select("o_orderkey", F.array_join(validate.device_errors(), "; ").alias("errors"))


@bound("snapshot_errors", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'invalid_snapshot_schema' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'missing_parent_video_id'
  WHEN o_orderkey % 7 = 0 THEN 'missing_collection_session_id' ELSE '' END AS error FROM orders
""")
def snapshot_errors(spark, sf_dir):
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(status == "P", "other").when(status == "O", "youtube_up_next").otherwise("youtube_home").alias("source"),
        F.array(F.lit(1)).alias("items"), F.when(key % 2 == 1, F.lit("v")).alias("parent_video_id"),
        F.when(key % 7 == 0, " ").otherwise("s").alias("collection_session_id"),
    )
    return rows.select("o_orderkey", F.array_join(validate.snapshot_errors(), "; ").alias("error"))
