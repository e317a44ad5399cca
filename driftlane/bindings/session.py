"""Session operators: session = customer, seed = order priority, replay = order,
item = brand, interest = part type. Finished orders stand for the home feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlane.bindings import bound, table
from driftlane.functions import fixed
from driftlane.functions import weights as wt
from driftlane.functions.plan import in_tasks
from driftlane.operators import exposure as ex
from driftlane.operators import session as ss

SESSION = ["session_id"]

ROWS = """
sr AS (SELECT o_custkey AS session_id, CASE WHEN o_orderstatus = 'F' THEN 'home' ELSE 'up_next' END AS surface, o_orderpriority AS seed,
         o_orderkey AS replay, p_brand AS item, p_type AS key, l_linenumber AS position,
         1 / log2(l_linenumber + 1) * CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.8 ELSE 0.2 END AS weight, l_discount * 10 AS demand
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
home0 AS (SELECT session_id, key, sum(weight) AS w FROM sr WHERE surface = 'home' GROUP BY ALL),
home AS (SELECT session_id, key, w / sum(w) OVER (PARTITION BY session_id) AS share FROM home0),
up0 AS (SELECT session_id, seed, key, sum(weight) AS w FROM sr WHERE surface = 'up_next' GROUP BY ALL),
up1 AS (SELECT session_id, seed, key, w / sum(w) OVER (PARTITION BY session_id, seed) AS share FROM up0),
seeds AS (SELECT session_id, count(DISTINCT seed) AS n FROM up1 GROUP BY ALL),
up AS (SELECT session_id, key, sum(share) / max(n) AS share FROM up1 JOIN seeds USING (session_id) GROUP BY ALL),
bl0 AS (SELECT session_id, key, coalesce(h.share, 0) AS home, coalesce(u.share, 0) AS up_next FROM home h FULL JOIN up u USING (session_id, key)),
bl1 AS (SELECT *, bool_or(home > 0) OVER s AS hh, bool_or(up_next > 0) OVER s AS hu, home > 0 AND up_next > 0 AS cross_surface FROM bl0
        WINDOW s AS (PARTITION BY session_id)),
bl2 AS (SELECT *, CASE WHEN hh AND hu THEN (0.62 * home + 0.38 * up_next) * CASE WHEN cross_surface THEN 1.08 ELSE 1 END ELSE home + up_next END AS m FROM bl1),
bl AS (SELECT *, m / sum(m) OVER (PARTITION BY session_id) AS share FROM bl2),
dm AS (SELECT session_id, key, sum(weight * CASE WHEN demand = 0 THEN 0.25 ELSE demand END) / sum(weight) AS demand FROM sr GROUP BY ALL),
it0 AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(share, 9) DESC, key) AS rank, max(share) OVER (PARTITION BY session_id) AS top
        FROM bl LEFT JOIN dm USING (session_id, key)),
it1 AS (SELECT *, CASE WHEN rank = 1 OR share >= greatest(0.18, top * 0.55) THEN 'core' WHEN share >= greatest(0.065, top * 0.22) THEN 'adjacent' ELSE 'exploration' END AS zone,
          CASE WHEN up_next > 0 THEN least(1.0, up_next / greatest(0.001, share)) ELSE 0 END AS stability FROM it0),
it AS (SELECT *, least(1.0, greatest(0.0, 0.58 * share / top + 0.20 * coalesce(demand, 0.25) + 0.14 * stability + 0.08 * CASE WHEN cross_surface THEN 1.0 ELSE 0.35 END)) AS opportunity FROM it1),
occ AS (SELECT session_id, seed, replay, item, min(position) AS position FROM sr GROUP BY ALL),
rep AS (SELECT session_id, seed, count(DISTINCT replay) AS replay_count FROM sr GROUP BY ALL),
st0 AS (SELECT session_id, seed, item, count(*) AS appearances, avg(position) AS mp FROM occ GROUP BY ALL),
st AS (SELECT session_id, seed, item, appearances, replay_count, round_even(CAST(appearances / replay_count AS DOUBLE), 4) AS appearance_rate,
         round_even(CAST(mp AS DOUBLE), 2) AS mean_position, round_even(CAST(appearances / replay_count AS DOUBLE), 4) >= 0.67 AS stable
       FROM st0 JOIN rep USING (session_id, seed)),
ct AS (SELECT session_id, count(*) FILTER (surface = 'home') AS home_items, count(*) FILTER (surface = 'up_next') AS up_next_items,
         count(DISTINCT seed) FILTER (surface = 'up_next') AS seeds, count(DISTINCT replay) FILTER (surface = 'up_next') AS replays FROM sr GROUP BY ALL)
"""


def rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    joined = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    confidence = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("unknown")
    return joined.select(
        F.col("o_custkey").alias("session_id"),
        F.when(F.col("o_orderstatus") == "F", "home").otherwise("up_next").alias("surface"),
        F.col("o_orderpriority").alias("seed"), F.col("o_orderkey").alias("replay"), F.col("p_brand").alias("item"),
        F.col("p_type").alias("key"), F.col("l_linenumber").alias("position"),
        (wt.rank_weight(F.col("l_linenumber")) * wt.confidence_weight(confidence)).alias("weight"),
        (F.col("l_discount") * 10).alias("demand"),
    )


def rows_by_seed(spark, sf_dir):
    """Rows of a seed's lists in one task each; aggregates and windows of a seed then need no shuffle."""
    return in_tasks(rows(spark, sf_dir), table(spark, sf_dir, "lineitem").count(), *SESSION, "seed", a_task=250_000)


def _home(r):
    return wt.share_in_group(ss.key_sums(r.filter("surface = 'home'"), SESSION), SESSION, "weight", "share").drop("weight")


def _up(r):
    return ss.seed_mean(r.filter("surface = 'up_next'"), SESSION)


def _interests(r):
    return ss.interest_rows(ss.blend_surfaces(_home(r), _up(r), SESSION), ss.weighted_demand(r, SESSION), SESSION)


def _r(name, digits=6):
    return F.round(name, digits).alias(name)


@bound("replay_distribution", f"WITH {ROWS} SELECT session_id, key, round(share, 6) AS share FROM up")
def replay_distribution(spark, sf_dir):
    return _up(rows(spark, sf_dir)).select("session_id", "key", _r("share"))


@bound("surface_blend_bonus", f"""
WITH {ROWS} SELECT session_id, key, round(home, 6) AS home, round(up_next, 6) AS up_next, cross_surface, round(share, 6) AS share FROM bl
""")
def surface_blend_bonus(spark, sf_dir):
    r = rows(spark, sf_dir)
    return ss.blend_surfaces(_home(r), _up(r), SESSION).select("session_id", "key", _r("home"), _r("up_next"), "cross_surface", _r("share"))


@bound("intent_blend", f"""
WITH {ROWS},
ib AS (SELECT *, CASE WHEN hh AND hu THEN 0.62 * home + 0.38 * up_next ELSE home + up_next END AS mm FROM bl1),
ib2 AS (SELECT *, mm / sum(mm) OVER (PARTITION BY session_id) AS w FROM ib)
SELECT session_id, round(max(w), 6) AS weight, arg_min(key, struct_pack(a := -round(w, 9), b := key)) AS top_intent FROM ib2 GROUP BY ALL
""")
def intent_blend(spark, sf_dir):
    r = rows(spark, sf_dir)
    mixed = ss.blend_surfaces(_home(r), _up(r), SESSION, bonus=False)
    return mixed.groupBy("session_id").agg(
        F.round(F.max("share"), 6).alias("weight"),
        F.min_by("key", F.struct(-F.round("share", 9), "key")).alias("top_intent"),
    )


@bound("session_interests", f"""
WITH {ROWS} SELECT session_id, key, rank, zone, round(share, 6) AS share, round(stability, 6) AS stability, round(opportunity, 6) AS opportunity FROM it
""")
def session_interests(spark, sf_dir):
    return _interests(rows(spark, sf_dir)).select(
        "session_id", "key", F.col("rank").cast("bigint").alias("rank"), "zone", _r("share"), _r("stability"), _r("opportunity")
    )


@bound("session_lanes", f"""
WITH {ROWS}
SELECT session_id, min(key) FILTER (rank = 1) AS anchor,
  coalesce(arg_min(key, rank) FILTER (rank >= 2 AND cross_surface), min(key) FILTER (rank = 2)) AS bridge,
  coalesce(arg_min(key, rank) FILTER (rank >= 3 AND zone = 'exploration'), min(key) FILTER (rank = 3)) AS controlled_expansion
FROM it GROUP BY ALL
""")
def session_lanes(spark, sf_dir):
    return ss.lane_plan(_interests(rows(spark, sf_dir)), SESSION)


@bound("stable_items", f"WITH {ROWS} SELECT * FROM st")
def stable_items(spark, sf_dir):
    return ss.stable_items(rows_by_seed(spark, sf_dir), SESSION).select(
        "session_id", "seed", "item", "appearances", "replay_count", "appearance_rate", "mean_position", "stable"
    )


@bound("stable_items_top", f"""
WITH {ROWS} SELECT session_id, seed, item FROM st
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY appearance_rate DESC, mean_position, seed, item) <= 40
""")
def stable_items_top(spark, sf_dir):
    return ss.top_stable(ss.stable_items(rows_by_seed(spark, sf_dir), SESSION), SESSION).select("session_id", "seed", "item")


@bound("session_certainty", f"""
WITH {ROWS}, sq AS (SELECT session_id, count(*) FILTER (stable) AS stable_count, count(*) FILTER (stable) / count(*) AS ratio FROM st GROUP BY ALL)
SELECT session_id, home_items, up_next_items, seeds, replays, coalesce(stable_count, 0) AS stable_count,
  round(least(0.82, 0.20 + 0.25 * least(1.0, (home_items + least(up_next_items, 120)) / 100.0)
    + 0.20 * CASE WHEN home_items > 0 AND seeds > 0 THEN 1.0 ELSE 0.65 END
    + 0.18 * CASE WHEN seeds > 0 THEN least(1.0, replays / greatest(1, seeds * 3)) ELSE 0 END + 0.17 * coalesce(ratio, 0)), 6) AS certainty
FROM ct LEFT JOIN sq USING (session_id)
""")
def session_certainty(spark, sf_dir):
    r = rows_by_seed(spark, sf_dir)
    out = ss.certainty(ss.surface_counts(r, SESSION), ss.stable_items(r, SESSION), SESSION)
    return out.select("session_id", "home_items", "up_next_items", "seeds", "replays", "stable_count", _r("certainty"))


@bound("behavior_names", f"""
WITH {ROWS},
sh AS (SELECT session_id, min(key) FILTER (rank = 1) AS k, max(share) AS t, CASE WHEN count(*) > 1 THEN -sum(share * ln(share)) / ln(count(*)) ELSE 0 END AS d FROM it GROUP BY ALL)
SELECT session_id, CASE WHEN t >= 0.34 THEN concat(k, ' · ', l) WHEN d >= 0.72 THEN concat('Multi-interest · ', l) ELSE concat(k, '-leaning · ', l) END AS name
FROM (SELECT *, CASE session_id % 3 WHEN 0 THEN 'Tutorial Learner' WHEN 1 THEN 'News Seeker' ELSE 'Explorer' END AS l FROM sh)
""")
def behavior_names(spark, sf_dir):
    shape = _interests(rows(spark, sf_dir)).groupBy("session_id").agg(
        F.min_by("key", "rank").alias("k"), F.max("share").alias("t"), wt.entropy(F.col("share"), F.count("*")).alias("d")
    )
    intent = F.when(F.col("session_id") % 3 == 0, "tutorial").when(F.col("session_id") % 3 == 1, "news")
    return shape.select("session_id", ss.behavior_name(F.col("k"), intent, F.col("d"), F.col("t")).alias("name"))


@bound("seed_sample", """
SELECT o_custkey AS session_id, least(3, count(DISTINCT o_orderkey)) AS seeds FROM orders GROUP BY ALL
""")
def seed_sample(spark, sf_dir):
    picked = ss.sample_seeds(
        table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("item")), SESSION, "item", 3, 7
    )
    return picked.groupBy("session_id").agg(F.countDistinct("item").alias("seeds"))


@bound("session_surfaces", """
WITH s AS (SELECT o_custkey AS profile_id, o_orderpriority AS session_id, o_orderkey AS snapshot_id, o_orderdate AS captured_at,
   CASE o_orderstatus WHEN 'F' THEN 'home' WHEN 'O' THEN 'up_next' ELSE 'subscriptions' END AS surface FROM orders)
SELECT snapshot_id, surface FROM s QUALIFY surface = 'up_next' OR row_number() OVER (PARTITION BY profile_id, session_id, surface ORDER BY captured_at DESC, snapshot_id DESC) = 1
""")
def session_surfaces(spark, sf_dir):
    status = F.col("o_orderstatus")
    envelopes = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("profile_id"), F.col("o_orderpriority").alias("session_id"), F.col("o_orderkey").alias("snapshot_id"),
        F.col("o_orderdate").alias("captured_at"),
        F.when(status == "F", "home").when(status == "O", "up_next").otherwise("subscriptions").alias("surface"),
    )
    return ss.select_surfaces(envelopes).select("snapshot_id", "surface")


def _parts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return in_tasks(part, part.count(), "p_partkey")


def _title_sql():
    def quoted(text):
        return "'" + text.replace("'", "''") + "'"

    lists = {i: "[" + ", ".join(quoted(p) for p in ps) + "]" for i, ps in fixed.TITLE_PATTERNS.items()}
    return (
        f"CASE intent_id WHEN 'review' THEN {lists['review']} WHEN 'news' THEN {lists['news']} "
        f"WHEN 'compilation' THEN {lists['compilation']} ELSE {lists['']} END"
    )


@bound("title_suggestions", rf"""
WITH p AS (SELECT p_partkey, p_type AS direction, string_split(p_name, ' ') AS w,
   CASE p_partkey % 4 WHEN 0 THEN 'review' WHEN 1 THEN 'news' WHEN 2 THEN 'compilation' END AS intent_id FROM part),
f AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN direction ELSE w[1] END AS a,
        CASE WHEN p_partkey % 5 = 0 OR p_partkey % 5 = 1 THEN direction ELSE w[2] END AS b FROM p),
t AS (SELECT p_partkey, unnest(list_transform({_title_sql()}, lambda x: trim(regexp_replace(replace(replace(x, '{{primary}}', a), '{{secondary}}', b), '\s+', ' ', 'g'), ' -–—:|'))) AS title FROM f)
SELECT DISTINCT p_partkey, title FROM t
""")
def title_suggestions(spark, sf_dir):
    key = F.col("p_partkey")
    words = F.split("p_name", " ")
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    lanes = _parts(spark, sf_dir).select(
        "p_partkey", F.col("p_type").alias("direction"),
        F.when(key % 4 == 0, "review").when(key % 4 == 1, "news").when(key % 4 == 2, "compilation").alias("intent_id"),
        F.when(key % 5 == 0, F.array().cast("array<string>")).when(key % 5 == 1, F.array(first, F.upper(first)))
        .otherwise(F.array(first, F.upper(first), second)).alias("keywords"),
    )
    return ss.title_suggestions(lanes).select("p_partkey", F.explode("titles").alias("title"))


@bound("lane_packaging", """
WITH p AS (SELECT p_partkey, concat(p_type, ' kind') AS p_type, string_split(p_name, ' ') AS w, p_brand FROM part)
SELECT p_partkey, w[1] AS primary_term, concat_ws('|', w[1], w[2], p_brand) AS title_terms, concat_ws('|', w[1], w[2], p_brand, p_type) AS description_terms,
  concat_ws('|', p_brand, p_type) AS context_terms, concat_ws('|', upper(w[2]), 'tag') AS observed_tags, concat_ws('|', w[1], p_brand, p_type) AS semantic_tags FROM p
""")
def lane_packaging(spark, sf_dir):
    words = F.split("p_name", " ")
    one, two = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    lanes = _parts(spark, sf_dir).select(
        "p_partkey", F.col("p_type").alias("direction"),
        F.array(one, F.upper(one), two, F.col("p_brand"), F.concat("p_type", F.lit(" kind"))).alias("keywords"),
        F.array(F.upper(two), F.lit("tag"), F.lit("TAG ")).alias("tags"),
    )
    out = ss.packaging(lanes)
    return out.select(
        "p_partkey", "primary_term",
        *[F.array_join(c, "|").alias(c) for c in ("title_terms", "description_terms", "context_terms", "observed_tags", "semantic_tags")],
    )


@bound("effective_categories", """
WITH c AS (SELECT l_orderkey, l_linenumber, p_type, l_linestatus = 'O' AS o FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, p_type AS category_id, round(CASE WHEN o THEN 0.85 * 0.7 + 0.15 * 0.4 ELSE 0.7 END, 6) AS share FROM c
UNION ALL SELECT l_orderkey, l_linenumber, 'other', round(CASE WHEN o THEN 0.85 * 0.3 ELSE 0.3 END, 6) FROM c
UNION ALL SELECT l_orderkey, l_linenumber, 'third', round(0.15 * 0.6, 6) FROM c WHERE o
""")
def effective_categories(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    joined = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))

    def cat(name, share):
        return F.struct(name.alias("id"), name.alias("name"), F.lit(share).alias("share"), F.lit(None).cast("double").alias("raw_score"))

    content = F.array(cat(F.col("p_type"), 0.7), cat(F.lit("other"), 0.3))
    target = F.when(F.col("l_linestatus") == "O", F.array(cat(F.lit("third"), 0.6), cat(F.col("p_type"), 0.4)))
    blended = ex.blend_categories(joined, content, target, 0.85, 0.15)
    rows_ = blended.select("l_orderkey", "l_linenumber", F.explode_outer("categories").alias("c"))
    return rows_.select(
        "l_orderkey", "l_linenumber", F.col("c.id").alias("category_id"), F.round("c.share", 6).alias("share")
    )
