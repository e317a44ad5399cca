"""Exposure prior over orders, line items and parts: one snapshot per customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlane.bindings import bound, table
from driftlane.functions import weights as wt
from driftlane.functions.plan import in_tasks
from driftlane.operators import exposure as ex
from driftlane.operators import terms as tm

ITEMS = """
li AS (
  SELECT o_custkey AS snapshot_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS video_id, l_linenumber AS position, p_type,
    concat('b', l_partkey % 5) AS brand, l_linestatus = 'O' AS target,
    CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.8 ELSE 0.2 END AS cw, l_returnflag,
    1 / log2(greatest(1, l_linenumber) + 1) AS rw, l_tax > 0 AS enriched,
    CASE WHEN l_quantity > 10 THEN l_discount * 9.8696044 ELSE 0.25 END AS demand,
    CASE WHEN l_tax = 0 THEN 0.30 ELSE greatest(0.15, least(1.0, 1 / (1 + log10(1 + l_tax * 1000)))) END AS fresh
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
li2 AS (SELECT *, CASE WHEN target THEN 0.78 * 0.7 + 0.22 * 0.4 ELSE 0.7 END AS share_type,
                  CASE WHEN target THEN 0.78 * 0.3 + 0.22 * 0.6 ELSE 0.3 END AS share_brand FROM li),
cc AS (SELECT *, p_type AS category_id, share_type * rw * cw AS c FROM li2
       UNION ALL SELECT *, brand, share_brand * rw * cw FROM li2),
ms AS (SELECT snapshot_id, category_id, sum(c) AS interest, sum(c * demand) / sum(c) AS demand, sum(c * fresh) / sum(c) AS fresh,
         sum(c * cw) / sum(c) AS quality FROM cc GROUP BY ALL),
ds AS (SELECT *, interest / sum(interest) OVER (PARTITION BY snapshot_id) AS share FROM ms),
dist AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY round(share, 9) DESC, category_id) AS rank,
           max(share) OVER (PARTITION BY snapshot_id) AS top FROM ds),
zoned AS (SELECT *, CASE WHEN rank = 1 OR share >= greatest(0.20, top * 0.55) THEN 'core'
            WHEN share >= greatest(0.07, top * 0.22) THEN 'adjacent' ELSE 'exploration' END AS zone FROM dist)
"""

GROUP = ["snapshot_id"]


def _cat(name, share):
    return F.struct(name.alias("id"), name.alias("name"), F.lit(share).alias("share"), F.lit(None).cast("double").alias("raw_score"))


def items(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    joined = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    # a snapshot's cards in one task: its sums, shares and ranks need no shuffle, and a task's sums grow with its rows alone
    joined = in_tasks(joined, lineitem.count(), "o_custkey")
    kind, brand = F.col("p_type"), F.concat(F.lit("b"), F.col("l_partkey") % 5)
    weak = F.col("l_linenumber") % 2 == 1
    news = F.array(F.struct(F.when(weak, "Ngày ").otherwise("tin tức").alias("phrase")))
    intents = F.array(*[
        F.struct(i.alias("id"), i.alias("name"), F.lit(0.5).alias("share")) for i in (F.lit("news"), F.col("l_returnflag"))
    ])
    rows = joined.select(
        F.col("o_custkey").alias("snapshot_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("video_id"),
        F.col("l_linenumber").alias("position"),
        F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("unknown").alias("confidence"),
        F.when(F.col("l_tax") > 0, "enriched").otherwise("home_visible").alias("mode"),
        F.struct(F.array(_cat(kind, 0.7), _cat(brand, 0.3)).alias("categories")).alias("classification"),
        F.struct(
            (F.col("l_linestatus") == "O").alias("available"), F.array(_cat(brand, 0.6), _cat(kind, 0.4)).alias("categories")
        ).alias("target_profile"),
        F.struct(intents.alias("intents"), F.create_map(F.lit("news"), news).alias("evidence")).alias("intent_profile"),
        F.struct(
            (F.col("l_quantity") > 10).alias("available"), (F.col("l_discount") * 9.8696044).alias("demand_signal"),
            F.when(F.col("l_tax") > 0, F.col("l_tax") * 1000).alias("age_days"),
        ).alias("popularity_profile"),
    )
    return ex.with_weights(ex.effective_intents(ex.effective_categories(rows))).select(
        *GROUP, "video_id", "position", "confidence", "mode", "categories", "intents", "rank_weight", "confidence_weight", "demand", "freshness"
    )


def _contributions(spark, sf_dir):
    return ex.contributions(items(spark, sf_dir), GROUP)


def _dist(spark, sf_dir):
    return ex.distribution(ex.measures(_contributions(spark, sf_dir), GROUP), GROUP)


def _r(name, digits=6):
    return F.round(name, digits).alias(name)


def _e(name, digits=6):
    """Rounded off exact halves, which both engines reach from either side."""
    return F.round(F.col(name) + 1e-9, digits).alias(name)


@bound("category_measures", f"""
WITH {ITEMS} SELECT snapshot_id, category_id, round(interest + 1e-9, 6) AS interest, round(demand + 1e-9, 6) AS demand, round(fresh + 1e-9, 6) AS freshness,
  round(quality + 1e-9, 6) AS quality FROM ms
""")
def category_measures(spark, sf_dir):
    return ex.measures(_contributions(spark, sf_dir), GROUP).select(
        "snapshot_id", "category_id", _e("interest"), _e("demand"), _e("freshness"), _e("quality")
    )


@bound("zones", f"""
WITH {ITEMS} SELECT snapshot_id, category_id, round(share, 6) AS share, rank, zone FROM zoned
""")
def zones(spark, sf_dir):
    return _dist(spark, sf_dir).select("snapshot_id", "category_id", _r("share"), F.col("rank").cast("bigint").alias("rank"), "zone")


@bound("archetype", f"""
WITH {ITEMS},
sh AS (SELECT snapshot_id, CASE WHEN count(*) > 1 THEN -sum(share * ln(share)) / ln(count(*)) ELSE 0 END AS d, max(share) AS t,
         sum(share) FILTER (rank <= 3) AS t3, min(category_id) FILTER (rank = 1) AS name FROM dist GROUP BY ALL)
SELECT snapshot_id, round(d, 6) AS diversity, round(t, 6) AS top_share, round(t3, 6) AS top3_share,
  CASE WHEN t >= 0.50 AND d < 0.55 THEN concat('Specialist — ', name) WHEN t >= 0.28 AND d >= 0.65 THEN concat(name, '-heavy Variety / Explorer')
       WHEN d >= 0.75 THEN 'Variety / Explorer' ELSE 'Mixed-interest' END AS archetype FROM sh
""")
def archetype(spark, sf_dir):
    return ex.shape(_dist(spark, sf_dir), GROUP).select(
        "snapshot_id", _r("diversity"), _r("top_share"), _r("top3_share"), "archetype"
    )


_MIX = """
im0 AS (SELECT snapshot_id, category_id, l_returnflag AS intent_id, sum(c * CASE WHEN position % 2 = 1 THEN 1.0 ELSE 0.5 END) AS w FROM cc GROUP BY ALL
        UNION ALL SELECT snapshot_id, category_id, 'news', sum(c * 0.5) FROM cc WHERE position % 2 = 0 GROUP BY ALL),
im AS (SELECT snapshot_id, category_id, intent_id, w / sum(w) OVER (PARTITION BY snapshot_id, category_id) AS share FROM im0),
mix AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, category_id ORDER BY round(share, 9) DESC, intent_id) AS rank FROM im QUALIFY rank <= 3)
"""


@bound("intent_mix", f"""
WITH {ITEMS}, {_MIX} SELECT snapshot_id, category_id, intent_id, round(share, 6) AS share, rank FROM mix
""")
def intent_mix(spark, sf_dir):
    return ex.intent_mix(_contributions(spark, sf_dir), GROUP).select(
        "snapshot_id", "category_id", "intent_id", _r("share"), F.col("rank").cast("bigint").alias("rank")
    )


@bound("sample_items", f"""
WITH {ITEMS} SELECT snapshot_id, category_id, video_id,
  row_number() OVER (PARTITION BY snapshot_id, category_id ORDER BY round(c, 9) DESC, position, video_id) AS rank FROM cc QUALIFY rank <= 4
""")
def sample_items(spark, sf_dir):
    return ex.sample_items(_contributions(spark, sf_dir), GROUP).select(
        "snapshot_id", "category_id", "video_id", F.col("rank").cast("bigint").alias("rank")
    )


@bound("expansion_candidates", f"""
WITH {ITEMS},
topc AS (SELECT *, CASE WHEN share_type >= share_brand THEN p_type ELSE brand END AS category_id,
           round_even(CAST(rw * (0.65 + 0.25 * demand + 0.10 * fresh) AS DOUBLE) - 1e-9, 4) AS expansion_score FROM li2),
cand AS (SELECT t.*, z.zone FROM topc t JOIN zoned z USING (snapshot_id, category_id) WHERE zone <> 'core')
SELECT snapshot_id, video_id, category_id, zone, expansion_score FROM cand
QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY expansion_score DESC, position, video_id) <= 12
""")
def expansion_candidates(spark, sf_dir):
    cards = items(spark, sf_dir)
    dist = ex.distribution(ex.measures(ex.contributions(cards, GROUP), GROUP), GROUP)
    out = ex.expansion_candidates(cards, dist, GROUP)
    return out.select("snapshot_id", "video_id", "category_id", "zone", "expansion_score")


@bound("evidence_quality", f"""
WITH {ITEMS},
q AS (SELECT snapshot_id, count(*) AS n, count(*) FILTER (l_returnflag IN ('R', 'A')) AS cl, count(*) FILTER (enriched) AS en, avg(cw) AS ac FROM li GROUP BY ALL)
SELECT snapshot_id, n AS video_count, cl AS classified_count, en AS enriched_count, round(ac + 1e-9, 6) AS average_confidence,
  round(least(0.75, 0.25 * least(1.0, n / 50.0) + 0.30 * cl / n + 0.25 * en / n + 0.20 * ac) + 1e-9, 6) AS certainty FROM q
""")
def evidence_quality(spark, sf_dir):
    return ex.evidence_quality(items(spark, sf_dir), GROUP).select(
        "snapshot_id", "video_count", "classified_count", "enriched_count", _e("average_confidence"), _e("certainty")
    )


TERM_ROWS = """
pt AS (SELECT p_partkey, p_size AS snapshot_id, p_type AS category_id, p_brand, string_split(p_name, ' ') AS w, p_name, p_partkey % 20 + 1 AS position,
         1 / log2(p_partkey % 20 + 2) AS c, CASE WHEN p_partkey % 2 = 0 THEN 'home' ELSE 'up_next' END AS surface FROM part),
tags AS (SELECT *, unnest([w[1], concat('#', w[2]), concat('zzz ', w[1]), concat('none', p_partkey % 3)]) AS tag FROM pt),
tagc AS (SELECT *, ltrim(lower(tag), '#') AS key,
   CASE WHEN contains(lower(concat(p_name, ' ', p_brand, ' #', w[2])), ltrim(lower(tag), '#')) THEN 1.0 WHEN tag LIKE 'zzz %' THEN 0.65 ELSE 0.40 END AS cons FROM tags)
"""


def _tagged(tag_base, topic, evidence, hashtag):
    extra = f"UNION ALL SELECT snapshot_id, category_id, p_partkey, surface, lower(w[2]), c * {hashtag}, 1.0, 'hashtag' FROM pt" if hashtag else ""
    return f"""
{TERM_ROWS},
trow AS (
  SELECT snapshot_id, category_id, p_partkey AS video_id, surface, key, c * ({tag_base} + (1 - {tag_base}) * cons) AS score, cons, 'creator_tag' AS source FROM tagc
  UNION ALL SELECT snapshot_id, category_id, p_partkey, surface, lower(concat(category_id, ' x')), c * {topic}, 1.0, 'youtube_topic' FROM pt
  UNION ALL SELECT snapshot_id, category_id, p_partkey, surface, lower(p_brand), c * {evidence}, 1.0, 'classifier_evidence' FROM pt {extra})
"""


def term_cards(spark, sf_dir):
    words = F.split("p_name", " ")
    one, two = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    # a part's terms take hundreds of times its bytes, and the sums per video hold all terms of a task
    cards = in_tasks(part.withColumn("video_id", key.cast("string")), part.count(), "video_id", a_task=25_000)
    return cards.select(
        F.col("p_size").alias("snapshot_id"), "video_id",
        F.when(key % 2 == 0, "home").otherwise("up_next").alias("surface"),
        (key % 20 + 1).alias("position"), F.col("p_name").alias("title"),
        F.concat_ws(" ", "p_brand", F.concat(F.lit("#"), two)).alias("description"),
        F.array(one, F.concat(F.lit("#"), two), F.concat(F.lit("zzz "), one), F.concat(F.lit("none"), key % 3)).alias("tags"),
        F.array(F.concat(F.lit("https://example.org/wiki/"), F.col("p_type"), F.lit("_x"))).alias("youtube_topics"),
        F.array(F.struct(F.col("p_type").alias("id"), F.col("p_type").alias("name"), F.lit(1.0).alias("share"))).alias("categories"),
        F.create_map(
            F.col("p_type"),
            F.array(F.struct(F.col("p_brand").alias("phrase")), F.struct(F.lit("42").alias("phrase"))),
        ).alias("evidence"),
        wt.rank_weight(key % 20 + 1).alias("weight"),
    )


def _term_columns(extra=()):
    return ["key", "score", "consistency", "video_support", *extra]


@bound("term_map", f"""
WITH {_tagged(0.40, 1.15, 1.20, 0.80)},
agg AS (SELECT snapshot_id, category_id, key, round_even(CAST(sum(score) AS DOUBLE), 4) AS score, round_even(CAST(sum(cons * score) / sum(score) AS DOUBLE), 4) AS consistency,
          count(DISTINCT video_id) AS video_support FROM trow WHERE length(key) >= 2 GROUP BY ALL)
SELECT * FROM agg QUALIFY row_number() OVER (PARTITION BY snapshot_id, category_id ORDER BY score DESC, video_support DESC, consistency DESC, key) <= 15
""")
def term_map(spark, sf_dir):
    rows = tm.card_terms(term_cards(spark, sf_dir), GROUP, 0.40, 1.15, 1.20, 0.80)
    scope = ["snapshot_id", "category_id"]
    return tm.rank_snapshot(tm.aggregate(rows, scope), scope, 15).select(*scope, *_term_columns())


@bound("term_map_global", f"""
WITH {_tagged(0.40, 1.15, 1.20, 0.80)},
agg AS (SELECT snapshot_id, key, round_even(CAST(sum(score) AS DOUBLE), 4) AS score, round_even(CAST(sum(cons * score) / sum(score) AS DOUBLE), 4) AS consistency,
          count(DISTINCT video_id) AS video_support, round_even(CAST(coalesce(sum(score) FILTER (source = 'creator_tag'), 0) AS DOUBLE), 4) AS from_tags
        FROM trow WHERE length(key) >= 2 GROUP BY ALL)
SELECT * FROM agg QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY score DESC, video_support DESC, consistency DESC, key) <= 40
""")
def term_map_global(spark, sf_dir):
    rows = tm.card_terms(term_cards(spark, sf_dir), GROUP, 0.40, 1.15, 1.20, 0.80)
    out = tm.rank_snapshot(tm.aggregate(rows, GROUP), GROUP, 40)
    return out.select(*GROUP, *_term_columns(), wt.round_even(F.col("source_creator_tag"), 4).alias("from_tags"))


@bound("term_maps", f"""
WITH {_tagged(0.40, 1.15, 1.20, 0.80)},
agg AS (SELECT snapshot_id, category_id, key, grouping(category_id) AS o, round_even(CAST(sum(score) AS DOUBLE), 4) AS score,
    round_even(CAST(sum(cons * score) / sum(score) AS DOUBLE), 4) AS consistency, count(DISTINCT video_id) AS video_support
  FROM trow WHERE length(key) >= 2 GROUP BY GROUPING SETS ((snapshot_id, category_id, key), (snapshot_id, key)))
SELECT CASE WHEN o = 1 THEN 'outer' ELSE 'inner' END AS level, snapshot_id, category_id, key, score, consistency, video_support FROM agg
QUALIFY row_number() OVER (PARTITION BY o, snapshot_id, category_id ORDER BY score DESC, video_support DESC, consistency DESC, key) <= CASE WHEN o = 1 THEN 40 ELSE 15 END
""")
def term_maps(spark, sf_dir):
    """Both term maps of a snapshot, by category and overall, from one scan."""
    rows = tm.card_terms(term_cards(spark, sf_dir), GROUP, 0.40, 1.15, 1.20, 0.80)
    return tm.in_two_scopes(rows, GROUP).select("level", "snapshot_id", "category_id", *_term_columns())


@bound("session_terms", f"""
WITH {_tagged(0.35, 1.10, 1.15, None)},
agg AS (SELECT snapshot_id, key, sum(score) AS s, sum(cons * score) / sum(score) AS c, count(DISTINCT video_id) AS video_support,
          count(DISTINCT surface) >= 2 AS cross_surface FROM trow WHERE length(key) >= 2 GROUP BY ALL),
fin AS (SELECT snapshot_id, key, round_even(CAST(s * CASE WHEN cross_surface THEN 1.12 ELSE 1.0 END AS DOUBLE), 4) AS score,
          round_even(CAST(c AS DOUBLE), 4) AS consistency, video_support, cross_surface FROM agg WHERE c >= 0.45)
SELECT * FROM fin QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY cross_surface DESC, score DESC, video_support DESC, consistency DESC, key) <= 36
""")
def session_terms(spark, sf_dir):
    rows = tm.card_terms(term_cards(spark, sf_dir), GROUP, 0.35, 1.10, 1.15)
    out = tm.rank_session(tm.aggregate(rows, GROUP), GROUP, 36, 0.45)
    return out.select(*GROUP, *_term_columns(["cross_surface"]))


@bound("directions", f"""
WITH {ITEMS}, {_MIX}, {_tagged(0.40, 1.15, 1.20, 0.80)},
tq AS (SELECT category_id, sum(consistency * score) / sum(score) AS tc FROM (
   SELECT category_id, key, round_even(CAST(sum(score) AS DOUBLE), 4) AS score, round_even(CAST(sum(cons * score) / sum(score) AS DOUBLE), 4) AS consistency
   FROM trow WHERE source = 'creator_tag' GROUP BY ALL) GROUP BY ALL),
dr AS (SELECT z.snapshot_id, z.category_id, zone, z.rank AS r0, z.demand, fresh, z.share / top AS fit, least(1.0, greatest(0.0, 0.70 * quality + 0.30 * coalesce(tc, 0.5))) AS coherence, intent_id
       FROM zoned z LEFT JOIN tq USING (category_id) LEFT JOIN (SELECT * FROM mix WHERE rank = 1) m ON z.snapshot_id = m.snapshot_id AND z.category_id = m.category_id),
sc AS (SELECT *, least(1.0, greatest(0.0, 0.50 * fit + 0.25 * demand + 0.10 * fresh + 0.15 * coherence)) AS opportunity FROM dr)
SELECT snapshot_id, category_id, zone, round(coherence, 6) AS coherence, round(opportunity, 6) AS opportunity,
  concat_ws(' · ', category_id, CASE intent_id WHEN 'news' THEN 'Tin tức' ELSE intent_id END) AS direction FROM sc
""")
def directions(spark, sf_dir):
    rows = tm.card_terms(term_cards(spark, sf_dir), [], 0.40, 1.15, 1.20, 0.80).filter("source = 'creator_tag'")
    tags = tm.rank_snapshot(tm.aggregate(rows, ["category_id"]), ["category_id"], None)
    rows_ = ex.contributions(items(spark, sf_dir), GROUP)
    per_snapshot = ex.distribution(ex.measures(rows_, GROUP), GROUP)
    out = ex.directions(per_snapshot, tags, ex.intent_mix(rows_, GROUP), GROUP)
    return out.select("snapshot_id", "category_id", "zone", _r("coherence"), _r("opportunity"), "direction")
