"""Cohort operators over user vectors, node statistics over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlane.bindings import bound, table
from driftlane.bindings.events import EV, events
from driftlane.functions import weights as wt
from driftlane.operators import cohort as co
from driftlane.operators import nodes as nd

VEC = EV + """,
v0 AS (SELECT user_id AS profile_id, k % 18 AS key, sum(value) AS v FROM ev GROUP BY ALL),
vec AS (SELECT profile_id, key, v / sum(v) OVER (PARTITION BY profile_id) AS weight FROM v0),
n AS (SELECT count(DISTINCT profile_id) AS n FROM vec)
"""


def vectors(spark, sf_dir):
    sums = events(spark, sf_dir).groupBy(F.col("user_id").alias("profile_id"), (F.col("k") % 18).alias("key")).agg(
        F.sum("value").alias("v")
    )
    return wt.share_in_group(sums, ["profile_id"], "v", "weight").drop("v")


def profiles(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.col("user_id").alias("profile_id")).agg(F.count("*").alias("events"))


def _r(name, digits=6):
    return F.round(name, digits).alias(name)


@bound("mean_vector", f"""
WITH {VEC} SELECT key, round_even(CAST(sum(weight) / max(n) AS DOUBLE), 6) AS mean_weight,
  round_even(CAST(count(*) FILTER (weight >= 0.05) / max(n) AS DOUBLE), 6) AS presence_rate FROM vec, n GROUP BY key
""")
def mean_vector(spark, sf_dir):
    return co.mean_vector(vectors(spark, sf_dir), profiles(spark, sf_dir))


ROLES = """
rk AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY weight DESC, key) AS rank, max(weight) OVER (PARTITION BY profile_id) AS top,
         key % 9 = 0 AS x FROM vec),
st AS (SELECT *, NOT x AND (rank = 1 OR weight >= greatest(0.20, top * 0.62)) AS strong FROM rk),
sf AS (SELECT *, sum(CASE WHEN strong THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id ORDER BY weight DESC, key) AS so_far FROM st),
roles AS (SELECT *, CASE WHEN x THEN 'exploration' WHEN strong AND so_far <= 2 THEN 'primary'
            WHEN weight >= greatest(0.055, top * 0.16) THEN 'secondary' ELSE 'low' END AS role FROM sf),
fix AS (SELECT *, NOT bool_or(role = 'primary') OVER (PARTITION BY profile_id) AND rank = 1 AS also_primary FROM roles)
"""


def _roles(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return co.partition_interests(v, v.filter(F.col("key") % 9 == 0))


@bound("interest_partition", f"WITH {VEC}, {ROLES} SELECT profile_id, key, role, also_primary FROM fix")
def interest_partition(spark, sf_dir):
    return _roles(spark, sf_dir).select("profile_id", "key", "role", "also_primary")


@bound("role_counts", f"""
WITH {VEC}, {ROLES},
lng AS (SELECT key, role FROM fix WHERE role IN ('primary', 'exploration') UNION ALL SELECT key, 'primary' FROM fix WHERE also_primary)
SELECT role, key, count(*) AS profiles, round_even(CAST(count(*) / max(n) AS DOUBLE), 6) AS rate FROM lng, n GROUP BY role, key
""")
def role_counts(spark, sf_dir):
    return co.role_counts(_roles(spark, sf_dir), profiles(spark, sf_dir))


@bound("cointerest_pairs", f"""
WITH {VEC}, p AS (SELECT * FROM vec WHERE weight >= 0.05)
SELECT a.key AS left, b.key AS right, count(*) AS profiles, round_even(CAST(count(*) / max(n) AS DOUBLE), 6) AS rate
FROM p a JOIN p b ON a.profile_id = b.profile_id AND a.key < b.key, n GROUP BY a.key, b.key ORDER BY profiles DESC, a.key, b.key LIMIT 30
""")
def cointerest_pairs(spark, sf_dir):
    return co.cointerest_pairs(vectors(spark, sf_dir), profiles(spark, sf_dir))


EDGES_SQL = """
e0 AS (SELECT DISTINCT k % 20 AS src, (k * 7 + 1) % 20 AS dst, (k % 10) / 10.0 AS weight, k % 3 = 0 AS both_ways FROM ev),
e1 AS (SELECT src, dst, weight FROM e0 WHERE src <> dst AND weight > 0 UNION ALL SELECT dst, src, weight FROM e0 WHERE src <> dst AND weight > 0 AND both_ways),
edges AS (SELECT src, dst, max(weight) AS weight FROM e1 WHERE src < 18 AND dst < 18 GROUP BY ALL)
"""


def edges(spark, sf_dir):
    k = F.col("k")
    ev = events(spark, sf_dir)
    raw = ev.select(
        (k % 20).alias("src"), ((k * 7 + 1) % 20).alias("dst"), ((k % 10) / 10).alias("weight"), (k % 3 == 0).alias("both_ways")
    ).distinct()
    return co.symmetric_edges(raw, ev.select((k % 18).alias("key")).distinct())


@bound("relation_edges", f"WITH {EV}, {EDGES_SQL} SELECT src, dst, round(weight, 4) AS weight FROM edges")
def relation_edges(spark, sf_dir):
    return edges(spark, sf_dir).select("src", "dst", _r("weight", 4))


@bound("adjacent_expansion", f"""
WITH {VEC}, {EDGES_SQL},
t3 AS (SELECT * FROM vec QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY weight DESC, key) <= 3),
x AS (SELECT profile_id, dst AS key, sum(t3.weight * edges.weight) AS expansion FROM t3 JOIN edges ON t3.key = src GROUP BY ALL)
SELECT x.profile_id, x.key, round(expansion, 6) AS expansion FROM x LEFT JOIN vec ON x.profile_id = vec.profile_id AND x.key = vec.key
WHERE coalesce(vec.weight, 0) < 0.02
""")
def adjacent_expansion(spark, sf_dir):
    return co.adjacent_expansion(vectors(spark, sf_dir), edges(spark, sf_dir)).select("profile_id", "key", _r("expansion"))


@bound("mean_preferences", """
SELECT round_even(avg(coalesce(c_acctbal, 0)), 6) AS mean_c_acctbal, round_even(avg(CAST(c_nationkey AS DOUBLE)), 6) AS mean_c_nationkey FROM customer
""")
def mean_preferences(spark, sf_dir):
    return co.mean_preferences(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"])


@bound("vector_problems", f"""
WITH {VEC}, part_ AS (SELECT profile_id, sum(weight) AS t FROM vec WHERE NOT (profile_id % 3 = 0 AND key = 5) AND profile_id % 10 <> 0 GROUP BY ALL),
u AS (SELECT DISTINCT profile_id FROM vec)
SELECT profile_id, CASE WHEN t IS NULL THEN 'category_vector is empty' ELSE 'category_vector must sum to 1' END AS problem
FROM u LEFT JOIN part_ USING (profile_id) WHERE t IS NULL OR abs(t - 1) > 1e-5
""")
def vector_problems(spark, sf_dir):
    damaged = vectors(spark, sf_dir).filter(~((F.col("profile_id") % 3 == 0) & (F.col("key") == 5)) & (F.col("profile_id") % 10 != 0))
    return co.vector_problems(damaged, profiles(spark, sf_dir)).select("profile_id", "problem")


# ------------------------------------------------------------------------- nodes
@bound("node_histograms", """
WITH f AS (SELECT 'class_name' AS field, role AS value FROM conversations UNION ALL SELECT 'view_id', CAST(turn AS VARCHAR) FROM conversations
           UNION ALL SELECT 'text', text FROM conversations WHERE text <> '')
SELECT * FROM (SELECT field, value, count(*) AS n FROM f GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 30
""")
def node_histograms(spark, sf_dir):
    nodes = table(spark, sf_dir, "conversations").select(
        F.col("role").alias("class_name"), F.col("turn").alias("view_id"), "text"
    )
    return nd.histograms(nodes, ["class_name", "view_id", "text"]).select("field", "value", "n")


def trees(spark, sf_dir):
    """A node tree per document: one node per line."""
    lines = F.split("text", "\n")
    node = lambda line, i: F.struct(
        (i % 25).alias("depth"), F.when(F.length(line) % 3 != 0, line).alias("text"),
        F.lit(None).cast("string").alias("content_description"),
        F.when(F.length(line) % 5 == 0, F.lit("row")).alias("view_id"), F.lit("View").alias("class_name"),
        (F.length(line) % 7 == 0).alias("selected"), (F.length(line) % 11 == 0).alias("scrollable"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(lines, node).alias("nodes"))


@bound("node_filter", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT *, nullif(substr(trim(regexp_replace(CASE WHEN length(line) % 3 <> 0 THEN line ELSE '' END, '\s+', ' ', 'g')), 1, 200), '') AS t FROM l
      WHERE (i - 1) % 25 <= 18),
kept AS (SELECT * FROM k WHERE t IS NOT NULL OR length(line) % 5 = 0 OR length(line) % 7 = 0 OR length(line) % 11 = 0),
firsts AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 450)
SELECT doc_id, count(*) AS nodes, substr(sha256(string_agg(concat(CAST((i - 1) % 25 AS VARCHAR), '|', CASE WHEN length(line) % 5 = 0 THEN 'row' ELSE '' END, '|',
  coalesce(t, ''), '||', CASE WHEN length(line) % 7 = 0 THEN 'true' ELSE 'false' END, ';'), '' ORDER BY i)), 1, 32) AS signature
FROM firsts GROUP BY doc_id
""")
def node_filter(spark, sf_dir):
    kept = trees(spark, sf_dir).select("doc_id", nd.keep_nodes(F.col("nodes")).alias("nodes")).filter(F.size("nodes") > 0)
    return kept.select(
        "doc_id", F.size("nodes").cast("bigint").alias("nodes"), nd.tree_signature(F.col("nodes")).alias("signature")
    )


@bound("device_inspection", """
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
v AS (SELECT 'view_id' AS section, CASE WHEN length(line) % 5 = 0 THEN 'row' END AS value FROM l
  UNION ALL SELECT 'class_name', 'View' FROM l UNION ALL SELECT 'text', CASE WHEN length(line) % 3 <> 0 THEN line END FROM l),
c AS (SELECT section, value, count(*) AS n FROM v WHERE coalesce(value, '') <> '' GROUP BY section, value
  QUALIFY row_number() OVER (PARTITION BY section ORDER BY count(*) DESC, value) <= 20)
SELECT * FROM c
UNION ALL SELECT 'snapshots', NULL, count(*) FROM documents UNION ALL SELECT 'nodes', NULL, count(*) FROM l
UNION ALL SELECT 'surface', CASE WHEN source = 'src3' THEN 'unknown' ELSE source END, count(*) FROM documents GROUP BY ALL
""")
def device_inspection(spark, sf_dir):
    """Every document as a device snapshot, with its lines as nodes and its source as guessed surface."""
    guess = F.struct(F.when(F.col("source") != "src3", F.col("source")).otherwise("").alias("surface"))
    snapshots = trees(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", guess.alias("surface_guess")), "doc_id")
    return nd.inspection(snapshots, {"view_id": "view_id", "class_name": "class_name", "text": "text"}, 20)


LABELS = """CASE event_type WHEN 'view' THEN 'Home' WHEN 'click' THEN 'Search shorts' WHEN 'purchase' THEN 'Save and share'
  WHEN 'signup' THEN 'Subscriptions' ELSE 'nothing here' END"""


@bound("surface_guess", f"""
WITH {EV},
nodes AS (SELECT user_id, day, event_id AS place, lower(concat({LABELS}, ' ', CASE WHEN k % 4 = 0 THEN 'pivot_bar' ELSE 'player_view' END)) AS hay,
            k % 4 = 0 AS piv, k % 5 = 0 AS sel FROM ev),
tok(no, surface, token, w) AS (VALUES (0, 'watch', 'comments', 0.16), (2, 'watch', 'share', 0.16), (4, 'watch', 'save', 0.16),
  (8, 'subscriptions', 'subscriptions', 0.34), (10, 'home', 'home', 0.34), (12, 'shorts', 'shorts', 0.42), (13, 'search', 'search', 0.38)),
h AS (SELECT user_id, day, place, no, surface, w + CASE WHEN sel THEN 0.26 ELSE 0 END + CASE WHEN piv THEN 0.08 ELSE 0 END AS w FROM nodes JOIN tok ON contains(hay, token)
      UNION ALL SELECT user_id, day, place, 1000, 'watch', 0.24 FROM nodes WHERE NOT piv),
s AS (SELECT user_id, day, surface, round(CAST(sum(w) AS DOUBLE), 9) AS score, min(place * 10000 + no) AS first FROM h GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY score DESC, first) AS rank FROM s),
b AS (SELECT user_id, day, max(surface) FILTER (rank = 1) AS surface, max(score) FILTER (rank = 1) AS score, coalesce(max(score) FILTER (rank = 2), 0) AS ru FROM r GROUP BY ALL)
SELECT user_id, CAST(day AS VARCHAR) AS day, coalesce(surface, 'unknown') AS surface,
  coalesce(round(least(0.95, greatest(0.15, 0.30 + score * 0.35 + greatest(0, score - ru) * 0.25)) + 1e-9, 6), 0.15) AS confidence
FROM (SELECT DISTINCT user_id, day FROM ev) LEFT JOIN b USING (user_id, day)
""")
def surface_guess(spark, sf_dir):
    k = F.col("k")
    nodes = events(spark, sf_dir).select(
        "user_id", F.col("day").cast("string").alias("day"), F.col("event_id").alias("place"), F.expr(LABELS).alias("text"),
        F.lit(None).cast("string").alias("content_description"),
        F.when(k % 4 == 0, "pivot_bar").otherwise("player_view").alias("view_id"), (k % 5 == 0).alias("selected"),
    )
    return nd.guess_surface(nodes, ["user_id", "day"]).select(
        "user_id", "day", "surface", F.round(F.col("confidence") + 1e-9, 6).alias("confidence")
    )
