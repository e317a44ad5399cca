"""Cohort statistics and interest-graph expansion over profile vectors.

Vectors are long rows (profile_id, key, weight); keys per profile are bounded by
the dictionary, profiles are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlane.functions import weights as wt

PRESENT = 0.05


def symmetric_edges(edges: DataFrame, categories: DataFrame) -> DataFrame:
    """Known ids only, no self-loops, positive weights; two-way edges mirrored,
    the heaviest edge per pair kept. ``categories``: one column ``key``."""
    good = edges.filter((F.col("src") != F.col("dst")) & (F.col("weight") > 0))
    mirrored = good.filter("both_ways").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    both = good.select("src", "dst", "weight").unionByName(mirrored)
    for end in ("src", "dst"):
        both = both.join(categories.select(F.col("key").alias(end)), end, "left_semi")
    return both.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def mean_vector(vectors: DataFrame, profiles: DataFrame) -> DataFrame:
    """Mean weight over all profiles (absent = 0) and presence rate per key."""
    n = profiles.agg(F.count("*")).scalar()
    return vectors.groupBy("key").agg(
        F.sum("weight").alias("_s"), F.count_if(F.col("weight") >= PRESENT).alias("_p")
    ).select(
        "key", wt.round_even(F.col("_s") / n, 6).alias("mean_weight"),
        wt.round_even(F.col("_p") / n, 6).alias("presence_rate"),
    )


def partition_interests(vectors: DataFrame, exploration: DataFrame | None = None) -> DataFrame:
    """Role of every interest: up to two primary, then secondary, low; keys in
    ``exploration`` (profile_id, key) get that role and do not rank."""
    rows = vectors
    if exploration is not None:
        marked = exploration.select("profile_id", "key", F.lit(True).alias("_x"))
        rows = rows.join(marked, ["profile_id", "key"], "left")
    else:
        rows = rows.withColumn("_x", F.lit(None).cast("boolean"))
    whole = W.partitionBy("profile_id")
    order = whole.orderBy(F.desc("weight"), F.asc("key"))
    rows = rows.withColumns(
        {"rank": F.row_number().over(order), "_top": F.max("weight").over(whole), "_x": F.coalesce("_x", F.lit(False))}
    )
    w, top = F.col("weight"), F.col("_top")
    strong = ~F.col("_x") & ((F.col("rank") == 1) | (w >= F.greatest(F.lit(0.20), top * 0.62)))
    rows = rows.withColumn("_strong", strong)
    so_far = F.sum(F.col("_strong").cast("int")).over(order)
    role = (
        F.when(F.col("_x"), "exploration")
        .when(F.col("_strong") & (so_far <= 2), "primary")
        .when(w >= F.greatest(F.lit(0.055), top * 0.16), "secondary")
        .otherwise("low")
    )
    rows = rows.withColumn("role", role)
    # a profile whose top key explores still gets it as its primary interest
    none = ~F.bool_or(F.col("role") == "primary").over(whole) & (F.col("rank") == 1)
    return rows.withColumn("also_primary", none).drop("_x", "_top", "_strong")


def role_counts(partitioned: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles per primary and exploration key, with their rate."""
    n = profiles.agg(F.count("*")).scalar()
    roles = F.filter(
        F.array(F.col("role"), F.when(F.col("also_primary"), "primary")),
        lambda r: r.isin("primary", "exploration"),
    )
    rows = partitioned.select("key", F.explode(roles).alias("role"))
    return rows.groupBy("role", "key").agg(F.count("*").alias("profiles")).withColumn(
        "rate", wt.round_even(F.col("profiles") / n, 6)
    )


def cointerest_pairs(vectors: DataFrame, profiles: DataFrame, k: int = 30) -> DataFrame:
    """Most frequent unordered pairs of present interests.

    A profile's present keys (at most 20, as each holds 5 % or more) are paired
    inside its own array; no self-join, and the shuffle only carries counts.
    """
    n = profiles.agg(F.count("*")).scalar()
    present = vectors.filter(F.col("weight") >= PRESENT).groupBy("profile_id").agg(
        F.array_sort(F.collect_set("key")).alias("_keys")
    )
    later = F.transform(
        "_keys",
        lambda a, i: F.transform(
            F.slice("_keys", i + 2, F.greatest(F.size("_keys") - i - 1, F.lit(0))),
            lambda b: F.struct(a.alias("left"), b.alias("right")),
        ),
    )
    pairs = present.select(F.explode(F.flatten(later)).alias("p")).groupBy("p.left", "p.right").agg(
        F.count("*").alias("profiles")
    )
    return pairs.withColumn("rate", wt.round_even(F.col("profiles") / n, 6)).orderBy(
        F.desc("profiles"), F.asc("left"), F.asc("right")
    ).limit(k)


def adjacent_expansion(vectors: DataFrame, edges: DataFrame, leading: int = 3, weak: float = 0.02) -> DataFrame:
    """Neighbours of a profile's leading interests that it hardly shows.

    Strength x edge weight, summed per target. Edges have two dictionary ids as
    key; their join is left to the optimizer, which broadcasts by measured size.
    """
    top = wt.top_k(vectors, ["profile_id"], [F.desc("weight"), F.asc("key")], leading)
    reach = top.select("profile_id", F.col("key").alias("src"), F.col("weight").alias("_strength")).join(edges, "src")
    summed = reach.groupBy("profile_id", F.col("dst").alias("key")).agg(
        F.sum(F.col("_strength") * F.col("weight")).alias("expansion")
    )
    own = vectors.select("profile_id", "key", F.col("weight").alias("_own"))
    return summed.join(own, ["profile_id", "key"], "left").filter(
        F.coalesce("_own", F.lit(0.0)) < weak
    ).drop("_own")


def mean_preferences(profiles: DataFrame, columns: list[str]) -> DataFrame:
    return profiles.agg(*[wt.round_even(F.avg(F.coalesce(c, F.lit(0.0))), 6).alias(f"mean_{c}") for c in columns])


def vector_problems(vectors: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles with no vector or one that does not sum to 1."""
    sums = vectors.groupBy("profile_id").agg(F.sum("weight").alias("total"))
    checked = profiles.select("profile_id").join(sums, "profile_id", "left")
    problem = F.when(F.col("total").isNull(), "category_vector is empty").when(
        F.abs(F.col("total") - 1.0) > 1e-5, "category_vector must sum to 1"
    )
    return checked.withColumn("problem", problem).filter(F.col("problem").isNotNull())
