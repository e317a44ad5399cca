"""Views of the ``events`` table used by several bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.bindings import table
from driftlane.functions import weights as wt

CATEGORIES = 18

EV = """
ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(ts AS DATE) AS day,
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
"""

DAILY = EV + f""",
daily0 AS (SELECT user_id AS profile_id, day, k % {CATEGORIES} AS key, sum(value) AS v
           FROM ev GROUP BY ALL),
daily AS (SELECT profile_id, day, key,
                 round_even(CAST(v / sum(v) OVER (PARTITION BY profile_id, day) AS DOUBLE), 6) AS weight
          FROM daily0 WHERE v > 0),
asof AS (SELECT max(day) AS as_of FROM daily)
""".replace("asof AS", "evalday AS")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumns(
        {"day": F.to_date("ts"), "k": F.get_json_object("props", "$.k").cast("bigint")}
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily observations: profile = user, key = k % 18, weight = share of value."""
    sums = (
        events(spark, sf_dir)
        .groupBy(F.col("user_id").alias("profile_id"), "day", (F.col("k") % CATEGORIES).alias("key"))
        .agg(F.sum("value").alias("v"))
    )
    return wt.share_in_group(sums, ["profile_id", "day"], "v", "_w").select(
        "profile_id", "day", "key", wt.round_even(F.col("_w"), 6).alias("weight")
    )


SURFACE_OF_TYPE = {"view": "home", "click": "up_next", "purchase": "subscriptions"}
