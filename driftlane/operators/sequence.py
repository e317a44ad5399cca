"""Previous-row logic for groups of any size.

A group is cut into time buckets. Inside a bucket the previous row is a plain
window; the first row of a bucket takes the last value of the bucket before it
from a table with one row per group and bucket. A profile with a third of all
rows is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlane.functions.plan import micros


def with_previous(
    df: DataFrame, group: list[str], time: str, tie: list[str], value: Column, out: str,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Adds ``out``: ``value`` of the row before, in order of time and tie."""
    rows = df.withColumns(
        {"_value": value, "_bucket": F.floor(micros(time) / (bucket_seconds * 1_000_000))}
    )
    part = [*group, "_bucket"]
    order = W.partitionBy(*part).orderBy(time, *tie)
    rows = rows.withColumns(
        {"_lag": F.lag("_value").over(order), "_first": F.row_number().over(order) == 1}
    )
    last = df.withColumns(
        {"_value": value, "_bucket": F.floor(micros(time) / (bucket_seconds * 1_000_000))}
    ).groupBy(*part).agg(F.max_by(F.struct("_value"), F.struct(time, *tie)).alias("_end"))
    carried = last.withColumn("_carry", F.lag("_end").over(W.partitionBy(*group).orderBy("_bucket"))).drop("_end")
    joined = rows.join(carried, part, "left")
    prev = F.when(F.col("_first"), F.col("_carry._value")).otherwise(F.col("_lag"))
    return joined.withColumn(out, prev).drop("_value", "_bucket", "_lag", "_first", "_carry")
