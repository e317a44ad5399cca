"""Writers: partitioned appends, same-day replacement, current-state tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.functions import identity
from driftlane.operators import ingest
from driftlane.plans.staging import stage


def with_hashed_ids(rows: DataFrame) -> DataFrame:
    """Pseudonymous participant, device and profile columns for storage."""
    return rows.withColumns(
        {
            "participant_hash": identity.short_hash(F.col("participant_id"), 12),
            "device_hash": identity.short_hash(F.col("device_id"), 12),
            "profile_hash": identity.short_hash(F.col("profile_id"), 16),
        }
    )


def append_by_day(rows: DataFrame, path: str) -> None:
    """Appends to a table partitioned by day; hashes stay data columns, so a
    day has as many files as tasks wrote it, not one per profile."""
    rows.write.mode("append").partitionBy("day").parquet(path)


def replace_days(rows: DataFrame, path: str, profile: list[str] = ("profile_id",)) -> None:
    """Replaces the stored rows of the (profile, day) pairs that ``rows`` has.

    Other profiles of a touched day are kept: the touched day partitions are read,
    what the rows replace is left out, and both are written together. Partitions
    change when the write commits; days without new rows are not read.
    """
    spark = rows.sparkSession
    rows = stage(rows)
    pair = [*profile, "day"]
    days = [r["day"] for r in rows.select("day").distinct().collect()]
    known = stored(spark, path)
    if known is not None and days:
        rest = known.filter(F.col("day").isin(days)).join(rows.select(*pair).distinct(), pair, "left_anti")
        rows = rows.unionByName(rest.withColumn("day", F.col("day").cast(rows.schema["day"].dataType)), allowMissingColumns=True)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table written so far, or None while there is no data file."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def latest_collection(
    rows: DataFrame, keys: tuple = ("profile_id", "day"), recorded: str = "recorded_at", tie: str | None = "session_id"
) -> DataFrame:
    """Rows of the newest collection per profile and day.

    Of collections recorded at one time the last by ``tie`` counts, where the rows
    have it. The newest per key is a partial + final aggregate; rows of older
    collections fall out in the join.
    """
    order = [recorded, *([tie] if tie in rows.columns else [])]
    newest = rows.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_newest")).select(*keys, *[F.col(f"_newest.{c}").alias(f"_{c}") for c in order])
    marked = newest.select(*[F.col(k).alias(f"_{k}") for k in keys], *[f"_{c}" for c in order])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*keys, *order]]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return rows.join(marked, condition, "left_semi")


def upsert_latest(current: DataFrame | None, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Next state of a current table; the caller writes it to a new version."""
    rows = incoming if current is None else current.unionByName(incoming)
    return ingest.latest(rows, keys, order)


def append_history(rows: DataFrame, path: str, run_id: str) -> None:
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
