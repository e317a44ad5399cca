"""Submission stream: validation, quarantine, and the newest submission of every participant and profile."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftlane.operators import validate
from driftlane.sources import current, readers, schemas
from driftlane.streaming.interactions import quarantine

KEYS = ["participant_id", "profile_key"]
#: What arrives later replaces what came before; within a batch the date of the submission decides.
ORDER = ["arrival", "updated_at"]


def write_batch(lines: DataFrame, root: str, batch: int = 0) -> None:
    """Takes the valid submissions of a batch into the current table; a repeated batch changes nothing."""
    parsed = readers.parse_lines(lines.select("value"), schemas.SUBMISSION)
    rows = parsed.select("value", "_row", "_row.*", "_keys")
    found = F.when(F.col("_row").isNull(), F.array(F.lit("payload must be an object"))).otherwise(validate.submission_errors(F.col("_keys")))
    valid, bad = validate.split(rows.withColumn("errors", found).drop("_keys", "_row"))
    quarantine(bad, os.path.join(root, "submission_quarantine"), batch)
    kept = valid.drop("value", "errors").withColumn("arrival", F.lit(batch).cast("bigint"))
    current.update(kept, os.path.join(root, "submissions"), KEYS, ORDER, "submissions", batch)


def start(lines: DataFrame, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: write_batch(df, root, batch))
    return (writer.trigger(availableNow=True) if once else writer).start()


def submissions(spark: SparkSession, root: str) -> DataFrame | None:
    """The current submissions that a report can use; None before the first batch."""
    rows = current.read(spark, os.path.join(root, "submissions"))
    return None if rows is None else readers.usable_submission_rows(rows)
