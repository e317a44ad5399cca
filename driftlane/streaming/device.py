"""Device snapshot stream: validation and exact de-duplication per day."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftlane.functions import identity
from driftlane.operators import ingest, validate
from driftlane.sources import readers, schemas, sinks
from driftlane.streaming.interactions import batch_days, quarantine

KEYS = ["participant_id", "device_id", "profile_slot", "day", "tree_signature"]


def write_batch(lines: DataFrame, root: str, batch: int = 0) -> None:
    """Appends envelopes whose tree is new for its device, slot and day.

    Unreadable lines, invalid envelopes and impossible dates go to the quarantine.
    """
    parsed = readers.parse_lines(lines.select("value"), schemas.DEVICE_ENVELOPE)
    rows = parsed.select("value", "_row", "_row.*", "_keys")
    day = identity.event_day(F.col("snapshot.captured_at"))
    found = F.when(F.col("_row").isNull(), F.array(F.lit("payload must be an object"))).otherwise(
        F.concat(validate.device_errors(F.col("_keys")), F.when(day.isNull(), F.array(F.lit("invalid snapshot day"))).otherwise(F.array().cast("array<string>")))
    )
    checked = rows.withColumn("errors", found).drop("_keys", "_row")
    valid, bad = validate.split(checked)
    quarantine(bad, os.path.join(root, "device_quarantine"), batch)
    keyed = valid.drop("value").withColumns({"day": day, "tree_signature": F.col("snapshot.tree_signature")})
    fresh = ingest.dedup_signature(keyed, KEYS, ["sent_at"])
    path = os.path.join(root, "device_snapshots")
    known = sinks.stored(lines.sparkSession, path)
    if known is not None:
        days = batch_days(keyed)
        fresh = fresh.join(known.filter(F.col("day").isin(days)).select(*KEYS), KEYS, "left_anti")
    sinks.append_by_day(fresh, path)


def start(lines: DataFrame, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, batch: write_batch(df, root, batch)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
