"""Interaction stream: the batch functions inside ``foreachBatch``."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftlane.operators import interactions as ia
from driftlane.operators import validate
from driftlane.sources import readers, schemas, sinks

KEYS = [*ia.PROFILE, "day", "event_id"]
# Days are literals in the plan of a batch: a handful, late events included.
MAX_BATCH_DAYS = 2_000


def line_stream(spark: SparkSession, path: str, files_per_trigger: int = 1_000) -> DataFrame:
    """New text files of a folder as raw lines."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def drop_in_flight(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drops repeats that arrive close together, with state bounded by a
    watermark; the exact check against stored days follows per batch."""
    timed = events.withColumn("_arrival", F.try_to_timestamp("captured_at"))
    return timed.withWatermark("_arrival", delay).dropDuplicatesWithinWatermark(KEYS).drop("_arrival")


def drop_repeated_lines(lines: DataFrame, delay: str, arrival: Column | None = None) -> DataFrame:
    """Lines whose event did not arrive within ``delay`` before, with the state bounded by that delay.

    The watermark runs on the time of arrival (now, unless ``arrival`` names one that never
    goes back), not on the day of the event: a late event passes, and the exact check against its
    stored day decides. Lines that name no whole event are told apart by their text, so that
    all rejects reach the quarantine.
    """
    parts = [F.get_json_object("value", f"$.{c}") for c in (*ia.PROFILE, "event_id")]
    parts.append(F.left(F.get_json_object("value", "$.captured_at"), F.lit(10)))
    whole = parts[0].isNotNull()
    for p in parts[1:]:
        whole = whole & p.isNotNull()
    key = F.sha2(F.when(whole, F.to_json(F.array(*parts))).otherwise(F.col("value")), 256)
    timed = lines.withColumns({"_line": key, "_arrival": F.current_timestamp() if arrival is None else arrival})
    return timed.withWatermark("_arrival", delay).dropDuplicatesWithinWatermark(["_line"]).drop("_line", "_arrival")


def batch_days(rows: DataFrame) -> list:
    """Days of a batch, as literals that prune partitions; too many are an error."""
    days = [r["day"] for r in rows.select("day").distinct().limit(MAX_BATCH_DAYS + 1).collect()]
    if len(days) > MAX_BATCH_DAYS:
        raise ValueError(f"a batch touches over {MAX_BATCH_DAYS} days; lower maxFilesPerTrigger")
    return days


def quarantine(rows: DataFrame, path: str, batch: int) -> None:
    """Writes the rejected lines of a batch; a repeated batch replaces its own."""
    rows.select("value", "errors").write.mode("overwrite").parquet(os.path.join(path, f"batch={batch}"))


def write_batch(lines: DataFrame, root: str, batch: int = 0) -> None:
    """Validate, de-duplicate, append and refresh what a batch touches.

    Repeating a batch changes nothing: events already stored are left out, rejects
    replace those of the same batch, and the touched (profile, day) pairs are
    recomputed from the stored events. Late events need no special case, since
    their own day is recomputed. Ids are also stored hashed.
    """
    spark = lines.sparkSession
    events_path, daily_path, bad_path = (os.path.join(root, n) for n in ("events", "daily", "quarantine"))
    checked = validate.validate_events(readers.parse_lines(lines.select("value"), schemas.EVENT)).persist()
    try:
        valid, bad = validate.split(checked)
        quarantine(bad, bad_path, batch)
        rows = validate.sanitize_events(valid.select("_row.*"))
        days = batch_days(rows)
        if not days:
            return
        known = sinks.stored(spark, events_path)
        fresh = ia.dedup(rows, KEYS) if known is None else ia.new_events(rows, known.filter(F.col("day").isin(days)), KEYS)
        sinks.append_by_day(sinks.with_hashed_ids(fresh), events_path)
        pair = [*ia.PROFILE, "day"]
        written = sinks.stored(spark, events_path).filter(F.col("day").isin(days))
        touched = written.join(rows.select(*pair).distinct(), pair, "left_semi")
        sinks.replace_days(ia.daily(touched), daily_path, ia.PROFILE)
    finally:
        checked.unpersist()


def start(lines: DataFrame, root: str, checkpoint: str, once: bool = False, delay: str | None = None, arrival: Column | None = None) -> StreamingQuery:
    """Runs ``write_batch`` on a stream of lines; with ``delay``, repeats that close are dropped before the batch."""
    if delay is not None:
        lines = drop_repeated_lines(lines, delay, arrival)
    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, batch: write_batch(df, root, batch)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def summaries(spark: SparkSession, root: str, as_of, days: int) -> DataFrame:
    """Look-back window over the maintained daily table."""
    return ia.window(spark.read.parquet(os.path.join(root, "daily")), as_of, days)
