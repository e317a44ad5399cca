"""Repeat-open suppression on a stream: one remembered video per profile.

``start`` runs the batch operator on each micro-batch, with the last open of every profile in a
versioned table; a profile of any size is spread over time buckets. ``drop_repeat_opens`` keeps the
state in the streaming engine instead and suits streams whose profiles are small in a batch.
"""

from __future__ import annotations

import os
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftlane.operators import ingest
from driftlane.sources import current

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = "profile_id string, event_id string, captured_at string, video_id string"


def _keep_changes(key, batches, state: GroupState):
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["captured_at", "event_id"])
    before = rows["video_id"].shift(fill_value=last if last is not None else "")
    kept = rows[rows["video_id"] != before]
    if len(rows):
        state.update((rows["video_id"].iloc[-1],))
    yield kept[["profile_id", "event_id", "captured_at", "video_id"]]


def drop_repeat_opens(opens: DataFrame) -> DataFrame:
    """Opens of another video than the profile's open before; the state is one
    string per profile."""
    rows = opens.filter("coalesce(video_id, '') <> ''").select("profile_id", "event_id", "captured_at", "video_id")
    return rows.groupBy("profile_id").applyInPandasWithState(
        _keep_changes, OUTPUT, "video_id string", "append", GroupStateTimeout.NoTimeout
    )


def write_batch(opens: DataFrame, root: str, batch: int = 0, bucket_seconds: int = 3600) -> None:
    """Writes the opens of a batch that repeat no open before them to ``opens/batch=<n>``.

    ``opens`` has profile_id, event_id, captured_at, video_id. The last open of each profile lies in a current
    table and stands before the batch's own. It is updated after the opens are written: a batch lost between
    the two writes its opens again, a batch that the table contains changes nothing.
    """
    spark, state = opens.sparkSession, os.path.join(root, "last_open")
    at = current.version(spark, state)
    if at is not None and at["batches"].get("opens", -1) >= batch:
        return
    rows = opens.filter("coalesce(video_id, '') <> ''").select(
        "profile_id", "event_id", "captured_at", "video_id", F.to_timestamp("captured_at").alias("_time"), F.lit(True).alias("_new"))
    known = current.read(spark, state)
    every = rows
    if known is not None:
        # before all that is new, whatever its own time: batches are taken in the order they come
        first = rows.groupBy("profile_id").agg(F.min("_time").alias("_first"))
        before = known.drop("arrival").join(first, "profile_id").withColumn("_time", F.col("_first") - F.expr("interval 1 microsecond")).drop("_first")
        every = rows.unionByName(before.withColumn("_new", F.lit(False)))
    kept = ingest.drop_repeat_opens(every, ["profile_id"], "_time", ["event_id"], "video_id", bucket_seconds).filter("_new")
    kept.select("profile_id", "event_id", "captured_at", "video_id").write.mode("overwrite").parquet(os.path.join(root, "opens", f"batch={batch}"))
    newest = rows.drop("_time", "_new").withColumn("arrival", F.lit(batch).cast("bigint"))
    current.update(newest, state, ["profile_id"], ["arrival", "captured_at", "event_id"], "opens", batch)


def start(opens: DataFrame, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    writer = opens.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: write_batch(df, root, batch))
    return (writer.trigger(availableNow=True) if once else writer).start()
