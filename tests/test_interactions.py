import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from driftlane.operators import ingest, validate
from driftlane.operators import interactions as ia
from driftlane.sources import readers, schemas
from driftlane.streaming import device, interactions as stream, repeat_open


def event(n, kind="video_open", score=.25, day="2026-08-23", **more):
    return {
        "schema_version": "1.0.0", "event_id": f"event-{n:04d}", "participant_id": "participant-1", "device_id": "device-1",
        "profile_id": "profile-1", "platform": "browser", "captured_at": f"{day}T10:00:00Z", "event_type": kind,
        "engagement_score": score, "score_model": "natural_interaction_v1", "source": "natural_user_action",
        "video_id": "abc", "confidence": 1, **more,
    }


def checked(spark, *rows):
    lines = spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")
    return validate.validate_events(readers.parse_lines(lines, schemas.EVENT))


def test_daily_score_and_duplicates(spark):
    valid, _ = validate.split(checked(spark, event(1), event(2, "like", 1.0), event(2, "like", 1.0)))
    days = ia.daily(ia.dedup(validate.sanitize_events(valid.select("_row.*"))))
    row = ia.as_maps(days).first()
    assert (row.event_count, row.score_total) == (2, 1.25)
    assert row.event_counts == {"video_open": 1, "like": 1}
    assert row.video_open_subscription_counts == {"unknown": 1}


@pytest.mark.parametrize("change,message", [
    ({"schema_version": "2"}, "unsupported schema_version"), ({"platform": "tv"}, "invalid platform"),
    ({"event_type": "view"}, "invalid event_type"), ({"event_id": "short"}, "invalid event_id"),
    ({"captured_at": "soon"}, "invalid captured_at"), ({"engagement_score": 3}, "engagement_score outside [-2,2]"),
    ({"engagement_score": "x"}, "invalid engagement_score"), ({"confidence": 2}, "confidence outside [0,1]"),
    ({"channel_subscription_state": "maybe"}, "invalid channel_subscription_state"),
    ({"text": "typed"}, "comment/text content is forbidden: text"),
    ({"context": {"message": "x"}}, "comment/text content is forbidden in context"),
    ({"context": "x"}, "context must be an object"),
])
def test_each_rule(spark, change, message):
    assert checked(spark, {**event(1), **change}).first().errors == [message]


def test_missing_fields_and_broken_lines(spark):
    row = event(1)
    del row["source"], row["profile_id"]
    out = checked(spark, row, "not json").collect()
    assert out[0].errors[:2] == ["missing profile_id", "missing source"]
    assert out[1].errors == ["payload must be an object"]


def test_windows(spark):
    rows = [event(n, day=d) for n, d in enumerate(["2026-08-01", "2026-08-20", "2026-08-23", "2026-08-24"])]
    valid, _ = validate.split(checked(spark, *rows))
    days = ia.daily(validate.sanitize_events(valid.select("_row.*")))
    week, month = (ia.window(days, dt.date(2026, 8, 23), n).first() for n in (7, 30))
    assert (week.observed_days, week.event_count) == (2, 2)
    assert (month.observed_days, month.event_count) == (3, 3)


def test_stream_equals_batch(spark, tmp_path):
    rows = [event(n, day=f"2026-08-{20 + n % 4}") for n in range(12)]
    batches = [rows[:5] + [event(99, text="typed")], rows[3:9], rows[8:] + rows[:2]]
    source, root = tmp_path / "in", str(tmp_path / "tables")
    source.mkdir()
    for n, batch in enumerate(batches):
        (source / f"{n}.jsonl").write_text("\n".join(json.dumps(r) for r in batch))
    query = stream.start(stream.line_stream(spark, str(source), 1), root, str(tmp_path / "cp"), once=True)
    query.awaitTermination()
    got = spark.read.parquet(root + "/daily").orderBy("day").collect()
    valid, _ = validate.split(checked(spark, *rows))
    want = ia.daily(validate.sanitize_events(valid.select("_row.*"))).orderBy("day").collect()
    assert [(r.day, r.event_count, r.score_total) for r in got] == [(r.day, r.event_count, r.score_total) for r in want]
    assert spark.read.parquet(root + "/quarantine").count() == 1
    # replaying a batch changes nothing; a late event refreshes its own day only
    stream.write_batch(spark.read.text(str(source / "0.jsonl")), root)
    assert spark.read.parquet(root + "/events").count() == 12
    assert stream.summaries(spark, root, dt.date(2026, 8, 23), 30).first().event_count == 12


def test_in_flight_dedup(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jsonl").write_text("\n".join(json.dumps(event(n % 3)) for n in range(9)))
    lines = stream.line_stream(spark, str(source))
    parsed = readers.parse_lines(lines, schemas.EVENT).select("_row.*")
    out = stream.drop_in_flight(validate.sanitize_events(parsed))
    query = out.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == 3


def opens(spark, rows):
    start = dt.datetime(2026, 8, 23)
    return spark.createDataFrame(
        [(p, f"e{n:03d}", start + dt.timedelta(seconds=s), v) for n, (p, s, v) in enumerate(rows)],
        "profile_id string, event_id string, ts timestamp, video_id string",
    )


def test_repeat_opens_across_buckets(spark):
    rows = [("p", 0, "a"), ("p", 3000, "a"), ("p", 4000, "a"), ("p", 9000, "b"), ("p", 20000, "b"), ("p", 20001, "a"), ("q", 1, "a")]
    df = opens(spark, rows)
    for bucket in (1, 3600, 10 ** 6):
        out = ingest.drop_repeat_opens(df, ["profile_id"], "ts", ["event_id"], "video_id", bucket)
        assert sorted(r.event_id for r in out.collect()) == ["e000", "e003", "e005", "e006"]


def test_repeat_opens_on_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    schema = "profile_id string, event_id string, captured_at string, video_id string"
    for n, rows in enumerate([[("p", "e1", "1", "a"), ("p", "e2", "2", "a")], [("p", "e3", "3", "a"), ("p", "e4", "4", "b")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = repeat_open.drop_repeat_opens(df).writeStream.format("memory").queryName("kept").option(
        "checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.event_id for r in spark.table("kept").collect()) == ["e1", "e4"]


def test_watch_opens_equal_the_sequential_rule(spark):
    import random

    rng = random.Random(3)
    t, rows = 0.0, []
    for n in range(400):
        t += rng.choice([.5, 1.5, 3.0, 4.5, 60.0])
        rows.append((f"d{rng.randrange(2)}", n, t, rng.choice(["watch", "watch", "home"]), rng.random() < .7))
    start = dt.datetime(2026, 8, 23)
    df = spark.createDataFrame(
        [(d, n, start + dt.timedelta(seconds=s), v, c) for d, n, s, v, c in rows], "device string, n int, ts timestamp, surface string, window_change boolean"
    )
    want, last, before = [], {}, {}
    for d, n, s, v, c in rows:
        entered = v == "watch" and before.get(d) != "watch"
        if entered or (v == "watch" and c and s - last.get(d, -1e9) > 4.0):
            want.append(n)
            last[d] = s
        before[d] = v
    got = ingest.watch_opens(df, ["device"], "ts", ["n"], bucket_seconds=60)
    assert sorted(r.n for r in got.collect()) == want


def test_a_long_burst_on_one_device(spark):
    from pyspark.sql import functions as F

    n = 100_000
    df = spark.range(n).select(
        F.lit("d").alias("device"), F.col("id").alias("n"), F.expr("timestamp_ntz'2026-08-23' + make_dt_interval(0, 0, 0, cast(id * 1.5 as decimal(18, 6)))").alias("ts"),
        F.lit("watch").alias("surface"), F.lit(True).alias("window_change"))
    got = sorted(r.n for r in ingest.watch_opens(df, ["device"], "ts", ["n"]).select("n").collect())
    want, last = [], None
    for k in range(n):
        if last is None or 1.5 * (k - last) > 4.0:
            want.append(k)
            last = k
    assert got == want


def test_repeat_opens_by_batches_with_a_replay(spark, tmp_path):
    schema = "profile_id string, event_id string, captured_at string, video_id string"
    inbox, root = str(tmp_path / "in"), str(tmp_path / "out")
    t = "2026-08-23T10:00:{:02d}Z".format
    batches = [[("p", "e1", t(1), "a"), ("p", "e2", t(2), "a"), ("q", "f1", t(1), "a"), ("q", "f0", t(3), None)],
               [("p", "e3", t(3), "a"), ("p", "e4", t(4), "b"), ("p", "e0", t(0), "a"), ("r", "g1", t(1), "a")], [("p", "e5", t(9), "b"), ("q", "f2", t(9), "b")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        repeat_open.start(spark.readStream.schema(schema).parquet(inbox), root, str(tmp_path / "cp"), once=True).awaitTermination()
    want = ["e1", "e4", "f1", "f2", "g1"]

    def written():
        return sorted(r.event_id for r in spark.read.parquet(f"{root}/opens").collect())

    assert written() == want
    repeat_open.write_batch(spark.createDataFrame(batches[1], schema), root, 1)
    assert written() == want


def test_repeats_in_flight_and_late_events(spark, tmp_path):
    inbox, root, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    inbox.mkdir()
    states = []

    def deliver(name, minute, *rows):
        sent = f"2026-08-25T10:{minute:02d}:00Z"
        (inbox / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r | {"context": {"sent": sent}}) for r in rows), encoding="utf-8")
        lines = stream.line_stream(spark, str(inbox))
        arrival = F.coalesce(F.get_json_object("value", "$.context.sent").cast("timestamp"), F.lit(sent).cast("timestamp"))
        query = stream.start(lines, root, checkpoint, once=True, delay="5 minutes", arrival=arrival)
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])

    first = [event(n, "like", 1.0) for n in range(20)]
    deliver("a", 0, *first, *first, "no json", "no json either")
    deliver("b", 2, *first[:3], event(30, "like", 1.0, day="2026-08-20"))
    deliver("c", 30, *first[:3], event(31, "like", 1.0, day="2026-08-19"))
    deliver("d", 50, event(32, "like", 1.0))
    stored = spark.read.parquet(f"{root}/events")
    assert stored.count() == 23 and {str(r.day) for r in stored.select("day").distinct().collect()} == {"2026-08-23", "2026-08-20", "2026-08-19"}
    assert {str(r.day): r.score_total for r in spark.read.parquet(f"{root}/daily").collect()} == {"2026-08-23": 21.0, "2026-08-20": 1.0, "2026-08-19": 1.0}
    assert spark.read.parquet(f"{root}/quarantine").filter("value like 'no json%'").count() == 2
    assert max(states[:2]) >= 20 and states[-1] <= 5, "what arrived long ago is forgotten"


def test_quota(spark):
    rows = [("d", "home", n, "2026-08-23", sig) for n, sig in enumerate("aabbacd")] + [("d", "other", 9, "2026-08-23", "x")]
    df = spark.createDataFrame(rows, "device string, surface string, n int, day string, sig string").withColumn("ts", F.timestamp_seconds("n"))
    out = ingest.apply_quota(df, ["device"], "surface", "day", "ts", ["n"], "sig", {"home": 4}, 6)
    assert sorted(r.n for r in out.collect()) == [0, 2, 4, 5, 9]


def envelope(signature="signature-1", **snapshot):
    node = {"depth": 0, "text": "Home", "class_name": "View", "clickable": True, "selected": True, "scrollable": False}
    return {
        "schema_version": "1.0.0", "participant_id": "participant-1", "device_id": "device-1", "profile_slot": "slot", "sent_at": "2026-08-23T10:00:00Z",
        "snapshot": {
            "schema_version": "1.0.0", "platform": "android", "source_package": "com.google.android.youtube", "captured_at": "2026-08-23T10:00:00Z",
            "extraction_mode": "android_accessibility_node_tree_read_only", "surface_guess": {"surface": "home", "confidence": .9, "evidence": []},
            "tree_signature": signature, "node_count": 1, "nodes": [node], **snapshot,
        },
    }


def test_device_envelopes(spark, tmp_path):
    bad = [envelope("signature-2", source_package="other"), envelope("signature-3", node_count=2)]
    lines = spark.createDataFrame([(json.dumps(e),) for e in [envelope(), envelope(), *bad]], "value string")
    for _ in range(2):
        device.write_batch(lines, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "device_snapshots")).count() == 1
