"""Snapshots on disk through all jobs to the community report."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from driftlane.operators import community, ingest, joins, validate
from driftlane.operators import longitudinal as lg
from driftlane.operators import nodes as nodes_ops
from driftlane.plans import jobs, staging
from driftlane.sources import readers, sinks
from driftlane.sources.rulebook import load_rulebook

DICTIONARY = {
    "categories": [
        {"id": "games", "name_vi": "Games", "youtube_video_category_ids": [20], "anchors": ["game", "esports"], "support": ["rank"]},
        {"id": "music", "name_vi": "Music", "youtube_video_category_ids": [10], "anchors": ["song", "remix"], "support": ["live"]},
        {"id": "food", "name_vi": "Food", "youtube_video_category_ids": [], "anchors": ["recipe", "cooking"], "support": []},
    ],
    "intents": {"review": {"name_vi": "R", "anchors": ["review"]}, "tutorial": {"name_vi": "T", "anchors": ["how to"]}},
}
WORDS = ["game rank review", "best song live", "recipe how to", "esports final", "remix", "cooking review", "nothing here"]


def snapshot(rng, profile, day, source, n, parent=None, channels=None):
    items = []
    for p in range(n):
        title = rng.choice(WORDS)
        items.append({"position": p + 1, "video_id": f"video{rng.randrange(12):06d}", "title": title, "channel": "c", "tags": title.split()[:2]})
    return {
        "source": source, "captured_at": f"{day}T10:00:00Z", "collection_session_id": f"s-{day}", "parent_video_id": parent,
        "collector_profile": {"profile_id": f"browser-{profile}", "participant_id": f"participant-{profile[0]}", "device_id": "device-1"},
        "subscription_channels": channels or [], "items": items,
    }


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("world")
    rng = random.Random(1)
    folder = root / "snapshots"
    folder.mkdir()
    n = 0
    for profile in ("aa1", "aa2", "bb1"):
        for day in ("2026-08-21", "2026-08-22", "2026-08-23"):
            rows = [snapshot(rng, profile, day, "youtube_home", 20)]
            rows += [snapshot(rng, profile, day, "youtube_up_next", 8, parent=p) for p in ("v1", "v1", "v2")]
            rows += [snapshot(rng, profile, day, "youtube_subscriptions", 6, channels=[{"channel_id": "UC1", "name": "One"}, {"name": "Two"}])]
            for row in rows:
                (folder / f"{n:03d}.json").write_text(json.dumps(row))
                n += 1
    (folder / "broken.json").write_text("{")
    (root / "rules.json").write_text(json.dumps(DICTIONARY))
    return root


def test_snapshots_to_report(spark, world):
    snapshots = readers.read_snapshots(spark, str(world / "snapshots"))
    valid, bad = validate.split(snapshots.withColumn("errors", validate.snapshot_errors()))
    assert (valid.count(), bad.count()) == (45, 0)
    metadata = spark.createDataFrame(
        [("video000003", "a long song", ["song"], "10", ["https://x.org/wiki/Pop_music"], "2026-08-01T00:00:00Z", ("1000", "5", None))],
        "video_id string, description string, tags array<string>, youtube_category_id string, youtube_topics array<string>, "
        "published_at string, statistics struct<view_count:string,like_count:string,comment_count:string>",
    )
    book = load_rulebook(spark, str(world / "rules.json"))
    items = jobs.classified_items(valid, book, F.lit("2026-08-24"), metadata)
    enriched = items.filter("video_id = 'video000003'").select("classification.mode", "classification.top_category").distinct().collect()
    assert {r.mode for r in enriched} == {"enriched"} and "music" in {r.top_category for r in enriched}

    tables = jobs.session_profiles(items, valid)
    sums = tables["interests"].groupBy("profile_id", "session_id").agg(F.sum("share").alias("s")).collect()
    assert len(sums) == 9 and all(r.s == pytest.approx(1) for r in sums)
    summary = tables["summary"].first()
    assert (summary.home_items, summary.up_next_items, summary.seeds, summary.replays) == (20, 24, 2, 3)
    assert tables["topics"].filter("value = 'Pop music'").count() > 0

    plans = jobs.blueprints(
        tables["lanes"], tables["interests"], tables["category_keywords"], tables["category_tags"],
        tables["intents"].groupBy("profile_id", "session_id").agg(F.max_by("key", "share").alias("top_intent")), jobs.SESSION,
    ).collect()
    assert plans and all(p.titles and p.primary_term for p in plans)

    table = str(world / "daily")
    sinks.replace_days(jobs.daily_observations(tables, valid), table)
    daily = readers.read_daily_observations(spark, table)
    per_field = daily.groupBy("profile_id", "day", "field").agg(F.sum("weight").alias("s")).collect()
    assert len(per_field) == 27 and all(r.s == pytest.approx(1, abs=1e-4) for r in per_field)
    assert readers.read_daily_observations(spark, table, since=dt.date(2026, 8, 23)).select("day").distinct().count() == 1

    meta = tables["interests"].filter("session_id = 's-2026-08-23'").select("profile_id", "key", "name", "demand")
    dated = ingest.channel_rows(valid).withColumn("day", F.to_date(F.substring("captured_at", 1, 10)))
    out = jobs.longitudinal(daily, dt.date(2026, 8, 23), meta, dated)
    rows = out["interests"].collect()
    assert {r.profile_id for r in rows} == {"browser-aa1", "browser-aa2", "browser-bb1"}
    assert all(0 <= r.opportunity <= 1 and r.name in ("Games", "Music", "Food") for r in rows)
    assert out["channels"].filter("observed_days = 3 and observed_today").count() == 6
    assert out["names"].count() == 9

    newest = tables["summary"].filter("session_id = 's-2026-08-23'").select("profile_id", "certainty")
    who = valid.select("profile_id", "collector_profile.participant_id", "collector_profile.device_id").distinct()
    intents = tables["intents"].filter("session_id = 's-2026-08-23'").select("profile_id", "key", "share")
    built = validate.build_submissions(jobs.submissions(out, who, newest, intents))
    checked = built.withColumn("errors", validate.submission_errors())
    assert checked.filter("size(errors) > 0").count() == 0 and checked.count() == 3

    report = community.report(built)
    assert tuple(report["community"].first()) == (2, 3, 2, 3)
    lanes = report["lanes"].collect()
    assert {r.category_id for r in lanes} <= {"games", "music", "food"} and lanes
    assert report["core_keywords"].count() > 0


def test_manifest_and_latest_collection(spark, world):
    snapshots = readers.read_snapshots(spark, str(world / "snapshots"))
    rows = ingest.session_manifest(snapshots).filter("surface = 'up_next'").collect()
    assert len(rows) == 9 and all((r.entries, r.item_count) == (3, 24) for r in rows)
    df = spark.createDataFrame([("p", "d", "1", "old"), ("p", "d", "2", "new"), ("p", "d", "2", "new2")], "profile_id string, day string, recorded_at string, v string")
    assert sorted(r.v for r in sinks.latest_collection(df).collect()) == ["new", "new2"]


def test_same_day_replacement_keeps_other_profiles(spark, tmp_path):
    path = str(tmp_path / "daily")
    schema = "profile_id string, day date, recorded_at string, session_id string, v int"
    day = dt.date(2026, 8, 23)
    run = lambda *rows: sinks.replace_days(sinks.latest_collection(spark.createDataFrame(list(rows), schema)), path)
    run(("a", day, "1", "s1", 1), ("b", day, "1", "s1", 2), ("b", day, "1", "s1", 3), ("c", dt.date(2026, 8, 22), "1", "s", 9))
    run(("a", day, "2", "s2", 4), ("a", day, "2", "s3", 5), ("d", day, "1", "s", 6))
    assert sorted((r.profile_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 5), ("b", 2), ("b", 3), ("c", 9), ("d", 6)]
    run(("a", day, "3", "s4", 7))
    assert sorted((r.profile_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 7), ("b", 2), ("b", 3), ("c", 9), ("d", 6)]


def test_lookup_spreads_rows_without_a_key(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("a", 3), (None, 4), ("z", 5)], "k string, n int")
    right = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "w")], "k string, v string")
    assert sorted((r.n, r.k, r.v) for r in joins.lookup(left, right, "k").collect()) == [(1, "a", "x"), (2, None, None), (3, "a", "x"), (4, None, None), (5, "z", None)]


def test_trees_without_hits_get_a_row(spark):
    nodes = spark.createDataFrame([(1, 0, "home", None, None, "x", False), (2, 0, "nothing here", None, None, "x", False)],
                                  "id int, place int, text string, content_description string, view_id string, class_name string, selected boolean")
    trees = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    got = {r.id: (r.surface, round(r.confidence, 2), len(r.evidence)) for r in nodes_ops.guess_surface(nodes, ["id"], trees=trees).collect()}
    assert got[2] == ("unknown", 0.15, 0) and got[3] == ("unknown", 0.0, 0) and got[1][0] == "home" and got[1][2] == 1


def test_term_history_counts_the_profile(spark):
    days = [dt.date(2026, 8, 22), dt.date(2026, 8, 23)]
    tags = spark.createDataFrame([("p", days[1], "x", 1.0)], "profile_id string, day date, key string, weight double")
    every = spark.createDataFrame([("p", d) for d in days], "profile_id string, day date")
    assert lg.term_trends(tags, days[1], 5).first().trend_state == "baseline"
    assert lg.term_trends(tags, days[1], 5, every).first().trend_state == "emerging"


def test_staging_needs_a_shared_folder(spark):
    class Without:
        sparkContext = type("C", (), {"getCheckpointDir": staticmethod(lambda: None)})
        conf = type("F", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError):
        staging.checkpoint_dir(Without)
