"""Versioned current tables, and the submission stream that fills one."""

import json

import pytest
from pyspark.sql import functions as F

from driftlane.sources import current
from driftlane.streaming import interactions, submissions

ROW = "k string, at int, v string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROW)


def state(spark, path):
    return {r.k: (r["at"], r.v) for r in current.read(spark, path).collect()}


def test_newest_row_of_each_key_stays_and_untouched_buckets_are_not_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    assert current.read(spark, path) is None
    assert current.update(rows(spark, *[(f"k{i}", 1, "a") for i in range(40)], ("k0", 2, "b"), (None, 1, "n")), path, ["k"], ["at"], buckets=8)
    first = current.version(spark, path)["buckets"]
    current.update(rows(spark, ("k1", 0, "late"), ("k2", 3, "c")), path, ["k"], ["at"])
    second = current.version(spark, path)["buckets"]
    assert first.keys() == second.keys() and 1 <= sum(first[b] != second[b] for b in first) <= 2
    got = state(spark, path)
    assert len(got) == 41 and got["k0"] == (2, "b") and got["k1"] == (1, "a") and got["k2"] == (3, "c") and got[None] == (1, "n")


def test_a_repeated_batch_and_an_empty_one_change_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert current.update(rows(spark, ("a", 1, "x")), path, ["k"], ["at"], "w", 0)
    assert not current.update(rows(spark, ("a", 9, "again")), path, ["k"], ["at"], "w", 0)
    assert current.update(rows(spark), path, ["k"], ["at"], "w", 1)
    assert current.update(rows(spark, ("a", 2, "other")), path, ["k"], ["at"], "v", 0), "batches are counted per writer"
    assert state(spark, path) == {"a": (2, "other")}


def test_an_interrupted_update_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    current.update(rows(spark, ("a", 1, "x"), ("b", 1, "y")), path, ["k"], ["at"], "w", 0)

    def lost(*_):
        raise ConnectionError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(current, "_publish", lost)
        with pytest.raises(ConnectionError):
            current.update(rows(spark, ("a", 2, "z")), path, ["k"], ["at"], "w", 1)
    assert state(spark, path) == {"a": (1, "x"), "b": (1, "y")}
    assert current.update(rows(spark, ("a", 2, "z")), path, ["k"], ["at"], "w", 1)
    assert state(spark, path) == {"a": (2, "z"), "b": (1, "y")}
    assert current.drop_unused(spark, path) and state(spark, path) == {"a": (2, "z"), "b": (1, "y")}


def test_a_second_writer_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    current.update(rows(spark, ("a", 1, "x")), path, ["k"], ["at"])
    old = current.version(spark, path)
    current.update(rows(spark, ("a", 2, "y")), path, ["k"], ["at"])
    monkeypatch.setattr(current, "version", lambda *_: old)
    with pytest.raises(RuntimeError):
        current.update(rows(spark, ("a", 3, "z")), path, ["k"], ["at"])


def test_new_columns_are_taken_up(spark, tmp_path):
    path = str(tmp_path / "t")
    current.update(rows(spark, ("a", 1, "x"), ("b", 1, "y")), path, ["k"], ["at"], buckets=1)
    current.update(rows(spark, ("a", 2, "z")).withColumn("extra", F.lit(5)), path, ["k"], ["at"])
    assert {r.k: r.extra for r in current.read(spark, path).collect()} == {"a": 5, "b": None}


def submission(profile, updated, certainty=0.5, **more):
    return json.dumps({
        "schema_version": "1.0.0", "participant_id": "person-1", "device_id": "device-1", "profile_id": f"profile {profile}", "profile_key": f"key-{profile}",
        "updated_at": updated, "certainty_score": certainty, "interest_weights": [{"id": "gaming", "predicted_weight": 0.4}], **more})


def test_submission_stream(spark, tmp_path):
    inbox, root, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    (tmp_path / "in").mkdir()

    def deliver(name, *lines):
        (tmp_path / "in" / name).write_text("\n".join(lines), encoding="utf-8")
        submissions.start(interactions.line_stream(spark, inbox), root, checkpoint, once=True).awaitTermination()

    assert submissions.submissions(spark, root) is None
    deliver("a.json", submission("one", "2026-08-01T00:00:00Z", .3), submission("one", "2026-08-02T00:00:00Z", .4), submission("two", "2026-08-01T00:00:00Z"),
            "no json", submission("three", "x", 1.5), submission("four", "x", cookies=["c"]), submission("five", "x", interest_weights=[]))
    deliver("b.json", submission("two", "2026-07-01T00:00:00Z", .9))
    got = {r.profile_key: (r.updated_at[:10], r.certainty_score) for r in submissions.submissions(spark, root).collect()}
    assert got == {"key-one": ("2026-08-02", .4), "key-two": ("2026-07-01", .9)}, "what arrives last replaces what was there"
    submissions.write_batch(spark.createDataFrame([(submission("two", "2030-01-01", .1),)], "value string"), root, 1)
    assert {r.profile_key: r.certainty_score for r in submissions.submissions(spark, root).collect()} == {"key-one": .4, "key-two": .9}
    bad = {json.loads(r.value)["profile_key"] if r.value.startswith("{") else r.value: r.errors
           for r in spark.read.parquet(f"{root}/submission_quarantine/batch=0").collect()}
    assert bad.keys() == {"no json", "key-three", "key-four", "key-five"} and all(bad.values())
