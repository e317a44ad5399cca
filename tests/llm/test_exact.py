"""Exact duplicates against a grouping in Python, the perfect hash itself, and edge cases."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlane.llm import exact

SCHEMA = "doc_id long, text string"
BIG = 2**60


def plain(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id is not None and doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(BIG + k, f"text {k % 40}") for k in range(300)] + [(1, None), (2, ""), (3, " "), (None, "text 1"), (None, "alone"), (None, "alone"), (9, "ünï"), (9, "ünï"), (10, "x" * 2_000_000)]


@pytest.mark.parametrize("split", [0, 150, len(ROWS)])
def test_equals_grouping(spark, split):
    first, second = (spark.createDataFrame(part, SCHEMA).withColumn("digest", F.lit("x")) for part in (ROWS[:split], ROWS[split:]))
    found = exact.deduplicated(first, second).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, found), key=repr) == plain(ROWS)


def test_newcomers_that_stay(spark):
    history = spark.createDataFrame([(1, "seen"), (2, None)], SCHEMA)
    new = spark.createDataFrame([(5, "seen"), (6, ""), (7, "new"), (8, "new"), (8, "new"), (None, "other"), (None, "other")], SCHEMA).withColumn("digest", F.lit("own")).withColumn("keep_id", F.lit(0))
    index = exact.build_index(exact.digested(history))
    left = exact.drop_repeats(new, index)
    assert left.columns == new.columns
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([(8, "new", "own", 0), (None, "other", "own", 0)], key=repr)


def test_halves_lose_no_row(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    old, new = exact.halves(df)
    assert old.count() + new.count() == len(ROWS) and old.count() > 50 and new.where("doc_id is null").count() == 3


def test_slots_are_minimal_and_foreign_digests_are_told_apart():
    digests = [hashlib.sha256(bytes([k % 256, k // 256])).digest() for k in range(5000)]
    words = exact.words_of(digests)
    sizes, marks, slot = exact.placed(words[:4000])
    assert sorted(slot) == list(range(4000))
    assert (exact.slots(words, np.array(sizes), marks)[:4000] == slot).all()
    assert sum(sizes) < 4 * 2 * 4000
    near = words[:1].copy()
    near[0, 3] ^= np.uint64(1)  # differs in the last word only
    sizes, marks, slot = exact.placed(np.concatenate([words[:1], near]))
    assert sorted(slot) == [0, 1]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact.deduplicated(empty, empty).count() == 0
    some = spark.createDataFrame([(1, "a")], SCHEMA)
    assert [tuple(r)[:4] for r in exact.deduplicated(empty, some).collect()] == [(1, 1, 1, True)]
