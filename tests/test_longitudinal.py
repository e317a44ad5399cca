import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from driftlane.operators import longitudinal as lg

D = dt.date


def obs(spark, rows, profile="p"):
    return spark.createDataFrame(
        [(profile, D.fromisoformat(day), k, float(w)) for day, vec in rows for k, w in vec.items()],
        "profile_id string, day date, key string, weight double",
    )


def windows(df, as_of):
    return {r.key: r for r in lg.interest_trends(df, D.fromisoformat(as_of)).collect()}


def test_recent_days_weigh_more(spark):
    out = windows(obs(spark, [("2026-08-20", {"music": .9, "gaming": .1}), ("2026-08-23", {"music": .2, "gaming": .8})]), "2026-08-23")
    assert out["gaming"].w7d > out["music"].w7d
    w = 0.5 ** (3 / 3.5)
    assert out["music"].w7d == pytest.approx((.9 * w + .2) / (1 + w))


def test_rising(spark):
    days = [("2026-08-20", .10), ("2026-08-21", .12), ("2026-08-22", .13), ("2026-08-23", .32)]
    out = windows(obs(spark, [(d, {"ai": w, "music": 1 - w}) for d, w in days]), "2026-08-23")
    assert out["ai"].trend_state == "rising"
    assert out["ai"].trend_confidence == pytest.approx(.20 + .12 * 3 + .08 * 4)


STATES = [
    ("baseline", [("2026-08-23", {"a": 1})]),
    ("dormant", [("2026-08-22", {"a": .5, "b": .5}), ("2026-08-23", {"b": 1})]),
    ("revived", [("2026-08-10", {"a": .5, "b": .5}), ("2026-08-22", {"b": 1}), ("2026-08-23", {"a": .5, "b": .5})]),
    ("emerging", [("2026-08-22", {"b": 1}), ("2026-08-23", {"a": .5, "b": .5})]),
    ("cooling", [(f"2026-08-{d}", {"a": .6, "b": .4}) for d in (19, 20, 21, 22)] + [("2026-08-23", {"a": .1, "b": .9})]),
    ("stable", [(f"2026-08-{d}", {"a": .5, "b": .5}) for d in (19, 20, 21, 22, 23)]),
]


@pytest.mark.parametrize("state,rows", STATES)
def test_every_state(spark, state, rows):
    assert windows(obs(spark, rows), "2026-08-23")["a"].trend_state == state


def test_future_days_do_not_count_and_backfill_agrees(spark):
    rows = [(f"2026-08-{d:02d}", {"a": d / 40, "b": 1 - d / 40}) for d in range(1, 21)]
    df = obs(spark, rows)
    back = lg.interest_trends(df, (D(2026, 8, 1), D(2026, 8, 20)))
    got = {(r.as_of, r.key): r for r in back.collect()}
    for day in ("2026-08-05", "2026-08-12"):
        for key, r in windows(df, day).items():
            b = got[(D.fromisoformat(day), key)]
            assert (b.trend_state, b.weight, b.w30d) == (r.trend_state, pytest.approx(r.weight), pytest.approx(r.w30d))


def test_series_equals_single_days_over_gaps_and_years(spark):
    rows = [("1990-01-01", {"old": .6, "a": .4}), ("2026-07-01", {"a": .3, "b": .7}), ("2026-07-29", {"b": 1}), ("2026-08-02", {"a": .005, "b": .995}),
            ("2026-08-03", {"c": 1}), ("2026-08-20", {"a": .5, "c": .5}), ("2026-09-30", {"a": 1})]
    df = obs(spark, rows)
    other = df.select("profile_id", "day").distinct().union(spark.createDataFrame([("p", D(2026, 8, 5))], "profile_id string, day date"))
    for days in (None, other):
        series = lg.window_table(df, (D(2026, 7, 30), D(2026, 8, 25)), days=days).collect()
        assert len(series) == len({(r.profile_id, r.as_of, r.key) for r in series})
        by_day = {}
        for r in series:
            by_day.setdefault(r.as_of, {})[r.profile_id, r.key] = r.asDict()
        assert sorted(by_day) == [D(2026, 7, 30) + dt.timedelta(days=k) for k in range(27)]
        for day in (D(2026, 7, 30), D(2026, 8, 2), D(2026, 8, 4), D(2026, 8, 9), D(2026, 8, 10), D(2026, 8, 20), D(2026, 8, 25)):
            want = {(r.profile_id, r.key): r.asDict() for r in lg.window_table(df, day, days=days).collect()}
            assert by_day[day].keys() == want.keys()
            for key, row in want.items():
                for name, value in row.items():
                    assert by_day[day][key][name] == (pytest.approx(value, abs=1e-12) if isinstance(value, float) else value), (day, key, name)


def test_facts_come_from_the_newest_session_that_has_the_interest(spark):
    rows = [("p", "a", D(2026, 8, 1), "A one", .1), ("p", "b", D(2026, 8, 1), "B one", .2), ("p", "a", D(2026, 8, 5), "A five", .3), ("p", "c", D(2026, 8, 9), "C", .4),
            ("q", "a", D(2026, 8, 4), None, None)]
    history = spark.createDataFrame(rows, "profile_id string, key string, day date, name string, demand double")
    every = {(r.profile_id, r.as_of, r.key): (r["name"], r.demand) for r in lg.facts_as_of(history, (D(2026, 8, 3), D(2026, 8, 10))).collect()}
    for day in range(3, 11):
        one = {(r.profile_id, r.as_of, r.key): (r["name"], r.demand) for r in lg.facts_as_of(history, D(2026, 8, day)).collect()}
        want = {(p, D(2026, 8, day), k): max((d, n, x) for q, j, d, n, x in rows if (q, j) == (p, k) and d <= D(2026, 8, day))[1:]
                for p, k in {r[:2] for r in rows if r[2] <= D(2026, 8, day)}}
        assert one == want
        assert {k: v for k, v in every.items() if k[1] == D(2026, 8, day)} == want


def test_series_copies_no_row_to_later_days(spark):
    df = obs(spark, [("2026-08-01", {"a": .5, "b": .5}), ("2026-08-03", {"a": 1})])
    plan = lg.window_table(df, (D(2026, 8, 1), D(2026, 8, 20)))._jdf.queryExecution().toString()
    assert plan.count("Generate") == plan.count("Generate explode(concat(array(day")


def test_composite_sums_to_one_and_is_partition_independent(spark):
    rows = [(f"2026-08-{d:02d}", {c: 1 + (d * i) % 5 for i, c in enumerate("abcdef")}) for d in range(1, 24)]
    df = obs(spark, rows)
    a, b = windows(df, "2026-08-23"), windows(df.repartition(7), "2026-08-23")
    assert math.isclose(sum(r.weight for r in a.values()), 1)
    assert {k: (r.trend_state, r.rank) for k, r in a.items()} == {k: (r.trend_state, r.rank) for k, r in b.items()}


def names(spark, *candidates):
    rows = [("p", D(2026, 8, 1) + dt.timedelta(days=2 * i), c) for i, c in enumerate(candidates)]
    out = lg.stable_names(spark.createDataFrame(rows, "profile_id string, day date, candidate string"))
    return [(r.stable_name, r.status) for r in out.orderBy("day").collect()]


def test_name_needs_three_observations(spark):
    assert [n for n, _ in names(spark, "A", "B", "B")] == ["A", "A", "A"]
    out = names(spark, "A", "B", "B", "B", "B", "A")
    assert [n for n, _ in out] == ["A", "A", "A", "B", "B", "B"]
    assert [s for _, s in out] == [
        "initialized", "candidate_waiting_for_stability", "candidate_waiting_for_stability",
        "promoted_after_3_daily_observations", "stable", "candidate_waiting_for_stability",
    ]


def test_names_equal_the_day_by_day_rule(spark):
    seq = "ABBBABABBBBCCCAAB"
    stable, streak, last, want = None, 0, None, []
    for c in seq:
        streak = streak + 1 if c == last else 1
        last = c
        stable = c if stable is None or (stable != c and streak >= 3) else stable
        want.append(stable)
    assert [n for n, _ in names(spark, *seq)] == want


@pytest.mark.parametrize("state,rows", [
    ("baseline", [("2026-08-23", {"a": 1})]),
    ("emerging", [("2026-08-10", {"b": 1}), ("2026-08-23", {"a": .5, "b": .5})]),
    ("rising", [("2026-08-22", {"a": .2, "b": .8}), ("2026-08-23", {"a": .5, "b": .5})]),
    ("cooling", [("2026-08-22", {"a": .5, "b": .5}), ("2026-08-23", {"a": .1, "b": .9})]),
    ("stable", [("2026-08-22", {"a": .5, "b": .5}), ("2026-08-23", {"a": .5, "b": .5})]),
])
def test_term_states(spark, state, rows):
    out = {r.key: r for r in lg.term_trends(obs(spark, rows), D(2026, 8, 23), 40).collect()}
    assert out["a"].trend_state == state


def test_surfaces_are_renormalised_over_those_present(spark):
    rows = spark.createDataFrame(
        [("p", "home", "a", 2.0), ("p", "home", "b", 2.0), ("p", "subscriptions", "b", 3.0)],
        "profile_id string, surface string, key string, weight double",
    )
    out = {r.key: r for r in lg.combine_surfaces(rows, ["profile_id"]).collect()}
    assert out["a"].weight == pytest.approx(.53 / .68 * .5, abs=1e-6)
    assert out["b"].surfaces == {"home": .5, "subscriptions": 1.0}


def test_term_blend_one_side_alone_keeps_everything(spark):
    schema = "profile_id string, key string, value string, score double"
    main = spark.createDataFrame([("p", "a", "A", 3.0), ("p", "b", "B", 1.0)], schema)
    extra = spark.createDataFrame([("p", "b", "b!", 2.0), ("q", "c", "c", 5.0)], schema)
    out = {(r.profile_id, r.key): r for r in lg.blend_terms(main, extra, ["profile_id"]).collect()}
    assert out[("p", "a")].weight == pytest.approx(.85 * .75)
    assert out[("p", "b")].weight == pytest.approx(.85 * .25 + .15)
    assert out[("p", "b")].value == "B"
    assert out[("q", "c")].weight == 1.0


def test_channel_history(spark):
    rows = spark.createDataFrame(
        [("p", D(2026, 8, d), k, k.upper(), u) for d, k, u in [(1, "x", "u1"), (1, "x", None), (3, "x", None), (3, "y", "u2"), (5, "z", "u")]],
        "profile_id string, day date, key string, name string, url string",
    )
    out = {r.key: r for r in lg.channel_history(rows, D(2026, 8, 3)).collect()}
    assert set(out) == {"x", "y"}
    assert (out["x"].observed_days, out["x"].url, out["x"].observed_today) == (2, "u1", True)


def test_lane_plan_skips_dormant_and_falls_back(spark):
    rows = spark.createDataFrame(
        [("p", 1, "a", "dormant", False), ("p", 2, "b", "stable", False), ("p", 3, "c", "cooling", True),
         ("p", 4, "d", "rising", True), ("p", 5, "e", "emerging", False), ("q", 1, "a", "dormant", False)],
        "profile_id string, rank int, key string, trend_state string, cross_surface boolean",
    ).withColumn("as_of", F.lit("2026-08-23"))
    out = {r.profile_id: r for r in lg.trend_lanes(rows).collect()}
    assert (out["p"].anchor, out["p"].bridge, out["p"].controlled_expansion) == ("b", "d", "d")
    assert (out["q"].anchor, out["q"].bridge) == ("a", None)
