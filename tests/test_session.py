import pytest
from pyspark.sql import functions as F

from driftlane.functions import fixed
from driftlane.functions.plan import in_tasks
from driftlane.operators import session as ss
from driftlane.operators import exposure as ex
from driftlane.operators import nodes as nd


def test_two_of_three_replays_is_not_stable(spark):
    rows = [("s", "seed", r, i, p) for r, items in enumerate(["ab", "ab", "a"]) for p, i in enumerate(items, 1)]
    rows += [("s", "other", 9, "z", 4), ("s", "other", 9, "z", 2)]
    df = spark.createDataFrame(rows, "sid string, seed string, replay int, item string, position int")
    out = {r.item: r for r in ss.stable_items(df, ["sid"]).collect()}
    assert (out["a"].appearance_rate, out["a"].stable, out["a"].mean_position) == (1.0, True, 1.0)
    assert (out["b"].appearance_rate, out["b"].stable) == (.6667, False)
    assert (out["z"].appearances, out["z"].mean_position) == (1, 2.0)


def test_stable_items_read_their_rows_once_without_a_further_shuffle(spark):
    rows = [("s", "a", 1, "x", 1), ("s", "a", 2, "", 1), ("s", "a", 2, None, 2), ("s", "a", None, "x", 3), ("s", "b", 1, None, 1),
            (None, "a", 1, "x", 1), ("s", None, 1, "x", 1)]
    df = spark.createDataFrame(rows, "sid string, seed string, replay int, item string, position int")
    items = ss.stable_items(in_tasks(df, len(rows), "sid", "seed"), ["sid"])
    out = [tuple(r) for r in items.select("sid", "seed", "item", "appearances", "replay_count", "mean_position").collect()]
    assert out == [("s", "a", "x", 2, 3, 2.0)]
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange"), plan.count("Scan ")) == (1, 1)


def dist(spark, *rows):
    return spark.createDataFrame([("s", k, float(v)) for k, v in rows], "sid string, key string, share double")


def test_blend_with_bonus(spark):
    out = {r.key: r.share for r in ss.blend_surfaces(dist(spark, ("a", .5), ("b", .5)), dist(spark, ("b", 1)), ["sid"]).collect()}
    a, b = .62 * .5, (.62 * .5 + .38) * 1.08
    assert out["a"] == pytest.approx(a / (a + b))


def test_one_surface_passes_through(spark):
    home = dist(spark, ("a", .7), ("b", .3))
    out = {r.key: r.share for r in ss.blend_surfaces(home, home.limit(0), ["sid"]).collect()}
    assert out == {"a": pytest.approx(.7), "b": pytest.approx(.3)}


def test_mean_of_seeds(spark):
    rows = spark.createDataFrame(
        [("s", "x", "a", 3.0), ("s", "x", "b", 1.0), ("s", "y", "b", 5.0)], "sid string, seed string, key string, weight double"
    )
    out = {r.key: r.share for r in ss.seed_mean(rows, ["sid"]).collect()}
    assert out == {"a": pytest.approx(.375), "b": pytest.approx(.625)}


def test_titles(spark):
    rows = spark.createDataFrame(
        [("A", "review", ["Cat", "CAT", "dog"]), ("Way", "news", []), ("D", None, ["{secondary}", "x"])],
        "direction string, intent_id string, keywords array<string>",
    )
    out = [r.titles for r in ss.title_suggestions(rows).collect()]
    assert out[0] == [p.format(primary="Cat", secondary="dog") for p in fixed.TITLE_PATTERNS["review"]]
    assert out[1] == [p.format(primary="Way", secondary="Way") for p in fixed.TITLE_PATTERNS["news"]]
    assert out[2] == [p.format(primary="{secondary}", secondary="x") for p in fixed.TITLE_PATTERNS[""]]


def test_titles_fold_keywords_and_titles_once(spark):
    rows = spark.createDataFrame([("A", "review", ["Cat"])], "direction string, intent_id string, keywords array<string>")
    plan = ss.title_suggestions(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_term_key_list_slow(") == 2


def test_rows_are_spread_by_their_number(spark):
    df = spark.range(90)
    assert in_tasks(df, 90, "id", a_task=5).rdd.getNumPartitions() == 18
    assert in_tasks(df, 3, "id", a_task=5).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_sample_is_repeatable_and_without_replacement(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("sid"), (F.col("id") % 20).alias("item"))
    a = sorted(map(tuple, ss.sample_seeds(df, ["sid"], "item", 3, 1).select("sid", "item").collect()))
    b = sorted(map(tuple, ss.sample_seeds(df.repartition(5), ["sid"], "item", 3, 1).select("sid", "item").collect()))
    assert a == b and len(set(a)) == 6


@pytest.mark.parametrize("top,diversity,name", [(.34, 0, "C · Tutorial Learner"), (.2, .72, "Multi-interest · Tutorial Learner"), (.2, .5, "C-leaning · Tutorial Learner")])
def test_behavior_name(spark, top, diversity, name):
    col = ss.behavior_name(F.lit("C"), F.lit("tutorial"), F.lit(diversity), F.lit(top))
    assert spark.range(1).select(col.alias("x")).first().x == name


def test_category_blend_keeps_ids_of_either_side(spark):
    kind = "array<struct<id:string,name:string,share:double,raw_score:double>>"
    df = spark.createDataFrame([([("a", "A", .6, 1.0), ("b", "B", .4, 1.0)], [("c", "C", 1.0, 1.0)])], f"x {kind}, y {kind}")
    row = ex.blend_categories(df, F.col("x"), F.col("y"), .85, .15).first().categories
    assert [(c.id, round(c.share, 4)) for c in row] == [("a", .51), ("b", .34), ("c", .15)]


def test_weak_news_is_dropped(spark):
    schema = """intent_profile struct<intents:array<struct<id:string,name:string,share:double>>,
                evidence:map<string,array<struct<phrase:string>>>>"""
    intents = [("news", "n", .5), ("review", "r", .5)]
    df = spark.createDataFrame([((intents, {"news": [("ngày ",)]}),), ((intents, {"news": [("ngày ",), ("breaking",)]}),)], schema)
    out = [[(i.id, i.share) for i in r.intents] for r in ex.effective_intents(df).collect()]
    assert out == [[("review", 1.0)], [("news", .5), ("review", .5)]]


def test_surface_guess(spark):
    rows = [(1, 0, "Home", None, "bottom_pivot", True), (1, 1, "Search", None, None, False), (2, 0, None, None, "player_view", False)]
    df = spark.createDataFrame(rows, "id int, place int, text string, content_description string, view_id string, selected boolean")
    out = {r.id: r for r in nd.guess_surface(df, ["id"]).collect()}
    assert out[1].surface == "home" and out[1].evidence == ["home[selected]"]
    assert out[1].confidence == pytest.approx(.30 + .68 * .35 + (.68 - .38) * .25)
    assert (out[2].surface, out[2].evidence) == ("watch", ["view_id:player_view"])
