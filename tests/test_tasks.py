"""Queries over small files take as many tasks as their rows need."""

from driftlane.bindings import snapshot
from driftlane.operators import exposure as ex
from driftlane.operators import terms as tm


def parts(spark, folder, n=40):
    spark.range(n).selectExpr(
        "id AS p_partkey", "'red ring' AS p_name", "'Brand#1' AS p_brand", "'SMALL' AS p_type", "1 AS p_size", "1.0D AS p_retailprice"
    ).coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_term_cards_of_one_file_take_every_core(spark, tmp_path):
    cards = snapshot.term_cards(spark, parts(spark, tmp_path))
    assert cards.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    rows = tm.card_terms(cards, ["snapshot_id"], 0.40, 1.15, 1.20, 0.80)
    assert {r.video_support for r in tm.aggregate(rows.filter("key = 'red'"), ["snapshot_id"]).collect()} == {40}


def test_cards_of_a_snapshot_lie_in_one_task(spark, tmp_path):
    folder = parts(spark, tmp_path)
    spark.range(8).selectExpr("id AS o_orderkey", "id % 3 AS o_custkey").write.parquet(f"{folder}/orders.parquet")
    spark.range(30).selectExpr(
        "id % 8 AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "CAST(1 + id % 4 AS int) AS l_linenumber", "5.0D AS l_quantity",
        "0.1D AS l_discount", "0.0D AS l_tax", "'R' AS l_returnflag", "'O' AS l_linestatus").write.parquet(f"{folder}/lineitem.parquet")
    rows = snapshot.items(spark, folder)
    assert "hashpartitioning(o_custkey" in rows._jdf.queryExecution().executedPlan().toString()
    assert len(snapshot.intent_mix(spark, folder).select("snapshot_id").distinct().collect()) == 3


def test_intents_that_no_one_reads_are_not_worked_out(spark):
    schema = """sid int, intent_profile struct<intents:array<struct<id:string,name:string,share:double>>,
                evidence:map<string,array<struct<phrase:string>>>>"""
    df = spark.createDataFrame([(1, ([("review", "r", 1.0)], {}))], schema)
    plan = ex.effective_intents(df).select("sid")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "Generate" not in plan


def test_expansion_reads_the_zones_in_one_join(spark):
    cat = "categories array<struct<id:string,name:string,share:double>>"
    cards = spark.createDataFrame(
        [(1, f"v{n}", n, 1.0, 0.5, 0.5, [(c, c, 1.0)] if c else [], []) for n, c in enumerate(["core", "near", "far", "new", None])],
        f"sid int, video_id string, position int, rank_weight double, demand double, freshness double, {cat}, intents array<string>")
    dist = spark.createDataFrame([(1, "core", "core"), (1, "near", "adjacent"), (1, "far", "exploration")], "sid int, category_id string, zone string")
    out = ex.expansion_candidates(cards, dist, ["sid"])
    assert [(r.video_id, r.zone) for r in out.orderBy("video_id").collect()] == [("v1", "adjacent"), ("v2", "exploration"), ("v3", "exploration")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
