import json
import random

import pytest
from pyspark.sql import functions as F

from driftlane.bindings.cards import rule_tables
from driftlane.functions import fixed
from driftlane.operators import classify as k
from driftlane.sources import schemas
from driftlane.sources.rulebook import RuleBook, frame_of_tables, load_rulebook, read_rule_tables, tables_of

DICTIONARY = {
    "categories": [
        {"id": "games", "youtube_video_category_ids": [20], "entities": ["t1"], "anchors": ["game", "lol"], "support": ["rank", "final"]},
        {"id": "music", "youtube_video_category_ids": [10], "anchors": ["song", "remix"], "support": ["live", "final"]},
        {"id": "education", "anchors": ["lịch sử", "study"], "support": []},
    ],
    "intents": {"news": {"anchors": ["ngày ", "breaking"]}, "review": {"anchors": ["review"]}},
}
BOOK = RuleBook.from_dict(DICTIONARY)
CARD = "title string, channel string, tags array<string>, description string, youtube_topics array<string>, youtube_category_id string"


def classified(spark, **card):
    values = [card.get(c) for c in ("title", "channel", "tags", "description", "youtube_topics", "youtube_category_id")]
    return k.classify(spark.createDataFrame([tuple(values)], CARD), BOOK).first()


def test_support_needs_strong_evidence(spark):
    row = classified(spark, title="final rank live")
    assert row.classification.top_category is None
    assert row.classification.confidence == "unknown"
    assert row.classification.mode == "home_visible"


def test_support_adds_after_a_strong_hit(spark):
    row = classified(spark, title="Game FINAL", channel="x")
    assert [(c.id, c.share, c.raw_score) for c in row.classification.categories] == [("games", 1.0, 5.0)]
    assert row.classification.confidence == "medium"


def test_official_code_does_not_unlock_support(spark):
    row = classified(spark, title="live final", youtube_category_id="10")
    assert [(c.id, c.raw_score) for c in row.classification.categories] == [("music", 7.0)]
    assert row.classification.confidence == "medium"  # one strong source only
    assert row.classification.mode == "enriched"


def test_every_tag_counts_and_two_sources_make_it_high(spark):
    row = classified(spark, title="song", tags=["song one", "song two"])
    assert row.classification.categories[0].raw_score == pytest.approx(4 + 2 * 3.6)
    assert row.classification.confidence == "high"
    assert row.target_profile.available
    assert row.target_profile.categories[0].raw_score == pytest.approx(4 * 0.55 + 2 * 4.0)


def test_target_needs_creator_metadata(spark):
    assert not classified(spark, title="song").target_profile.available


def test_idiom_hides_history(spark):
    assert classified(spark, title="trận hay nhất lịch sử").classification.top_category is None
    assert classified(spark, title="bài lịch sử").classification.top_category == "education"


def test_shares_are_cut_but_not_renormalised(spark):
    row = classified(spark, title="game lol t1 game", description="song")
    # games 4+4+6 = 14, music 1.8: share .1139 is below .18 of the top share
    assert [(c.id, c.share) for c in row.classification.categories] == [("games", 0.8861)]


def test_ties_follow_dictionary_order(spark):
    row = classified(spark, title="song game")
    assert [c.id for c in row.classification.categories] == ["games", "music"]
    assert row.classification.margin == 0.0


def test_intents(spark):
    row = classified(spark, title="Review ngày 5", tags=["breaking"])
    assert [(i.id, i.share) for i in row.intent_profile.intents] == [("news", 0.6226), ("review", 0.3774)]
    assert row.intent_profile.top_intent == "news"


def tables(spark, dictionary):
    line = spark.createDataFrame([(json.dumps(dictionary),)], "value string")
    return tables_of(line.select(F.from_json("value", " ".join(schemas.RULES.split())).alias("d")).select("d.*"))


def profiles(df):
    kept = ["classification", "target_profile", "intent_profile"]
    return {r.id: r[1:] for r in df.select("id", *kept).collect()}


def test_rule_tables_give_the_same_rows(spark):
    texts = ["Game final, song!", "lol-t1 #rank", "no hit", "remix study lịch sử", "c++ game", "breaking review ngày 5", ""]
    cards = spark.createDataFrame([(t, None, [t, " live "], t[::-1], None, None) for t in texts], CARD).withColumn("id", F.monotonically_increasing_id())
    dictionary = DICTIONARY | {"scoring": {"entity": 9.0, "support": 0.5, "youtube_category": 1.0, "source_multipliers": {"tags": 2.0}}}
    inline, joined = k.classify(cards, RuleBook.from_dict(dictionary)), k.classify_with_tables(cards, "id", tables(spark, dictionary))
    assert profiles(inline) == profiles(joined)


def test_dictionary_of_any_size(spark):
    dictionary = {"categories": [{"id": "a", "anchors": [f"w{i}" for i in range(20_000)]}, {"id": "b", "anchors": ["w7 w8"]}]}
    cards = spark.createDataFrame([("w19999, w7 w8 and w3", None, None, "w7 w8", None, None)], CARD).withColumn("id", F.lit(1))
    row = profiles(k.classify_with_tables(cards, "id", tables(spark, dictionary)))[1][0]
    assert {e.phrase for hits in row.evidence.values() for e in hits} == {"w19999", "w3", "w7", "w8", "w7 w8"}
    assert len(RuleBook.from_dict(dictionary).rules) == 20_001


def test_token_sequences_equal_the_phrase_test(spark):
    draw = random.Random(4)
    signs = ["a", "b1", "_", " ", "  ", "-", "+", "c++", "é", "日", "\n", "'"]
    phrases = sorted({"".join(draw.choices(signs, k=draw.randint(1, 4))).strip() for _ in range(150)} - {""})
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 9))) for _ in range(150)] + [None, "a"]
    dictionary = {"categories": [{"id": "x", "anchors": phrases}], "suppressions": [["x", "a", "b1"]]}
    cards = spark.createDataFrame([(t, None, [t or "", "a"], t, None, None) for t in texts], CARD).withColumn("id", F.monotonically_increasing_id())
    inline, joined = k.classify(cards, RuleBook.from_dict(dictionary)), k.classify_with_tables(cards, "id", tables(spark, dictionary))
    assert profiles(inline) == profiles(joined)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def parquet_cards(spark, tmp_path):
    spark.createDataFrame([("game song final", "t1", ["live"], "lol remix", None, "10")], CARD).withColumn("id", F.lit(1)).write.parquet(str(tmp_path / "cards"))
    return spark.read.parquet(str(tmp_path / "cards"))


def test_no_filter_repeats_the_scoring(spark, tmp_path):
    """a filter inferred from the explode of ``hold`` held the whole scoring and ran it on every card again."""
    found = k.with_rule_numbers(k.with_folded_sources(parquet_cards(spark, tmp_path)), BOOK)
    vector = k.hold(k.classify_content(found, BOOK), "classification").select("id", F.explode("classification.categories").alias("c")).select("id", "c.id", "c.share")
    assert not [line for line in plan_of(vector).splitlines() if "Filter (" in line and "transform(" in line.split("Filter (")[1]]
    assert vector.count() == 2


def test_hits_by_join_read_the_cards_once_and_shuffle_no_sequences(spark, tmp_path):
    """F7 to F9: six scans of the cards, and all their token sequences shuffled by phrase."""
    joined = k.classify_with_tables(parquet_cards(spark, tmp_path), "id", rule_tables(spark, DICTIONARY))
    plan = joined.select("id", "classification.top_category")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2  # the texts, and the cards that get their hits
    assert not [line for line in plan.splitlines() if "SortMergeJoin [phrase" in line]
    assert joined.first().classification.top_category == "music"


def test_sequences_of_each_length(spark):
    rows = spark.createDataFrame([("ab  c.d-\U00020000e \U00020000", [1, 2, 3]), ("", [1]), (None, [1]), ("a", [2]), ("a b", [])], "t string, n array<int>")
    got = [r.g for r in rows.select(k.grams(F.col("t"), F.col("n")).alias("g")).collect()]
    assert [sorted(g) for g in (got[0], got[1], got[3], got[4])] == [sorted([
        "ab", "c", "d", "\U00020000e", "\U00020000", "ab ", " c", "c.d", "d-\U00020000e", "\U00020000e \U00020000"]), [], [], []]
    long = spark.range(1).select(k.grams(F.repeat(F.lit("a "), 4_000), F.array(F.lit(1_000), F.lit(7_999))).alias("g")).first().g
    assert sorted(map(len, long)) == [1_000, 7_999]


def test_suppressions_and_intents_come_from_the_document(spark, tmp_path):
    dictionary = DICTIONARY | {"suppressions": [["games", "game", r"video\s+game\s+review"]]}
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(dictionary), encoding="utf-8")
    read = read_rule_tables(spark, str(path))
    assert frame_of_tables(read).suppressions == load_rulebook(spark, str(path)).suppressions == (("games", "game", r"video\s+game\s+review"),)
    assert frame_of_tables(tables(spark, DICTIONARY)).suppressions == tuple(fixed.SUPPRESSIONS)
    cards = spark.createDataFrame([(t, None, None, None, None, None) for t in ("video game review", "game review", "lịch sử")], CARD).withColumn("id", F.col("title"))
    inline, joined = k.classify(cards, load_rulebook(spark, str(path))), k.classify_with_tables(cards, "id", read)
    assert profiles(inline) == profiles(joined)


def test_scoring_block_changes_scores():
    book = RuleBook.from_dict({"scoring": {"anchor": 1.5, "youtube_category": 2, "source_multipliers": {"title": 3.0}}})
    assert book.kind_weight["anchor"] == 1.5 and book.kind_weight["entity"] == 6.0
    assert book.source_weight["title"] == 3.0 and book.official_weight == 2.0


def test_undated_cards_have_no_demand(spark):
    rows = [(1, ("1000", "5", None), None, None), (2, ("1000", None, None), "2026-08-20T00:00:00Z", None), (3, None, "no date", "70"), (4, (None, None, None), "2026-08-20T00:00:00Z", "70")]
    cards = spark.createDataFrame(rows, "id int, statistics struct<view_count: string, like_count: string, comment_count: string>, published_at string, view_count string")
    got = {r.id: r.popularity_profile for r in k.popularity(cards, F.lit("2026-08-21T00:00:00Z")).collect()}
    assert got[1].available and got[1].age_days is got[1].demand_signal is got[1].avg_views_per_day is None and got[1].like_count == 5
    assert got[2].age_days == 1.0 and got[2].avg_views_per_day == 1000.0
    assert got[3].view_count == 70 and got[3].demand_signal is None and got[4].avg_views_per_day == 70.0


@pytest.mark.parametrize("raw,share,margin,level", [
    (1.9, 1.0, 1.0, "unknown"), (2.0, 0.7, 0.35, "high"), (2.0, 0.5, 0.15, "medium"), (2.0, 0.5, 0.1, "low"),
])
def test_keyword_confidence(spark, raw, share, margin, level):
    assert spark.range(1).select(k.keyword_confidence(F.lit(raw), F.lit(share), F.lit(margin)).alias("x")).first().x == level


@pytest.mark.parametrize("raw,strong,sources,share,margin,level", [
    (7.0, 2, 1, 0.55, 0.15, "high"), (7.0, 1, 1, 0.9, 0.9, "medium"), (4.0, 1, 2, 0.55, 0.20, "high"),
    (4.0, 1, 1, 0.45, 0.0, "medium"), (4.0, 1, 1, 0.44, 0.0, "low"), (2.0, 0, 0, 0.1, 0.0, "low"), (1.9, 1, 1, 1.0, 1.0, "unknown"),
])
def test_content_confidence(spark, raw, strong, sources, share, margin, level):
    args = [F.lit(v) for v in (raw, strong, sources, share, margin)]
    assert spark.range(1).select(k.content_confidence(*args).alias("x")).first().x == level
