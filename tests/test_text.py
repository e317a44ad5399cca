import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from driftlane.functions import identity, text
from driftlane.operators.classify import PhraseFinder


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(col.alias("x")).first()["x"]


TEXTS = [
    "Plain ASCII  text ", "Straße in KÖLN", "Ｆｕｌｌ Ｗｉｄｔｈ", "a b c", "Việt NAM Ầ", "ﬁne ½ ①", "İstanbul",
    "école", "\t tab\nline  ", "", "ΣΊΣΥΦΟΣ", "“quote” – dash",
]


def test_folding_equals_nfkc_casefold(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r.t: r for r in rows.select(
        "t", text.fold_text(F.col("t")).alias("fold"), text.fold_lower(F.col("t")).alias("low"),
        text.term_key(F.col("t")).alias("key"), text.term_keys(F.array("t", F.lit("X  Y"))).alias("keys"),
    ).collect()}
    for t in TEXTS:
        n = unicodedata.normalize("NFKC", t)
        assert got[t].fold == n.casefold().strip(), t
        assert got[t].low == n.lower().strip(), t
        assert got[t].key == re.sub(r"\s+", " ", n.casefold()).strip(), t
        assert got[t].keys == [got[t].key, "x y"]


def test_null_folds_to_blank(spark):
    assert one(spark, text.fold_text(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize("content,phrase,hit", [
    ("said it", "ai", False), ("ai said", "ai", True), ("été là", "t", False), ("(ai)", "ai", True),
    ("a_ai", "ai", False), ("c++ now", "c++", True), ("r&b mix", "r&b", True), ("game  show", "game show", False),
])
def test_phrase_boundaries(spark, content, phrase, hit):
    assert one(spark, text.contains_phrase(F.lit(content), phrase)) is hit


def test_phrase_finder_equals_one_regex_per_phrase(spark):
    rng = random.Random(5)
    parts = ["a", "ab", "é", "b c", "a b", "a-b", "#a", "c++", "ab c", "b", "_a", "ß1", "a b c", "1"]
    phrases = sorted({" ".join(rng.sample(parts, rng.choice([1, 1, 2]))) for _ in range(25)} | set(parts))
    texts = ["".join(rng.choice(["a", "b", "c", " ", "-", "é", "#", "+", "_", "1", "ß"]) for _ in range(40)) for _ in range(300)]
    finder = PhraseFinder(phrases)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", finder.find(F.col("t")).alias("f")).collect()
    for row in rows:
        want = [i for i, p in enumerate(phrases) if re.search(r"(?<!\w)" + re.escape(p) + r"(?!\w)", row.t)]
        assert row.f == want, row.t


@pytest.mark.parametrize("address,label", [
    ("https://x.org/wiki/Video_game_culture", "Video game culture"), ("a+b%20c", "a+b c"), ("100%", "100%"), ("", ""),
])
def test_topic_label(spark, address, label):
    assert one(spark, text.topic_label(F.lit(address))) == label


def test_hashtags_first_per_key(spark):
    tags = text.hashtags(F.lit("#Go x#no #go"), F.lit("#a #Được-1"))
    rows = spark.range(1).select(tags.alias("t")).withColumn("k", text.term_keys(F.col("t")))
    row = rows.select("t", text.first_per_key(F.col("t"), F.col("k")).alias("f")).first()
    assert row.t == ["Go", "go", "Được-1"]
    assert row.f == ["Go", "Được-1"]


@pytest.mark.parametrize("tag,content,topics,session,subscription", [
    ("red car", "my red car", "", 1.0, 1.0),
    ("one two tri four", "one x two x four", "", 0.85, 0.85),
    ("one zzz", "one only", "", 0.65, 0.60),
    ("zzz", "nothing", "a zzz topic", 0.70, 0.35),
    ("zzz", "nothing", "", 0.40, 0.35),
    ("ab", "nothing", "", 0.40, 0.35),
    ("", "x", "", 0.0, 0.0),
])
def test_tag_consistency(spark, tag, content, topics, session, subscription):
    assert one(spark, text.tag_consistency(F.lit(tag), F.lit(content), F.lit(topics))) == session
    assert one(spark, text.tag_consistency(F.lit(tag), F.lit(content))) == subscription


def test_keyword_weight(spark):
    for word, want in [("ai", 0.35), ("game", 0.75), ("gaming", 1.0), ("hip hop", 1.4), ("a b", 1.4 * 0.75)]:
        assert text.keyword_weight(word) == pytest.approx(want)
        assert one(spark, text.keyword_weight_col(F.lit(word))) == pytest.approx(want)


def test_clicks(spark):
    def browser(label, box, pressed):
        return one(spark, identity.browser_click_event(F.lit(label), F.lit(box), F.lit(pressed).cast("string")))

    assert tuple(browser("Dislike this", False, "true")) == ("dislike", 0.95)
    assert tuple(browser("Dislike this", False, "false")) == ("undislike", 0.95)
    assert tuple(browser("I like this", False, None)) == ("like", 0.7)
    assert browser("Unlikely", False, None) is None
    assert tuple(browser("Gửi", True, None)) == ("comment_submit", 0.95)
    assert browser("Gửi", False, None) is None
    device = one(spark, identity.device_click_event(F.lit("Post comment now"), F.lit(False)))
    assert tuple(device) == ("comment_submit", 1.0, 0.9)


def test_identity(spark):
    who = one(spark, identity.profile_identity(F.lit("browser-12-34-56-78-90"), F.lit(None).cast("string")))
    assert tuple(who) == ("browser-12-34-56-78-90", "Profile 12345678", "12345678")
    assert one(spark, identity.profile_short_id(F.lit("browser-"))) == "legacy"
    assert one(spark, identity.safe_token(F.lit("a b/c"))) == "abc"


def test_plain_texts_are_told_as_before(spark):
    """the test whether built-ins can fold a text keeps its answers; it costs one range a character of ASCII."""
    old = "^[\\x00-\\x7FÀ-ÖØ-Þà-öø-ÿĂăĐđĨĩŨũƠơƯư\\x{1EA0}-\\x{1EF9}\\x{2013}\\x{2014}\\x{2018}\\x{2019}\\x{201C}\\x{201D}]*$"
    draw = random.Random(2)
    texts = ["".join(draw.choices("ab \n\r\u0085\u2028é×ßĂ—ạ日\U00020000", k=draw.randint(0, 5))) for _ in range(400)] + ["aé" * 50_000, "日", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.filter(~text._plain(F.col("t")).eqNullSafe(F.rlike("t", F.lit(old)))).count() == 0
