"""Card classification over ``documents``.

Title = first line, description = the other lines, channel = source, tags =
(lang, source), official code = doc_id % 9. The dictionary holds function words
of four languages.
"""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import functions as F

from driftlane.bindings import bound, table
from driftlane.functions import text
from driftlane.functions import weights as wt
from driftlane.functions.plan import spread
from driftlane.operators import classify as k
from driftlane.sources import schemas
from driftlane.sources.rulebook import RuleBook, tables_of

DICTIONARY = {
    "categories": [
        {"id": "en", "youtube_video_category_ids": [1], "entities": ["of the", "it is"],
         "anchors": ["the", "and", "with"], "support": ["that", "this", "on", "by"],
         "keywords": ["the", "and the", "with", "of", "that this"]},
        {"id": "fr", "youtube_video_category_ids": [2, 5], "entities": ["les des", "que le"],
         "anchors": ["le", "les", "des", "fr"], "support": ["qui", "un", "sur", "la"],
         "keywords": ["le", "les", "dans", "des"]},
        {"id": "de", "youtube_video_category_ids": [3], "entities": ["und der"],
         "anchors": ["der", "die", "und", "de"], "support": ["mit", "das", "von", "ist"],
         "keywords": ["der", "und", "nicht", "das ist"]},
        {"id": "es", "youtube_video_category_ids": [], "entities": ["el que"],
         "anchors": ["el", "los", "por"], "support": ["que", "con", "una", "la"],
         "keywords": ["el", "los", "para", "con"]},
    ],
    "intents": {
        "listing": {"anchors": ["and ", "und", "y"]},
        "pointing": {"anchors": ["this", "that", "das", "este", "that this"]},
        "place": {"anchors": ["in", "on", "sur", "src3"]},
    },
}
BOOK = RuleBook.from_dict(DICTIONARY)

_CARDS = r"""
cards AS (SELECT doc_id, split_part(text, chr(10), 1) AS title,
    CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) END AS description,
    source AS channel, lang, doc_id % 9 AS official FROM documents),
texts AS (
  SELECT doc_id, 'title' AS src, 0 AS no, lower(title) AS t FROM cards UNION ALL
  SELECT doc_id, 'channel', 0, lower(channel) FROM cards UNION ALL
  SELECT doc_id, 'tags', 0, lower(lang) FROM cards UNION ALL
  SELECT doc_id, 'tags', 1, lower(channel) FROM cards UNION ALL
  SELECT doc_id, 'description', 0, lower(description) FROM cards WHERE description IS NOT NULL)
"""


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def _matches(name: str, columns: str, rows: list[tuple], source: str = "texts") -> str:
    """Texts that hold a phrase; one constant pattern per phrase (the last column)."""
    names = [c.strip() for c in columns.split(",")]
    parts = []
    for row in rows:
        values = ", ".join(f"{repr(v) if isinstance(v, str) else v} AS {n}" for n, v in zip(names, row))
        pattern = rf"(^|[^\p{{L}}\p{{N}}_]){row[-1]}($|[^\p{{L}}\p{{N}}_])"
        parts.append(f"SELECT doc_id, src, {values} FROM {source} WHERE regexp_matches(t, '{pattern}')")
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


_ORDER = {c[0]: n for n, c in enumerate(BOOK.categories)}
_RULES = _matches("matched", "cat, ord, kind, phrase", [(r.owner, _ORDER[r.owner], r.kind, r.phrase) for r in BOOK.rules if r.kind != "keyword"])
_OFFICIAL = _values("official", "cat, ord, code", [(c[0], n, code) for n, c in enumerate(BOOK.categories) for code in c[2]])
_KEYWORDS = _matches("matched", "cat, ord, phrase", [(r.owner, _ORDER[r.owner], r.phrase) for r in BOOK.rules if r.kind == "keyword"])
_INTENTS = _matches("matched", "cat, ord, phrase", [
    (r.owner, [i[0] for i in BOOK.intents].index(r.owner), r.phrase.strip()) for r in BOOK.intent_rules], "it")

_KIND = "CASE kind WHEN 'entity' THEN 6.0 WHEN 'anchor' THEN 4.0 ELSE 1.0 END"
_MULT = "CASE src WHEN 'title' THEN 1.0 WHEN 'channel' THEN 0.6 WHEN 'tags' THEN 0.9 ELSE 0.45 END"
_TARGET = "CASE src WHEN 'title' THEN 0.55 WHEN 'channel' THEN 0.15 WHEN 'tags' THEN 1.0 ELSE 0.5 END"


_SECOND_KIND = "CASE kind WHEN 'entity' THEN 5.0 WHEN 'anchor' THEN 2.5 ELSE 1.5 END"
_SECOND_MULT = "CASE src WHEN 'title' THEN 0.8 WHEN 'channel' THEN 0.6 WHEN 'tags' THEN 0.3 ELSE 0.9 END"
SECOND_SCORING = {"entity": 5.0, "anchor": 2.5, "support": 1.5, "youtube_category": 3.0, "source_multipliers": {"title": 0.8, "tags": 0.3, "description": 0.9}}
# a dictionary of thousands of phrases: every long word of the documents
_MANY = r"""
vocab AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS phrase FROM documents),
rules AS (SELECT phrase, CASE WHEN length(phrase) % 3 = 0 THEN 'even' ELSE 'odd' END AS cat, CASE WHEN length(phrase) % 3 = 0 THEN 0 ELSE 1 END AS ord,
  CASE WHEN length(phrase) % 2 = 0 THEN 'anchor' ELSE 'support' END AS kind FROM vocab WHERE length(phrase) BETWEEN 9 AND 14),
toks AS (SELECT DISTINCT doc_id, src, no, unnest(regexp_extract_all(t, '[\p{L}\p{N}_]+')) AS phrase FROM texts),
matched AS (SELECT DISTINCT doc_id, src, cat, ord, kind, phrase FROM toks JOIN rules USING (phrase))
"""


def _scored(mult: str, official: bool, rules: str | None = None, codes: str | None = None, kinds: str = "", worth: float = 7.0) -> str:
    bonus = (
        f"UNION ALL SELECT doc_id, cat, ord, 'official', 'official', code::VARCHAR, {worth} FROM cards JOIN official ON code = official"
        if official else ""
    )
    return rf"""
{_CARDS}, {rules or _RULES}, {codes or _OFFICIAL},
hits AS (SELECT doc_id, cat, ord, kind, src, phrase, {kinds or _KIND} * {mult} AS s FROM matched),
strong AS (SELECT DISTINCT doc_id, cat FROM hits WHERE kind <> 'support'),
ev AS (SELECT h.* FROM hits h SEMI JOIN strong USING (doc_id, cat) {bonus}),
sc AS (SELECT doc_id, cat, ord, CAST(sum(s) AS DOUBLE) AS score, count(*) FILTER (kind <> 'support') AS n_strong,
         count(DISTINCT src) FILTER (kind <> 'support') AS n_src, count(*) AS n_ev FROM ev GROUP BY ALL),
rk AS (SELECT *, score / sum(score) OVER (PARTITION BY doc_id) AS share,
         row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, ord) AS rank FROM sc),
top AS (SELECT doc_id, max(cat) FILTER (rank = 1) AS cat, max(score) FILTER (rank = 1) AS raw, max(share) FILTER (rank = 1) AS share,
          max(share) FILTER (rank = 1) - coalesce(max(share) FILTER (rank = 2), 0) AS margin,
          max(n_strong) FILTER (rank = 1) AS n_strong, max(n_src) FILTER (rank = 1) AS n_src FROM rk GROUP BY doc_id),
kept AS (SELECT rk.* FROM rk JOIN top USING (doc_id) WHERE rk.share >= greatest(0.08, top.share * 0.18)),
decided AS (SELECT doc_id, top.cat AS top_category,
    CASE WHEN raw IS NULL THEN 'unknown'
         WHEN raw >= 7 AND n_strong >= 2 AND share >= 0.55 AND margin >= 0.15 THEN 'high'
         WHEN raw >= 4 AND n_strong >= 1 AND share >= 0.45
           THEN CASE WHEN n_src >= 2 AND share >= 0.55 AND margin >= 0.20 THEN 'high' ELSE 'medium' END
         WHEN raw >= 2 THEN 'low' ELSE 'unknown' END AS confidence,
    round_even(CAST(coalesce(share, 0) AS DOUBLE), 4) AS top_share, round_even(CAST(coalesce(margin, 0) AS DOUBLE), 4) AS margin
  FROM cards LEFT JOIN top USING (doc_id))
"""


def cards(spark, sf_dir):
    body = F.col("text")
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id",
        F.substring_index(body, "\n", 1).alias("title"),
        F.when(F.instr(body, "\n") > 0, F.substr(body, F.instr(body, "\n") + 1)).alias("description"),
        F.col("source").alias("channel"),
        F.array("lang", "source").alias("tags"),
        (F.col("doc_id") % 9).cast("string").alias("youtube_category_id"),
        F.lit(None).cast("array<string>").alias("youtube_topics"),
    )


def content(spark, sf_dir):
    found = k.with_rule_numbers(k.with_folded_sources(cards(spark, sf_dir)), SCORED_BOOK)
    return k.hold(k.classify_content(found, SCORED_BOOK), "classification", "target_profile")


SCORED_BOOK = RuleBook(
    BOOK.categories, tuple(r for r in BOOK.rules if r.kind != "keyword"), BOOK.intents, BOOK.intent_rules
)


def _vector(df, column):
    return df.select("doc_id", F.explode(f"{column}.categories").alias("c")).select(
        "doc_id", F.col("c.id").alias("category_id"), F.col("c.share").alias("share"), F.col("c.raw_score").alias("raw_score")
    )


_VECTOR_SQL = "SELECT doc_id, cat AS category_id, round_even(CAST(share AS DOUBLE), 4) AS share, round_even(score, 3) AS raw_score FROM kept"


@bound("classify_v2", f"WITH {_scored(_MULT, True)} SELECT * FROM decided")
def classify_v2(spark, sf_dir):
    c = "classification"
    return content(spark, sf_dir).select(
        "doc_id", f"{c}.top_category", f"{c}.confidence", f"{c}.top_share", f"{c}.margin"
    )


@bound("classify_vector", f"WITH {_scored(_MULT, True)} {_VECTOR_SQL}")
def classify_vector(spark, sf_dir):
    return _vector(content(spark, sf_dir), "classification")


@bound("classify_second_scoring", f"WITH {_scored(_SECOND_MULT, True, kinds=_SECOND_KIND, worth=3.0)} {_VECTOR_SQL}")
def classify_second_scoring(spark, sf_dir):
    book = RuleBook.from_dict(DICTIONARY | {"scoring": SECOND_SCORING})
    book = dataclasses.replace(book, rules=SCORED_BOOK.rules)
    found = k.with_rule_numbers(k.with_folded_sources(cards(spark, sf_dir)), book)
    return _vector(k.hold(k.classify_content(found, book), "classification"), "classification")


def rule_tables(spark, dictionary):
    """Rule tables of a dictionary, through its JSON document.

    The document is a column of a range: of rows handed over by Python, Spark does not know the
    size, so that the join with them shuffled every token sequence of the documents by phrase.
    """
    line = spark.range(1).select(F.lit(json.dumps(dictionary)).alias("value"))
    return tables_of(line.select(F.from_json("value", " ".join(schemas.RULES.split())).alias("d")).select("d.*"))


@bound("classify_by_join", f"WITH {_scored(_MULT, True)} {_VECTOR_SQL}")
def classify_by_join(spark, sf_dir):
    return _vector(k.classify_with_tables(cards(spark, sf_dir), "doc_id", rule_tables(spark, DICTIONARY), suppressions=()), "classification")


@bound("classify_many_phrases", f"""
WITH {_scored(_MULT, True, _MANY, _values("official", "cat, ord, code", [("even", 0, 1), ("odd", 1, 2)]))} {_VECTOR_SQL}
""")
def classify_many_phrases(spark, sf_dir):
    tables = rule_tables(spark, {
        "categories": [{"id": "even", "youtube_video_category_ids": [1]}, {"id": "odd", "youtube_video_category_ids": [2]}], "intents": {}})
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"))).alias("phrase")).distinct()
    size = F.length("phrase")
    tables["rules"] = words.filter(size.between(9, 14)).select(
        F.when(size % 3 == 0, 0).otherwise(1).alias("category_no"), F.when(size % 3 == 0, "even").otherwise("odd").alias("category_id"),
        F.when(size % 2 == 0, "anchor").otherwise("support").alias("kind"), F.lit(0).alias("kind_no"), F.abs(F.hash("phrase")).alias("place"), "phrase")
    return _vector(k.classify_with_tables(cards(spark, sf_dir), "doc_id", tables, suppressions=()), "classification")


IDIOM = ("en", "the", r"(?:in|of)\s+the")
_HIDING = _matches("loud", "cat, ord, kind, phrase", [
    (r.owner, _ORDER[r.owner], r.kind, r.phrase) for r in BOOK.rules if r.kind != "keyword" and (r.owner, r.phrase) != IDIOM[:2]]) + rf""",
matched AS (SELECT * FROM loud UNION ALL SELECT doc_id, src, 'en', {_ORDER['en']}, 'anchor', 'the' FROM texts
  WHERE regexp_matches(t, '(^|[^\p{{L}}\p{{N}}_])the($|[^\p{{L}}\p{{N}}_])') AND NOT regexp_matches(t, '(in|of)\s+the'))"""


@bound("classify_suppressed", f"WITH {_scored(_MULT, True, _HIDING)} {_VECTOR_SQL}")
def classify_suppressed(spark, sf_dir):
    """A dictionary document with a suppression of its own, read as tables."""
    return _vector(k.classify_with_tables(cards(spark, sf_dir), "doc_id", rule_tables(spark, DICTIONARY | {"suppressions": [list(IDIOM)]})), "classification")


@bound("classify_evidence", f"""
WITH {_scored(_MULT, True)}
SELECT ev.doc_id, ev.cat AS category_id, CASE kind WHEN 'official' THEN 'official_category' ELSE kind END AS kind,
  count(*) AS hits, round(CAST(sum(s) AS DOUBLE), 6) AS score
FROM ev SEMI JOIN kept ON ev.doc_id = kept.doc_id AND ev.cat = kept.cat GROUP BY ALL
""")
def classify_evidence(spark, sf_dir):
    rows = content(spark, sf_dir).select("doc_id", F.explode("classification.evidence").alias("category_id", "e"))
    return rows.select("doc_id", "category_id", F.explode("e").alias("h")).groupBy(
        "doc_id", "category_id", F.col("h.kind").alias("kind")
    ).agg(F.count("*").alias("hits"), F.round(F.sum("h.score"), 6).alias("score"))


@bound("target_profile", f"WITH {_scored(_TARGET, False)} {_VECTOR_SQL}")
def target_profile(spark, sf_dir):
    return _vector(content(spark, sf_dir), "target_profile")


_INTENT_SQL = rf"""
WITH {_CARDS},
it AS (SELECT doc_id, src, t FROM texts WHERE src IN ('title', 'description')
       UNION ALL SELECT doc_id, 'tags', lower(concat(lang, ' ', channel)) FROM cards),
{_INTENTS},
hits AS (SELECT doc_id, cat, ord, 2.0 * CASE src WHEN 'title' THEN 1.0 WHEN 'description' THEN 0.35 ELSE 0.65 END AS s
         FROM matched),
sc AS (SELECT doc_id, cat, ord, CAST(sum(s) AS DOUBLE) AS score FROM hits GROUP BY ALL),
sh AS (SELECT *, score / sum(score) OVER (PARTITION BY doc_id) AS share FROM sc)
SELECT doc_id, cat AS intent_id, round_even(CAST(share AS DOUBLE), 4) AS share,
  first_value(cat) OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, ord) AS top_intent
FROM sh WHERE share >= 0.10
"""


def _intent_rows(df):
    rows = k.hold(df, "intent_profile").select("doc_id", "intent_profile.top_intent", F.explode("intent_profile.intents").alias("i"))
    return rows.select("doc_id", F.col("i.id").alias("intent_id"), F.col("i.share").alias("share"), "top_intent")


@bound("intents", _INTENT_SQL)
def intents(spark, sf_dir):
    return _intent_rows(k.classify_intent(k.with_folded_sources(cards(spark, sf_dir)), BOOK))


@bound("intents_by_join", _INTENT_SQL)
def intents_by_join(spark, sf_dir):
    return _intent_rows(k.classify_with_tables(cards(spark, sf_dir), "doc_id", rule_tables(spark, DICTIONARY)))


_V1 = rf"""
{_CARDS}, {_KEYWORDS}, {_OFFICIAL},
hits AS (SELECT doc_id, cat, ord,
    CASE src WHEN 'title' THEN 5.0 WHEN 'channel' THEN 0.5 WHEN 'tags' THEN 2.5 ELSE 1.5 END
    * (1 + 0.4 * (len(string_split(phrase, ' ')) - 1))
    * CASE WHEN length(phrase) <= 2 THEN 0.35 WHEN length(phrase) <= 4 THEN 0.75 ELSE 1.0 END AS s
  FROM matched
  UNION ALL SELECT doc_id, cat, ord, 8.0 FROM cards JOIN official ON code = official),
sc AS (SELECT doc_id, cat, ord, CAST(sum(s) AS DOUBLE) AS score FROM hits GROUP BY ALL),
rk AS (SELECT *, score / sum(score) OVER (PARTITION BY doc_id) AS share,
         row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, ord) AS rank FROM sc),
top AS (SELECT doc_id, max(cat) FILTER (rank = 1) AS cat, max(score) FILTER (rank = 1) AS raw, max(share) FILTER (rank = 1) AS share,
          max(share) FILTER (rank = 1) - coalesce(max(share) FILTER (rank = 2), 0) AS margin FROM rk GROUP BY doc_id),
decided AS (SELECT doc_id, top.cat AS top_category,
    CASE WHEN coalesce(raw, 0) < 2 THEN 'unknown' WHEN share >= 0.70 AND margin >= 0.35 THEN 'high'
         WHEN share >= 0.50 AND margin >= 0.15 THEN 'medium' ELSE 'low' END AS confidence,
    round_even(CAST(coalesce(share, 0) AS DOUBLE), 4) AS top_share, round_even(CAST(coalesce(margin, 0) AS DOUBLE), 4) AS margin,
    (SELECT count(*) FROM rk WHERE rk.doc_id = cards.doc_id AND rk.share >= greatest(0.12, top.share * 0.25)) AS categories
  FROM cards LEFT JOIN top USING (doc_id))
"""


def keyword_cards(spark, sf_dir):
    return k.classify_keywords(cards(spark, sf_dir), BOOK)


@bound("classify_v1", f"WITH {_V1} SELECT * FROM decided")
def classify_v1(spark, sf_dir):
    c = "classification"
    return keyword_cards(spark, sf_dir).select(
        "doc_id", f"{c}.top_category", f"{c}.confidence", f"{c}.top_share", f"{c}.margin",
        F.size(f"{c}.categories").cast("bigint").alias("categories"),
    )


def _summary_sql(body):
    return f"""
WITH {body}
SELECT count(*) AS item_count, count(*) FILTER (confidence = 'high') AS high_count, count(*) FILTER (confidence = 'medium') AS medium_count,
  count(*) FILTER (confidence = 'low') AS low_count, count(*) FILTER (confidence = 'unknown') AS unknown_count,
  round_even(CAST(count(*) FILTER (confidence <> 'unknown') / count(*) AS DOUBLE), 4) AS classified_rate,
  round_even(CAST(count(*) FILTER (confidence IN ('high', 'medium')) / count(*) AS DOUBLE), 4) AS high_medium_rate,
  round_even(CAST(count(*) FILTER (confidence IN ('low', 'unknown')) / count(*) AS DOUBLE), 4) AS ambiguous_rate,
  round_even(CAST(avg(margin) AS DOUBLE), 4) AS average_margin FROM decided
"""


@bound("classification_summary", _summary_sql(_scored(_MULT, True)))
def classification_summary(spark, sf_dir):
    return k.summarize(content(spark, sf_dir))


@bound("classification_summary_v1", _summary_sql(_V1))
def classification_summary_v1(spark, sf_dir):
    return k.summarize(keyword_cards(spark, sf_dir))


@bound("top_category_counts", f"""
WITH {_scored(_MULT, True)} SELECT top_category AS category_id, count(*) AS item_count FROM decided WHERE top_category IS NOT NULL GROUP BY ALL
""")
def top_category_counts(spark, sf_dir):
    return k.top_category_counts(content(spark, sf_dir))


@bound("phrase_test", rf"""
WITH it AS (SELECT doc_id, '' AS src, lower(text) AS t FROM documents),
{_matches("matched", "phrase", [(p,) for p in ("the", "le", "der", "el", "it is")], "it")}
SELECT phrase, count(*) AS documents FROM matched GROUP BY ALL
""")
def phrase_test(spark, sf_dir):
    folded_text = text.fold_text(F.col("text"))
    phrases = ["the", "le", "der", "el", "it is"]
    tests = table(spark, sf_dir, "documents").select(
        *[F.count_if(text.contains_phrase(folded_text, p)).alias(p) for p in phrases]
    )
    return tests.unpivot([], phrases, "phrase", "documents")


@bound("fold_terms", r"""
SELECT conv_id, turn, trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\s]+', ' ', 'g')) AS key FROM conversations
""")
def fold_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", text.term_key(F.col("text")).alias("key"))


@bound("keyword_weights", """
SELECT p_partkey, round((1 + 0.4 * (len(list_filter(string_split(w, ' '), lambda x: x <> '')) - 1)) * CASE WHEN length(w) <= 2 THEN 0.35 WHEN length(w) <= 4 THEN 0.75 ELSE 1.0 END, 6) AS weight
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, 4) ELSE substr(p_name, 1, 2) END AS w FROM part)
""")
def keyword_weights(spark, sf_dir):
    name = F.col("p_name")
    word = F.when(F.col("p_partkey") % 3 == 0, name).when(F.col("p_partkey") % 3 == 1, F.substring(name, 1, 4)).otherwise(F.substring(name, 1, 2))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.keyword_weight_col(word), 6).alias("weight"))


@bound("topic_labels", """
SELECT page_id, replace(url_decode(replace(list_extract(string_split(concat(url, '/part_', page_id, '%20a+b'), '/'), -1), '+', '%2B')), '_', ' ') AS label FROM pages
""")
def topic_labels(spark, sf_dir):
    url = F.concat(F.col("url"), F.lit("/part_"), F.col("page_id"), F.lit("%20a+b"))
    return table(spark, sf_dir, "pages").select("page_id", text.topic_label(url).alias("label"))


@bound("hashtags", r"""
WITH t AS (SELECT doc_id, concat('#', source, ' ', lang, '#x #', lang, chr(10), text, ' #a #', source) AS t FROM documents)
SELECT doc_id, array_to_string(regexp_extract_all(t, '(?:^|[^\p{L}\p{N}_])#([\p{L}\p{N}_-]{2,64})', 1), ',') AS tags FROM t
""")
def hashtags(spark, sf_dir):
    title = F.concat(F.lit("#"), F.col("source"), F.lit(" "), F.col("lang"), F.lit("#x #"), F.col("lang"))
    description = F.concat(F.col("text"), F.lit(" #a #"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.hashtags(title, description), ",").alias("tags"))


@bound("tag_consistency", r"""
WITH t AS (SELECT doc_id, lower(text) AS c, string_split(lower(split_part(text, chr(10), 1)), ' ') AS w FROM documents),
k AS (SELECT doc_id, c, concat(coalesce(w[1], ''), ' zzz ', coalesce(w[3], '')) AS key FROM t),
tok AS (SELECT *, list_filter(regexp_extract_all(key, '[\p{L}\p{N}_]+'), lambda x: length(x) >= 3) AS toks FROM k),
sc AS (SELECT *, CASE WHEN len(toks) > 0 THEN len(list_filter(toks, lambda x: contains(c, x))) / len(toks) END AS hit FROM tok)
SELECT doc_id, CASE WHEN contains(c, key) THEN 1.0 WHEN hit >= 0.75 THEN 0.85 WHEN hit >= 0.40 THEN 0.65 ELSE 0.40 END AS session_scale,
  CASE WHEN contains(c, key) THEN 1.0 WHEN hit >= 0.75 THEN 0.85 WHEN hit >= 0.40 THEN 0.60 ELSE 0.35 END AS subscription_scale
FROM sc
""")
def tag_consistency(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = F.split(F.lower(F.substring_index("text", "\n", 1)), " ")
    key = F.concat(F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.lit(" zzz "), F.coalesce(F.get(words, F.lit(2)), F.lit("")))
    rows = docs.select("doc_id", F.lower("text").alias("content"), key.alias("key"))
    return rows.select(
        "doc_id",
        text.tag_consistency(F.col("key"), F.col("content"), F.lit("")).alias("session_scale"),
        text.tag_consistency(F.col("key"), F.col("content")).alias("subscription_scale"),
    )


@bound("popularity", """
WITH o AS (SELECT *, CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 OR o_orderkey % 7 = 0 THEN NULL
    ELSE greatest(1.0, datediff('minute', o_orderdate, (SELECT max(o_orderdate) FROM orders)) / 60.0 + 37 / 60.0) END AS h,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS v0 FROM orders),
  p AS (SELECT *, v0 AS v, CASE WHEN v0 IS NOT NULL THEN h END AS hv FROM o)
SELECT o_orderkey, v AS view_count,  round_even(CAST(hv / 24.0 AS DOUBLE), 3) AS age_days, round_even(CAST(v / (hv / 24.0) AS DOUBLE), 2) AS per_day,
  CASE WHEN hv IS NOT NULL THEN round_even(CAST(least(1.0, log10(greatest(1.0, v / (hv / 24.0) + 1)) / 6) AS DOUBLE), 4) END AS demand,
  CASE WHEN hv IS NULL THEN 0.30 ELSE round(greatest(0.15, least(1.0, 1 / (1 + log10(1 + round(hv / 24.0, 3))))), 6) END AS freshness
FROM p
""")
def popularity(spark, sf_dir):
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = orders.select(
        "o_orderkey",
        F.struct(
            F.when((key % 5 != 0) & (key % 11 != 0), F.floor("o_totalprice").cast("string")).alias("view_count"), F.lit("x").alias("like_count"), F.lit(None).cast("string").alias("comment_count")
        ).alias("statistics"),
        F.when(key % 7 == 0, "not a date").when(~((key % 3 == 1) & (key % 2 == 0)), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("published_at"),
        F.when(key % 5 == 0, key).alias("view_count"),
    )
    newest = orders.agg(F.max("o_orderdate") + F.expr("INTERVAL 37 MINUTES")).scalar()
    out = k.popularity(rows, newest).withColumn("p", F.col("popularity_profile"))
    return out.select(
        "o_orderkey", F.col("p.view_count").alias("view_count"), F.col("p.age_days").alias("age_days"), F.col("p.avg_views_per_day").alias("per_day"),
        F.col("p.demand_signal").alias("demand"), F.round(wt.freshness(F.col("p.age_days")), 6).alias("freshness"),
    )
