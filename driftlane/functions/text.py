"""Text expressions: folding, phrase tests, topics, hashtags, tag consistency.

Folding (NFKC + case folding) has no built-in Spark function. Text made only of
characters that NFKC keeps and whose case folding equals lower-casing is folded
by built-ins; only the rest goes, Arrow-batched, through a pandas UDF.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# UDF code travels with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = r"[\p{L}\p{N}_]"
NOT_AFTER_WORD = rf"(?<!{WORD})"
NOT_BEFORE_WORD = rf"(?!{WORD})"

# ASCII, Latin-1 letters without sharp s, Vietnamese letters, common punctuation.
# Runs of ASCII have a class of their own: one range is tested, not every alternative of a union.
_STABLE = (
    r"^[\x00-\x7F]*+(?:[À-ÖØ-Þà-öø-ÿĂăĐđĨĩŨũƠơƯư\x{1EA0}-\x{1EF9}"
    r"\x{2013}\x{2014}\x{2018}\x{2019}\x{201C}\x{201D}]++[\x00-\x7F]*+)*+$"
)
_BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
_BLANK_RUN = r"[ \t\n\x0B\f\r\x1C-\x1F]+"


def _fold_value(value, lower_only=False, collapse=False):
    if value is None:
        return None
    text = unicodedata.normalize("NFKC", value)
    text = text.lower() if lower_only else text.casefold()
    return " ".join(text.split()) if collapse else text.strip()


@F.pandas_udf(T.StringType())
def _fold_slow(text: pd.Series) -> pd.Series:
    return text.map(_fold_value, na_action="ignore")


@F.pandas_udf(T.StringType())
def _fold_lower_slow(text: pd.Series) -> pd.Series:
    return text.map(lambda v: _fold_value(v, lower_only=True), na_action="ignore")


@F.pandas_udf(T.StringType())
def _term_key_slow(text: pd.Series) -> pd.Series:
    return text.map(lambda v: _fold_value(v, collapse=True), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fold_list_slow(texts: pd.Series) -> pd.Series:
    return texts.map(lambda a: None if a is None else [_fold_value(v) for v in a], na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fold_lower_list_slow(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda a: None if a is None else [_fold_value(v, lower_only=True) for v in a], na_action="ignore"
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _term_key_list_slow(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda a: None if a is None else [_fold_value(v, collapse=True) for v in a], na_action="ignore"
    )


def _strip(col: Column) -> Column:
    return F.btrim(col, F.lit(_BLANKS))


def _plain(col: Column) -> Column:
    return F.rlike(col, F.lit(_STABLE))


def _either(col: Column, fast, slow) -> Column:
    col = F.coalesce(col, F.lit(""))
    # the UDF sees null for plain rows, so those cost no transfer
    return F.when(_plain(col), fast(col)).otherwise(slow(F.when(~_plain(col), col)))


def _either_list(col: Column, fast, slow) -> Column:
    col = F.filter(F.coalesce(col, F.array().cast("array<string>")), lambda x: x.isNotNull())
    plain = F.forall(col, _plain)
    return F.when(plain, F.transform(col, fast)).otherwise(slow(F.when(~plain, col)))


def fold_text(col: Column) -> Column:
    """NFKC + case folding + strip; inner blanks stay. Null becomes ''."""
    return _either(col, lambda c: _strip(F.lower(c)), _fold_slow)


def fold_lower(col: Column) -> Column:
    """NFKC + lower-casing + strip."""
    return _either(col, lambda c: _strip(F.lower(c)), _fold_lower_slow)


def term_key(col: Column) -> Column:
    """Folding with every run of blanks collapsed to one space."""
    return _either(col, lambda c: _strip(F.regexp_replace(F.lower(c), _BLANK_RUN, " ")), _term_key_slow)


def fold_texts(col: Column) -> Column:
    return _either_list(col, lambda c: _strip(F.lower(c)), _fold_list_slow)


def fold_lower_texts(col: Column) -> Column:
    return _either_list(col, lambda c: _strip(F.lower(c)), _fold_lower_list_slow)


def term_keys(col: Column) -> Column:
    return _either_list(
        col, lambda c: _strip(F.regexp_replace(F.lower(c), _BLANK_RUN, " ")), _term_key_list_slow
    )


def fold_phrase(phrase: str, lower_only: bool = False) -> str:
    """Folding of a dictionary phrase, done once on the driver."""
    return _fold_value(phrase, lower_only=lower_only)


def is_word(ch: str) -> bool:
    return ch == "_" or unicodedata.category(ch)[0] in "LN"


def quote(phrase: str) -> str:
    return "".join("\\" + c if c.isascii() and not c.isalnum() and c != "_" else c for c in phrase)


def phrase_pattern(phrase: str) -> str:
    """Java regex: the phrase with no word character on either side."""
    return NOT_AFTER_WORD + quote(phrase) + NOT_BEFORE_WORD


def contains_phrase(text: Column, phrase: str) -> Column:
    """Phrase test on folded text; the plain substring test runs first."""
    folded = fold_phrase(phrase)
    if not folded:
        return F.lit(False)
    return F.contains(text, F.lit(folded)) & F.rlike(text, F.lit(phrase_pattern(folded)))


def keyword_weight(keyword: str) -> float:
    """Weight of a dictionary keyword: longer is more specific, short is risky."""
    weight = 1.0 + 0.4 * (len(keyword.split()) - 1)
    if len(keyword) <= 2:
        return weight * 0.35
    return weight * 0.75 if len(keyword) <= 4 else weight


def keyword_weight_col(keyword: Column) -> Column:
    words = F.size(F.filter(F.split(keyword, r"\s+"), lambda w: w != ""))
    return (1.0 + 0.4 * (words - 1)) * (
        F.when(F.length(keyword) <= 2, 0.35).when(F.length(keyword) <= 4, 0.75).otherwise(1.0)
    )


def topic_label(topic: Column) -> Column:
    """Last path part of a topic address, URL-decoded, underscores as blanks."""
    tail = F.element_at(F.split(F.coalesce(topic, F.lit("")), "/"), -1)
    # '+' is no blank in a path, and a malformed escape leaves the text as it is
    decoded = F.coalesce(F.try_url_decode(F.replace(tail, F.lit("+"), F.lit("%2B"))), tail)
    return _strip(F.translate(decoded, "_", " "))


def hashtags(title: Column, description: Column) -> Column:
    """Hashtags (2..64 characters) of title and description, in order."""
    text = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")))
    return F.regexp_extract_all(text, F.lit(NOT_AFTER_WORD + r"#([\p{L}\p{N}_-]{2,64})"), F.lit(1))


def first_per_key(values: Column, keys: Column) -> Column:
    """Values whose key is not blank and did not occur earlier in the array."""
    def first(_, i):
        key = F.element_at(keys, i + 1)
        return (key != "") & (F.array_position(keys, key) == i + 1)

    clean = (F.size(F.array_distinct(keys)) == F.size(keys)) & ~F.array_contains(keys, "")
    return F.when(clean, values).otherwise(F.filter(values, first))


def tag_consistency(tag_key: Column, content: Column, topics: Column | None = None) -> Column:
    """How well a tag is backed by the visible text of its card.

    ``tag_key``, ``content`` and ``topics`` are term keys. With ``topics`` the
    session scale applies (1, .85, .65, .70 by topic, .40); without, the
    subscription scale (1, .85, .60, .35), which also keeps a leading '#'.
    """
    key = F.ltrim(tag_key, F.lit("#")) if topics is not None else tag_key
    tokens = F.filter(
        F.regexp_extract_all(key, F.lit(rf"{WORD}+"), F.lit(0)), lambda t: F.length(t) >= 3
    )
    hit = F.size(F.filter(tokens, lambda t: F.contains(content, t))) / F.nullif(F.size(tokens), F.lit(0))
    partial, rest = (0.65, 0.40) if topics is not None else (0.60, 0.35)
    out = (
        F.when(key == "", 0.0)
        .when(F.contains(content, key), 1.0)
        .when(hit >= 0.75, 0.85)
        .when(hit >= 0.40, partial)
    )
    if topics is not None:
        out = out.when(F.exists(tokens, lambda t: F.contains(topics, t)), 0.70)
    return out.otherwise(rest)
