"""Personal data: patterns for direct identifiers, and terms that give them away.

Addresses, card and phone numbers are found by patterns. The rest is information-theoretic: for a
term and a protected value, the corpus says how often the term occurs, in how many of those places
the value stands within ``NEAR`` words, and so how likely the value is given the term. Terms whose
disclosure reaches the threshold are generalised wherever they occur. Places are counted by
fingerprint (the least word hashes before and after the term), so that copies of one passage count once.
Words inside a direct identifier are no places of a term.

A null text has no spans and stays null. Rows with the same id and text get the same spans. A null
id is a value like any other. Spans count code points, end exclusive. Extra columns pass through
``sanitise`` and are ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.llm.base import bound, held, table
from driftlane.llm.words import Words, give_back, mix, slices

KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits is tried from its first one only, and never given back: same matches, linear time on long runs.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")

#: Words on each side of a term that are its surroundings.
NEAR = 8
#: Places in which term and value must stand together, and the likelihood of the value given the term.
PLACES, DISCLOSURE = 4, 0.8
#: Letters only: ASCII letters and every byte beyond ASCII.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False
MARKS = 1 << 20
SPANS = "array<struct<start:long,kind:int,end:long>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def small(part: str) -> bool:
    """Whether digits, however many, make a number up to 255."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL, tried only from the start of the run of local signs before each @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        hit = EMAIL.match(text, start) if start < at else None
        if hit:
            yield hit.span()
            done = hit.end()
        at = text.find("@", max(at + 1, done))


def identifiers(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of every direct identifier, by start, then kind."""
    found = [(s, 0, e, text[s:e].lower()) for s, e in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end(), m.group()) for m in IP.finditer(text) if all(map(small, m.group().split(".")))]
        for kind, pattern, least, most in ((2, CARD, 12, 19), (3, PHONE, 9, 15)):
            if kind == 3 and "+" not in text:
                continue
            for m in pattern.finditer(text):
                digits = NOT_DIGIT.sub("", m.group())
                if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                    found.append((m.start(), kind, m.end(), digits))
    return sorted(found)


def value_hash(kind: int, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def fingerprints(hashes: np.ndarray, text_of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The least hashes among the NEAR words before and after each place, within its text, as one number.

    Copies with a few changed words mostly agree, as neither least word need be a changed one.
    """
    sides = []
    for steps in (range(-NEAR, 0), range(1, NEAR + 1)):
        least = np.full(len(at), np.iinfo(np.uint64).max, np.uint64)
        for step in steps:
            other = at + step
            ok = (other >= 0) & (other < len(hashes))
            other = np.where(ok, other, at)
            ok &= text_of[other] == text_of[at]
            least = np.where(ok, np.minimum(least, hashes[other]), least)
        sides.append(least)
    return mix(sides[0] + mix(sides[1]))


def code_points(words: Words) -> np.ndarray:
    """Code points before each byte, counted from the start of the slice."""
    before = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum((words.data & 0xC0) != 0x80, out=before[1:])
    return before


def covered(starts: np.ndarray, ends: np.ndarray, spans: list) -> np.ndarray:
    """Which words of a text (code points of their starts and ends, in order) overlap one of its spans."""
    inside = np.zeros(len(starts), bool)
    for s, _, e, _ in spans:
        inside[np.searchsorted(ends, s, "right"):np.searchsorted(starts, e, "left")] = True
    return inside


def _surroundings(texts: list[str], spans: list[list]) -> list[list[tuple[int, int, int]]]:
    """(value, term, fingerprint) of the terms around each identifier, for texts that have some."""
    out: list[list] = [[] for _ in texts]
    for first, words in slices(pa.array(texts, pa.large_string()), True, NOT_LETTER):
        hashes, points = words.hashes(), code_points(words)
        text_of = np.repeat(np.arange(len(words.counts)), words.counts)
        for k in range(len(words.counts)):
            origin = points[words.offsets[k]]
            low, high = words.first[k], words.first[k + 1]
            starts, ends = points[words.starts[low:high]] - origin, points[words.ends[low:high]] - origin
            inside = covered(starts, ends, spans[first + k])
            for s, kind, e, value in spans[first + k]:
                left, right = np.searchsorted(ends, s, "right"), np.searchsorted(starts, e, "left")
                near = np.r_[max(0, left - NEAR):left, right:min(high - low, right + NEAR)]
                near = near[~inside[near]] + low
                marks = fingerprints(hashes, text_of, near)
                out[first + k] += zip([value_hash(kind, value)] * len(near), hashes[near].view(np.int64).tolist(), marks.view(np.int64).tolist())
    return out


def scanned(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, base (spans of direct identifiers) and near (their surroundings) of every row."""
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            found = [identifiers(t) for t in texts]
            some = [k for k, f in enumerate(found) if f]
            near = dict(zip(some, _surroundings([texts[k] for k in some], [found[k] for k in some])))
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "text_hash": frame["text_hash"], "n_chars": [len(t) for t in texts],
                "base": [[{"start": s, "kind": k, "end": e} for s, k, e, _ in f] for f in found],
                "near": [[{"value": v, "term": t, "place": p} for v, t, p in near.get(k, ())] for k in range(len(texts))],
            })
            give_back()

    rows = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInPandas(scan, f"doc_id long, text_hash long, n_chars long, base {SPANS}, near array<struct<value:long,term:long,place:long>>")


def occurrences(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, end, term, place of every place where a word may be one of ``terms``.

    Words inside direct identifiers are no places: there the word is a part of the value, not next to it.
    ``terms`` has term and most, the number of distinct places beyond which the term reveals nothing. A
    table of fixed size holds them by the term's last bits, so a few other words pass; the caller joins.
    Of a term with more than ``most`` distinct places in one slice only so many and one are returned,
    which says that it reveals nothing: frequent short words would be the larger part otherwise.
    """
    got = terms.groupBy(F.col("term").bitwiseAND(F.lit(MARKS - 1)).alias("spot")).agg(F.max("most").alias("most")).toArrow()  # MARKS rows at most
    spots, limits = got.column("spot").to_numpy(), got.column("most").to_numpy()

    def few(found: np.ndarray, marks: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Rows to return: all of a term with ``most`` distinct places at most, else one for each of the first places."""
        order = np.lexsort((marks, found))
        term, mark = found[order], marks[order]
        new_term = np.append(True, term[1:] != term[:-1])
        new_place = new_term | np.append(True, mark[1:] != mark[:-1])
        start = np.flatnonzero(new_term)
        group = np.cumsum(new_term) - 1
        rank = np.cumsum(new_place)
        rank -= rank[start][group] - 1
        many = np.add.reduceat(new_place, start)[group] > most[order]
        return np.sort(order[~many | (new_place & (rank <= most[order] + 1))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.full(MARKS, -1, np.int64)
        most[spots] = limits
        for batch in batches:
            for first, words in slices(batch.column(2), True, NOT_LETTER):
                hashes = words.hashes()
                limit = most[(hashes & np.uint64(MARKS - 1)).astype(np.int64)]
                at = np.flatnonzero(limit >= 0)
                text_of = np.repeat(np.arange(len(words.counts)), words.counts)
                points = code_points(words)
                origin = points[words.offsets[text_of[at]]]
                starts, ends = points[words.starts[at]] - origin, points[words.ends[at]] - origin
                free = np.ones(len(at), bool)
                some, low = np.unique(text_of[at], return_index=True)
                for k, s, e in zip(some.tolist(), low, np.append(low[1:], len(at))):
                    free[s:e] = ~covered(starts[s:e], ends[s:e], identifiers(batch.column(2)[first + k].as_py()))
                at, starts, ends = at[free], starts[free], ends[free]
                if len(at):
                    marks = fingerprints(hashes, text_of, at)
                    keep = few(hashes[at], marks, limit[at])
                    at, starts, ends = at[keep], starts[keep], ends[keep]
                rows = pa.array(first + text_of[at])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array(starts), pa.array(ends), pa.array(hashes[at].view(np.int64)),
                    pa.array(fingerprints(hashes, text_of, at).view(np.int64)),
                ], ["doc_id", "text_hash", "start", "end", "term", "place"])
            give_back()

    rows = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(find, "doc_id long, text_hash long, start long, end long, term long, place long")


def term_spans(documents: DataFrame, seen: DataFrame, places: int = PLACES, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, text_hash, terms (spans) of the documents in which a revealing term occurs.

    ``seen`` is the result of ``scanned`` for the same documents.
    """
    near = seen.select(F.explode("near").alias("n")).select("n.*").distinct()
    pairs = held(near.groupBy("value", "term").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= places))
    terms = pairs.groupBy("term").agg((F.floor(F.max("together") / F.lit(disclosure)) + 1).alias("most"))
    found = held(occurrences(documents, terms).join(terms.select("term"), "term"))
    total = found.select("term", "place").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("places"))
    revealing = pairs.join(total, "term").where(F.col("together") >= F.lit(disclosure) * F.col("places")).select("term").distinct()
    return found.join(revealing, "term").groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end")).alias("terms"))


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, base, spans of every row: the direct identifiers, and these with the revealing terms."""
    seen = held(scanned(documents))
    terms = term_spans(documents, seen).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "terms")
    joined = seen.join(terms, F.expr("doc_id <=> _id and text_hash = _hash"), "left")
    free = F.expr("filter(coalesce(terms, array()), t -> not exists(base, b -> b.start < t.end and t.start < b.end))")
    return joined.select("doc_id", "n_chars", "base", F.array_sort(F.concat("base", free)).alias("spans"))


def _replaced(text: str, spans: list) -> str:
    out, at = [], 0
    for s, kind, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def sanitise(documents: DataFrame) -> DataFrame:
    """The documents with every span replaced by the name of its kind; n_chars is counted anew if there."""
    seen = held(scanned(documents))
    terms = term_spans(documents, seen).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "terms")
    keyed = documents.select(F.struct(*documents.columns).alias("row"), F.xxhash64("text").alias("key")).join(
        terms, F.expr("row.doc_id <=> _id and key = _hash"), "left")

    @F.pandas_udf("string")
    def clean(text: pd.Series, extra: pd.Series) -> pd.Series:
        out = []
        for t, more in zip(text, extra):
            if t is None:
                out.append(None)
                continue
            base = [f[:3] for f in identifiers(t)]
            added = [(m["start"], m["kind"], m["end"]) for m in (more if more is not None else ())]
            added = [a for a in added if not any(s < a[2] and a[0] < e for s, _, e in base)]
            out.append(_replaced(t, sorted(base + added)))
        give_back()
        return pd.Series(out, dtype=object)

    cleaned = keyed.select("row", clean("row.text", "terms").alias("cleaned"))
    changed = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return cleaned.select([changed.get(c, F.col("row").getField(c)).alias(c) for c in documents.columns])


def _joined(spans: str):
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', element_at(array({names}), s.kind + 1), s.start, s.end)), ',')")


@bound("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    count = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)").alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *count, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
