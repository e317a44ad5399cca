"""Card classification as a projection: no join, no shuffle, one row in, one row out.

All phrases of a dictionary are found in one regex pass per text. At each word
start the longest matching phrase is captured; shorter phrases that match at the
same place are prefixes of it, so they follow from the dictionary alone.
``classify_with_tables`` takes the rules as tables of any size instead: hits come
from an equi-join of token sequences, in the same ``_found`` column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane.functions import fixed, text
from driftlane.functions import weights as wt
from driftlane.functions.plan import hold
from driftlane.sources.rulebook import RuleBook, folded, frame_of_tables

SOURCES = ["title", "channel", "tags", "description", "youtube_topics"]
LIST_SOURCES = {"tags", "youtube_topics"}
FOUND = "array<struct<source:string,number:bigint,category:string,category_no:int,kind:string,phrase:string>>"
HIT = "struct<category:string,category_no:int,kind:string,source:string,phrase:string,score:double>"


# ---------------------------------------------------------------- phrase search
class PhraseFinder:
    """Finds which of a list of folded phrases occur in a text column."""

    def __init__(self, phrases: list[str]):
        ids: dict[str, list[int]] = {}
        for number, phrase in enumerate(phrases):
            if phrase:
                ids.setdefault(phrase, []).append(number)
        self.longest_first = sorted(ids, key=lambda p: (-len(p), p))
        self.implied = {p: self._implied(p, ids) for p in self.longest_first}

    @staticmethod
    def _implied(phrase: str, ids: dict[str, list[int]]) -> list[int]:
        out = list(ids[phrase])
        for end in range(1, len(phrase)):
            if phrase[:end] in ids and not text.is_word(phrase[end]):
                out += ids[phrase[:end]]
        return out

    def pattern(self) -> str:
        """One regex for all phrases, folded by common prefix. Greedy optional
        tails try the longest phrase first and fall back to shorter ones."""
        tree: dict = {}
        for phrase in self.longest_first:
            node = tree
            for ch in phrase:
                node = node.setdefault(ch, {})
            node[""] = {}

        def regex(node: dict) -> str:
            tails = [text.quote(ch) + regex(node[ch]) for ch in sorted(node) if ch]
            if not tails:
                return ""
            return "(?:" + "|".join(tails) + ")" + ("?" if "" in node else "")

        return f"{text.NOT_AFTER_WORD}(?=({regex(tree)}){text.NOT_BEFORE_WORD})"

    def find(self, folded_text: Column) -> Column:
        """array<int>: numbers of the phrases found, each once."""
        if not self.longest_first:
            return F.array().cast("array<int>")
        found = F.array_distinct(F.regexp_extract_all(folded_text, F.lit(self.pattern()), F.lit(1)))
        names = F.array(*[F.lit(p) for p in self.longest_first])
        numbers = F.array(*[F.array(*[F.lit(i) for i in self.implied[p]]) for p in self.longest_first])
        every = F.transform(found, lambda p: F.element_at(numbers, F.array_position(names, p).cast("int")))
        return F.array_sort(F.array_distinct(F.flatten(every)))


def _literals(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def _at(values: Column, number: Column) -> Column:
    return F.get(values, number)


# ------------------------------------------------------------------------- hits
def with_folded_sources(cards: DataFrame, lower_only: bool = False) -> DataFrame:
    """Adds ``_texts_<source>``: the folded texts of each source as an array."""
    one = text.fold_lower if lower_only else text.fold_text
    many = text.fold_lower_texts if lower_only else text.fold_texts
    return cards.withColumns(
        {
            f"_texts_{s}": many(F.col(s)) if s in LIST_SOURCES else F.array(one(F.col(s)))
            for s in SOURCES
        }
    )


def with_rule_numbers(cards: DataFrame, book: RuleBook, lower_only: bool = False) -> DataFrame:
    """Adds ``_found``: one entry per text and rule, with what the rule says."""
    finder = PhraseFinder(folded(book.rules, lower_only))
    blocked = []
    for owner, phrase, idiom in () if lower_only else book.suppressions:
        rules = [
            n for n, r in enumerate(book.rules)
            if r.owner == owner and r.kind in ("entity", "anchor")
            and text.fold_phrase(r.phrase) == text.fold_phrase(phrase)
        ]
        if rules:
            blocked.append((rules, idiom))

    def numbers(one_text: Column) -> Column:
        out = finder.find(one_text)
        for rules, idiom in blocked:
            hidden = F.array(*[F.lit(n) for n in rules])
            # the idiom is only looked for when one of its phrases was found
            out = F.filter(out, lambda n: ~(F.array_contains(hidden, n) & F.rlike(one_text, F.lit(idiom))))
        return out

    def found_in(source: str) -> Column:
        per_text = F.transform(
            f"_texts_{source}",
            lambda t: F.transform(
                numbers(t), lambda n: F.struct(F.lit(source).alias("source"), n.alias("number"))
            ),
        )
        return F.flatten(per_text)

    order = {c[0]: n for n, c in enumerate(book.categories)}
    category = _literals([r.owner for r in book.rules], "string")
    category_no = _literals([order[r.owner] for r in book.rules], "int")
    kind = _literals([r.kind for r in book.rules], "string")
    phrase = _literals([r.phrase for r in book.rules], "string")
    found = F.transform(
        F.concat(*[found_in(s) for s in SOURCES]),
        lambda h: F.struct(
            h["source"].alias("source"), h["number"].cast("bigint").alias("number"), _at(category, h["number"]).alias("category"),
            _at(category_no, h["number"]).alias("category_no"), _at(kind, h["number"]).alias("kind"), _at(phrase, h["number"]).alias("phrase"),
        ),
    )
    # held: two scorers read it, and inlined it would be built for each of their mentions
    return hold(cards.withColumn("_found", found.cast(FOUND)), "_found")


def _tokens(col) -> Column:
    """All of a text: runs of word characters, and every other sign by itself."""
    return F.regexp_extract_all(col, F.lit(rf"({text.WORD}+|[^\p{{L}}\p{{N}}_])"), F.lit(1))


def grams(one_text: Column, lengths: Column) -> Column:
    """Distinct token sequences of a text which have one of ``lengths`` and no word character next to them.

    One regex pass a length. Each match consumes the text up to the next place where a sequence
    can begin (right after a word none does) and looks ahead for the one that begins here.
    """
    word, sign = rf"{text.WORD}++", r"[^\p{L}\p{N}_]"
    ahead, step = rf"(?:(?=((?:{word}|{sign}){{", rf"}}+){text.NOT_BEFORE_WORD}))?(?:{word}{sign}?|{sign})"
    found = F.transform(lengths, lambda n: F.array_distinct(F.regexp_extract_all(one_text, F.concat(F.lit(ahead), n.cast("string"), F.lit(step)), F.lit(1))))
    return F.array_remove(F.flatten(found), F.lit(""))  # a match without a sequence gives ''


def found_by_join(cards: DataFrame, key: str, texts: dict[str, Column], searches: dict[str, tuple], suppressions: tuple = ()) -> DataFrame:
    """Cards with one ``_found`` array per search, from rule tables of any size.

    ``texts``: folded text arrays by name. ``searches``: column to add -> (rules, {name of
    a text: source}); rules have number, phrase (folded), category, category_no, kind,
    label. The token sequences of a text that are as long as some phrase meet the
    dictionary in one equi-join for all searches. A match is a hit by itself: texts
    are not joined, and a card is grouped with its hits, not with candidates.
    """
    # all texts of a card by one generator, so that cards are read and folded once
    entries = [F.transform(F.coalesce(texts_of, F.array().cast("array<string>")), lambda t, no: F.struct(F.lit(name).alias("_name"), no.alias("no"), t.alias("_text")))
               for name, texts_of in texts.items()]
    rows = cards.select(key, F.inline(F.concat(*entries)))
    known = None
    for out, (rules, sources) in searches.items():
        at = F.array(*[F.struct(F.lit(t).alias("name"), F.lit(n).alias("source_no"), F.lit(s).alias("source")) for n, (t, s) in enumerate(sources.items())])
        part = rules.filter("phrase <> ''").select(
            F.lit(out).alias("_out"), at.alias("_at"), "number", "phrase", "category", F.col("category_no").cast("int").alias("category_no"), "kind", "label")
        known = part if known is None else known.unionByName(part)
    hidden = [F.when(
        F.col("kind").isin("entity", "anchor") & (F.col("category") == owner) & (F.col("phrase") == text.fold_phrase(phrase)), F.lit(n)
    ) for n, (owner, phrase, _) in enumerate(suppressions)]
    known = known.select("*", _tokens("phrase").alias("_tokens"), F.array_compact(F.array(*hidden)).cast("array<int>").alias("_hidden"))
    lengths = known.agg(F.sort_array(F.collect_set(F.size("_tokens")))).scalar()  # no more than the longest phrase has tokens
    # the idiom is only looked for where its phrase stands
    idioms = [F.when(F.contains("_text", F.lit(text.fold_phrase(phrase))) & F.rlike("_text", F.lit(idiom)), F.lit(n)) for n, (_, phrase, idiom) in enumerate(suppressions)]
    rows = rows.select(key, "_name", "no", "_text", F.array_compact(F.array(*idioms)).cast("array<int>").alias("_idioms"), lengths.alias("_lengths"))
    rows = hold(rows, "_text", "_idioms", "_lengths")
    found = rows.select(key, "_name", "no", "_idioms", F.explode(grams(F.col("_text"), F.col("_lengths"))).alias("phrase"))
    rules = known.select("phrase", "_hidden", "_out", "_at", "number", "category", "category_no", "kind", "label")
    hits = found.join(rules, "phrase").filter(~F.arrays_overlap("_hidden", "_idioms")).withColumn(
        "_source", F.get(F.filter("_at", lambda a: a["name"] == F.col("_name")), F.lit(0))).filter("_source is not null")
    hit = F.struct(
        F.col("_source.source_no").alias("source_no"), "no", "number", F.col("_source.source").alias("source"), "category", "category_no", "kind", "label")
    per_card = hits.groupBy(key).agg(*[F.array_sort(F.collect_list(F.when(F.col("_out") == out, hit))).alias(out) for out in searches])
    joined = cards.join(per_card, key, "left")
    for out in searches:
        entries = F.transform(out, lambda h: F.struct(
            h["source"].alias("source"), h["number"].cast("bigint").alias("number"), h["category"].alias("category"),
            h["category_no"].alias("category_no"), h["kind"].alias("kind"), h["label"].alias("phrase")))
        joined = joined.withColumn(out, F.coalesce(entries.cast(FOUND), F.array().cast(FOUND)))
    return hold(joined, *searches)


def scored_hits(source_weight: dict, weight, found: str = "_found") -> Column:
    """``found`` as hits with a score; ``weight(hit)`` is the worth of its rule."""
    return F.transform(
        found,
        lambda h: F.struct(
            h["category"].alias("category"), h["category_no"].alias("category_no"), h["kind"].alias("kind"),
            h["source"].alias("source"), h["phrase"].alias("phrase"),
            (weight(h) * wt.lookup(h["source"], source_weight, 0.0)).alias("score"),
        ),
    )


def official_hits(book: RuleBook, bonus: float) -> Column:
    """Bonus hits of the categories that list the card's official code."""
    code = F.col("youtube_category_id").try_cast("int")
    rows = [
        F.struct(
            F.lit(cid).alias("category"), F.lit(n).alias("category_no"),
            F.lit("official_category").alias("kind"), F.lit("youtube_category_id").alias("source"),
            F.col("youtube_category_id").alias("phrase"), F.lit(float(bonus)).alias("score"),
            F.array(*[F.lit(int(c)) for c in codes]).alias("_codes"),
        )
        for n, (cid, _, codes) in enumerate(book.categories) if codes
    ]
    if not rows:
        return F.array().cast(f"array<{HIT}>")
    matching = F.filter(F.array(*rows), lambda r: F.coalesce(F.array_contains(r["_codes"], code), F.lit(False)))
    return F.transform(matching, lambda r: r.dropFields("_codes").cast(HIT))


def category_scores(hits: Column, official: Column) -> Column:
    """Sorted array of (neg score, category_no, category, score, counts) per category.

    Support phrases count only where strong phrases scored; the official bonus
    comes after that and never unlocks support.
    """
    strong = F.filter(hits, lambda h: h["kind"] != "support")
    categories = F.array_distinct(
        F.transform(
            F.concat(strong, official),
            lambda h: F.struct(h["category_no"].alias("no"), h["category"].alias("id")),
        )
    )

    def total(rows: Column) -> Column:
        # rounded far below any threshold, so the order of the hits cannot matter
        return F.round(F.aggregate(rows, F.lit(0.0), lambda a, h: a + h["score"]), 9)

    def score(c: Column) -> Column:
        own = F.filter(hits, lambda h: h["category_no"] == c["no"])
        own_strong = F.filter(own, lambda h: h["kind"] != "support")
        own_official = F.filter(official, lambda h: h["category_no"] == c["no"])
        own_support = F.filter(own, lambda h: h["kind"] == "support")
        evidence = F.concat(
            F.when(F.size(own_strong) > 0, F.concat(own_strong, own_support)).otherwise(own_strong),
            own_official,
        )
        return F.struct(
            (-total(evidence)).alias("sort"), c["no"].alias("category_no"), c["id"].alias("id"),
            total(evidence).alias("score"), evidence.alias("evidence"),
        )

    # hits with weight 0 (a source the mode does not use) are no evidence
    return F.array_sort(F.filter(F.transform(categories, score), lambda c: c["score"] > 0))


def _share_vector(ranked: Column, names: Column, floor: float, factor: float) -> Column:
    total = F.aggregate(ranked, F.lit(0.0), lambda a, c: a + c["score"])
    top = F.get(ranked, F.lit(0))["score"] / total
    kept = F.filter(ranked, lambda c: c["score"] / total >= F.greatest(F.lit(floor), top * factor))
    return F.transform(
        kept,
        lambda c: F.struct(
            c["id"].alias("id"), F.get(names, c["category_no"]).alias("name"),
            wt.round_even(c["score"] / total, 4).alias("share"),
            wt.round_even(c["score"], 3).alias("raw_score"),
        ),
    )


def _measures(ranked: Column) -> tuple[Column, Column, Column, Column]:
    total = F.aggregate(ranked, F.lit(0.0), lambda a, c: a + c["score"])
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    share = F.coalesce(first["score"] / total, F.lit(0.0))
    margin = share - F.coalesce(second["score"] / total, F.lit(0.0))
    return first, F.coalesce(first["score"], F.lit(0.0)), share, margin


def _has(*columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        col = F.col(c)
        out = out | F.coalesce(F.size(col) > 0 if c in LIST_SOURCES else col != "", F.lit(False))
    return out


def _mode(enriched: Column) -> Column:
    return F.when(enriched, "enriched").otherwise("home_visible")


def _evidence_map(ranked: Column, vector: Column) -> Column:
    ids = F.transform(vector, lambda v: v["id"])
    kept = F.filter(ranked, lambda c: F.array_contains(ids, c["id"]))
    return F.map_from_entries(F.transform(kept, lambda c: F.struct(c["id"], c["evidence"])))


# -------------------------------------------------------------- content, target
def classify_content(found: DataFrame, book: RuleBook) -> DataFrame:
    """Adds ``classification`` and ``target_profile`` to cards with ``_found``."""
    def worth(h: Column) -> Column:
        return wt.lookup(h["kind"], book.kind_weight, 0.0)

    names = _literals([c[1] for c in book.categories], "string")
    empty = F.array().cast(f"array<{HIT}>")
    df = found.withColumns(
        {
            "_hits": scored_hits(book.source_weight, worth),
            "_target_hits": scored_hits(fixed.TARGET_SOURCE_WEIGHT, worth),
            "_official": official_hits(book, book.official_weight),
        }
    )
    df = df.withColumns(
        {
            "_ranked": category_scores(F.col("_hits"), F.col("_official")),
            "_target": F.when(
                _has("tags", "description"), category_scores(F.col("_target_hits"), empty)
            ),
        }
    )
    first, raw, share, margin = _measures(F.col("_ranked"))
    strong = F.filter(first["evidence"], lambda e: e["kind"] != "support")
    n_strong = F.coalesce(F.size(strong), F.lit(0))
    n_sources = F.coalesce(F.size(F.array_distinct(F.transform(strong, lambda e: e["source"]))), F.lit(0))
    df = df.withColumns(
        {
            "_share": share, "_margin": margin, "_raw": raw, "_n_strong": n_strong, "_n_sources": n_sources,
            "_vector": _share_vector(F.col("_ranked"), names, 0.08, 0.18),
            "_target_vector": _share_vector(F.col("_target"), names, 0.08, 0.18),
        }
    )
    base = content_confidence(F.col("_raw"), F.col("_n_strong"), F.col("_n_sources"), F.col("_share"), F.col("_margin"))
    classification = F.struct(
        _mode(_has("description", "tags", "youtube_category_id", "youtube_topics")).alias("mode"),
        F.get("_ranked", F.lit(0))["id"].alias("top_category"),
        base.alias("confidence"),
        wt.round_even(F.col("_share"), 4).alias("top_share"),
        wt.round_even(F.col("_margin"), 4).alias("margin"),
        F.col("_vector").alias("categories"),
        _evidence_map(F.col("_ranked"), F.col("_vector")).alias("evidence"),
    )
    target = F.struct(
        _has("tags", "description").alias("available"),
        F.coalesce("_target_vector", F.array().cast("array<struct<id:string,name:string,share:double,raw_score:double>>")).alias("categories"),
    )
    return df.withColumns({"classification": classification, "target_profile": target}).drop(
        "_hits", "_target_hits", "_official", "_ranked", "_target", "_share", "_margin", "_raw",
        "_n_strong", "_n_sources", "_vector", "_target_vector",
    )


def content_confidence(raw: Column, n_strong: Column, n_sources: Column, share: Column, margin: Column) -> Column:
    medium = (raw >= 4.0) & (n_strong >= 1) & (share >= 0.45)
    return (
        F.when((raw >= 7.0) & (n_strong >= 2) & (share >= 0.55) & (margin >= 0.15), "high")
        .when(medium & (n_sources >= 2) & (share >= 0.55) & (margin >= 0.20), "high")
        .when(medium, "medium")
        .when(raw >= 2.0, "low")
        .otherwise("unknown")
    )


# ---------------------------------------------------------------------- intents
def classify_intent(cards: DataFrame, book: RuleBook) -> DataFrame:
    """Adds ``intent_profile``; needs the ``_texts_*`` columns."""
    finder = PhraseFinder(folded(book.intent_rules))
    owner = {i[0]: n for n, i in enumerate(book.intents)}
    intent = _literals([r.owner for r in book.intent_rules], "string")
    intent_no = _literals([owner[r.owner] for r in book.intent_rules], "int")
    phrase = _literals([r.phrase for r in book.intent_rules], "string")
    # joined first, then folded: blanks inside the joined text stay as they are
    joined_tags = F.array(text.fold_text(F.array_join("tags", " ")))
    texts = {"title": F.col("_texts_title"), "description": F.col("_texts_description"), "tags": joined_tags}

    def hits_in(source: str, weight: float) -> Column:
        return F.transform(
            finder.find(F.get(texts[source], F.lit(0))),
            lambda n: F.struct(
                _at(intent, n).alias("category"), _at(intent_no, n).alias("category_no"),
                F.lit("anchor").alias("kind"), F.lit(source).alias("source"),
                _at(phrase, n).alias("phrase"), F.lit(fixed.INTENT_PHRASE_WEIGHT * weight).alias("score"),
            ),
        )

    parts = [hits_in(s, w) for s, w in fixed.INTENT_SOURCE_WEIGHT.items()]
    return _intents_of(cards.withColumn("_intent_hits", F.concat(*parts).cast(f"array<{HIT}>")), book)


def _intents_of(df: DataFrame, book: RuleBook) -> DataFrame:
    names = _literals([i[1] for i in book.intents], "string")
    empty = F.array().cast(f"array<{HIT}>")
    df = df.withColumn("_intent_ranked", category_scores(F.col("_intent_hits"), empty))
    df = df.withColumn("_intent_vector", _share_vector(F.col("_intent_ranked"), names, 0.10, 0.0))
    profile = F.struct(
        F.get("_intent_vector", F.lit(0))["id"].alias("top_intent"),
        F.col("_intent_vector").alias("intents"),
        _evidence_map(F.col("_intent_ranked"), F.col("_intent_vector")).alias("evidence"),
    )
    return df.withColumn("intent_profile", profile).drop("_intent_hits", "_intent_ranked", "_intent_vector")


# ------------------------------------------------------------------- popularity
def popularity(cards: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``popularity_profile`` measured at ``as_of``.

    Counts of the card itself stand in where ``statistics`` lacks them. A card
    without a readable date has no age, daily views or demand.
    """
    def count(name: str) -> Column:
        own = F.col(f"statistics.{name}")
        return (F.coalesce(own, F.col(name).cast("string")) if name in cards.columns else own).try_cast("bigint")

    views = count("view_count")
    published = F.try_to_timestamp(F.nullif(F.col("published_at"), F.lit("")))
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(published)) / 3_600_000_000.0
    hours = F.when(published.isNotNull(), F.greatest(F.lit(1.0), age))
    known = views.isNotNull()
    return cards.withColumn(
        "popularity_profile",
        F.struct(
            known.alias("available"),
            views.alias("view_count"),
            F.when(known, count("like_count")).alias("like_count"),
            F.when(known, count("comment_count")).alias("comment_count"),
            F.when(known, wt.round_even(hours / 24.0, 3)).alias("age_days"),
            F.when(known, wt.round_even(views / (hours / 24.0), 2)).alias("avg_views_per_day"),
            F.when(known & hours.isNotNull(), wt.round_even(wt.demand_signal(views, hours), 4)).alias("demand_signal"),
        ),
    )


def classify(cards: DataFrame, book: RuleBook, as_of: Column | None = None) -> DataFrame:
    """Full classification of a card table; a chain of projections."""
    df = with_rule_numbers(with_folded_sources(cards), book)
    df = classify_intent(classify_content(df, book), book)
    df = df.drop("_found", *[f"_texts_{s}" for s in SOURCES])
    df = hold(df, "classification", "target_profile", "intent_profile")
    return df if as_of is None else popularity(df, as_of)


def classify_with_tables(cards: DataFrame, key: str, tables: dict[str, DataFrame], as_of: Column | None = None, suppressions: tuple | None = None) -> DataFrame:
    """The same columns as ``classify``, from rule tables (see ``read_rule_tables``) of any size.

    ``key`` names a column with one value per card. Categories, intents, weights and
    suppressions become literals; phrases stay rows.
    """
    book = frame_of_tables(tables)
    hidden = book.suppressions if suppressions is None else suppressions
    places = F.col("kind_no").cast("bigint") * F.lit(1 << 32) + F.col("place")
    rules = tables["rules"].filter("kind <> 'keyword'").select(
        (F.col("category_no") * F.lit(1 << 40) + places).alias("number"), text.fold_text(F.col("phrase")).alias("phrase"),
        F.col("category_id").alias("category"), "category_no", "kind", F.col("phrase").alias("label"),
    )
    intents = tables["intents"].select(
        (F.col("intent_no") * F.lit(1 << 40) + F.col("place")).alias("number"), text.fold_text(F.col("phrase")).alias("phrase"),
        F.col("intent_id").alias("category"), F.col("intent_no").alias("category_no"), F.lit("anchor").alias("kind"), F.col("phrase").alias("label"),
    )
    one, many = text.fold_text, text.fold_texts
    texts = {s: many(F.col(s)) if s in LIST_SOURCES else F.array(one(F.col(s))) for s in SOURCES}
    texts["joined tags"] = F.array(one(F.array_join("tags", " ")))
    searches = {"_found": (rules, {s: s for s in SOURCES}), "_intents": (intents, {"title": "title", "description": "description", "joined tags": "tags"})}
    df = found_by_join(cards, key, texts, searches, hidden)
    df = hold(classify_content(df, book).drop("_found"), "classification", "target_profile")
    worth = F.lit(fixed.INTENT_PHRASE_WEIGHT)
    df = df.withColumn("_intent_hits", scored_hits(fixed.INTENT_SOURCE_WEIGHT, lambda h: worth, "_intents").cast(f"array<{HIT}>")).drop("_intents")
    df = hold(_intents_of(df, book), "classification", "target_profile", "intent_profile")
    return df if as_of is None else popularity(df, as_of)


# -------------------------------------------------------------- keyword (older)
def classify_keywords(cards: DataFrame, book: RuleBook) -> DataFrame:
    """Adds ``classification`` of the flat keyword dictionary."""
    rules = tuple(r for r in book.rules if r.kind == "keyword")
    flat = RuleBook(book.categories, rules, suppressions=())
    names = _literals([c[1] for c in book.categories], "string")
    df = with_rule_numbers(with_folded_sources(cards, lower_only=True), flat, lower_only=True)
    special = _literals([text.keyword_weight(r.phrase) for r in rules], "double")
    hits = scored_hits(fixed.KEYWORD_SOURCE_WEIGHT, lambda h: _at(special, h["number"].cast("int")))
    df = df.withColumn("_hits", F.filter(hits, lambda h: h["score"] > 0))
    df = df.withColumn(
        "_ranked", category_scores(F.col("_hits"), official_hits(flat, fixed.KEYWORD_OFFICIAL_WEIGHT))
    )
    _, raw, share, margin = _measures(F.col("_ranked"))
    df = df.withColumns(
        {"_raw": raw, "_share": share, "_margin": margin, "_vector": _share_vector(F.col("_ranked"), names, 0.12, 0.25)}
    )
    everything = F.map_from_entries(F.transform("_ranked", lambda c: F.struct(c["id"], c["evidence"])))
    df = df.withColumn(
        "classification",
        F.struct(
            _mode(_has("description", "tags", "youtube_category_id")).alias("mode"),
            F.get("_ranked", F.lit(0))["id"].alias("top_category"),
            keyword_confidence(F.col("_raw"), F.col("_share"), F.col("_margin")).alias("confidence"),
            wt.round_even(F.col("_share"), 4).alias("top_share"),
            wt.round_even(F.col("_margin"), 4).alias("margin"),
            F.col("_vector").alias("categories"),
            everything.alias("evidence"),
        ),
    ).drop(
        "_found", "_hits", "_ranked", "_raw", "_share", "_margin", "_vector",
        *[f"_texts_{s}" for s in SOURCES],
    )
    return hold(df, "classification")


def keyword_confidence(raw: Column, share: Column, margin: Column) -> Column:
    return (
        F.when(raw < 2.0, "unknown")
        .when((share >= 0.70) & (margin >= 0.35), "high")
        .when((share >= 0.50) & (margin >= 0.15), "medium")
        .otherwise("low")
    )


# ---------------------------------------------------------------------- summary
def summarize(classified: DataFrame, group: list[str] = ()) -> DataFrame:
    """Counts and rates of a classified table; partial aggregation only."""
    conf = F.col("classification.confidence")
    n = F.count("*")

    def rate(*levels: str) -> Column:
        return wt.round_even(F.count_if(conf.isin(*levels)) / n, 4)

    return classified.groupBy(*group).agg(
        n.alias("item_count"),
        *[F.count_if(conf == c).alias(f"{c}_count") for c in fixed.CONFIDENCE_WEIGHT],
        wt.round_even(F.count_if(conf != "unknown") / n, 4).alias("classified_rate"),
        rate("high", "medium").alias("high_medium_rate"),
        rate("low", "unknown").alias("ambiguous_rate"),
        wt.round_even(F.avg("classification.margin"), 4).alias("average_margin"),
    )


def top_category_counts(classified: DataFrame, group: list[str] = ()) -> DataFrame:
    return (
        classified.filter(F.col("classification.top_category").isNotNull())
        .groupBy(*group, F.col("classification.top_category").alias("category_id"))
        .agg(F.count("*").alias("item_count"))
    )
