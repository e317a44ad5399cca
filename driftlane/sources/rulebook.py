"""Rule dictionary: as tables, for dictionaries of any size, or as a literal of one document."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.functions import fixed
from driftlane.functions.text import fold_phrase
from driftlane.sources.readers import read_documents
from driftlane.sources.schemas import RULES

KINDS = {"entities": "entity", "anchors": "anchor", "support": "support", "keywords": "keyword"}


@dataclass(frozen=True)
class Rule:
    owner: str  # category or intent
    kind: str
    phrase: str


@dataclass(frozen=True)
class RuleBook:
    """Categories in dictionary order, their official codes, and phrase rules."""

    categories: tuple  # (id, name, (official codes...))
    rules: tuple
    intents: tuple = ()  # (id, name)
    intent_rules: tuple = ()
    suppressions: tuple = field(default_factory=lambda: tuple(fixed.SUPPRESSIONS))

    # what a hit is worth: kind, source, official code
    kind_weight: dict = field(default_factory=lambda: dict(fixed.KIND_WEIGHT))
    source_weight: dict = field(default_factory=lambda: dict(fixed.SOURCE_WEIGHT))
    official_weight: float = fixed.OFFICIAL_WEIGHT

    @staticmethod
    def from_dict(data: dict) -> "RuleBook":
        cats = data.get("categories") or []
        intents = data.get("intents") or {}
        kinds, sources, official = scoring(data.get("scoring"))
        return RuleBook(
            categories=tuple(
                (c["id"], c.get("name_vi") or c["id"], tuple(c.get("youtube_video_category_ids") or ()))
                for c in cats
            ),
            rules=tuple(
                Rule(c["id"], kind, phrase)
                for c in cats
                for key, kind in KINDS.items()
                for phrase in c.get(key) or ()
            ),
            intents=tuple((i, v.get("name_vi") or i) for i, v in intents.items()),
            intent_rules=tuple(
                Rule(i, "anchor", phrase) for i, v in intents.items() for phrase in v.get("anchors") or ()
            ),
            suppressions=tuple(tuple(s) for s in data.get("suppressions") or fixed.SUPPRESSIONS),
            kind_weight=kinds, source_weight=sources, official_weight=official,
        )


def scoring(block: dict | None) -> tuple[dict, dict, float]:
    """Kind weights, source weights and official bonus of a dictionary; fixed values where it has none."""
    block = block or {}

    def own(name: str, default: float) -> float:
        return default if block.get(name) is None else float(block[name])

    kinds = {kind: own(kind, weight) for kind, weight in fixed.KIND_WEIGHT.items()}
    return kinds, fixed.SOURCE_WEIGHT | dict(block.get("source_multipliers") or {}), own("youtube_category", fixed.OFFICIAL_WEIGHT)


def read_rule_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Dimension tables of a dictionary document."""
    return tables_of(read_documents(spark, path, RULES))


def tables_of(doc: DataFrame) -> dict[str, DataFrame]:
    cat = doc.select(F.posexplode("categories").alias("category_no", "c"))
    phrases = None
    for kind_no, (key, kind) in enumerate(KINDS.items()):
        part = cat.select(
            "category_no", F.col("c.id").alias("category_id"), F.lit(kind).alias("kind"), F.lit(kind_no).alias("kind_no"),
            F.posexplode(F.col("c")[key]).alias("place", "phrase"),
        )
        phrases = part if phrases is None else phrases.unionByName(part)
    intents = doc.select(F.posexplode(F.map_entries("intents")).alias("intent_no", "e")).select(
        "intent_no", F.col("e.key").alias("intent_id"), F.col("e.value").alias("i")
    )
    return {
        "scoring": doc.select("scoring.*"),
        "categories": cat.select(
            "category_no", F.col("c.id").alias("category_id"), F.col("c.name_vi").alias("name")
        ),
        "rules": phrases,
        "official": cat.select(
            F.col("c.id").alias("category_id"),
            F.explode("c.youtube_video_category_ids").alias("official_id"),
        ),
        "intents": intents.select(
            "intent_no", "intent_id", F.col("i.name_vi").alias("name"), F.posexplode("i.anchors").alias("place", "phrase")
        ),
        "suppressions": doc.select(F.explode("suppressions").alias("s")).select(
            F.get("s", F.lit(0)).alias("category_id"), F.get("s", F.lit(1)).alias("phrase"), F.get("s", F.lit(2)).alias("idiom")
        ),
    }


def load_rulebook(spark: SparkSession, path: str) -> RuleBook:
    """Dictionary document as a literal; its phrases become part of every plan. For
    dictionaries of many phrases, ``read_rule_tables`` and ``classify.classify_with_tables``."""
    # entries, not a map: the order of the intents decides ties
    rows = read_documents(spark, path, RULES).withColumn("intents", F.map_entries("intents")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("expected one dictionary document")
    data = rows[0].asDict(recursive=True)
    data["intents"] = {e["key"]: e["value"] for e in data["intents"] or ()}
    return RuleBook.from_dict(data)


def frame_of_tables(tables: dict[str, DataFrame]) -> RuleBook:
    """Categories, intents, weights and suppressions of rule tables, without their phrases.

    A dictionary that names no suppressions has the fixed ones.
    """
    codes = tables["official"].groupBy("category_id").agg(F.sort_array(F.collect_list("official_id")).alias("codes"))
    rows = tables["categories"].join(codes, "category_id", "left").orderBy("category_no").collect()
    intents = tables["intents"].groupBy("intent_no", "intent_id").agg(F.max("name").alias("name")).orderBy("intent_no").collect()
    block = tables["scoring"].first() if "scoring" in tables else None
    kinds, sources, official = scoring(block.asDict(recursive=True) if block else None)
    idioms = tables["suppressions"].collect() if "suppressions" in tables else ()
    return RuleBook(
        tuple((r["category_id"], r["name"] or r["category_id"], tuple(r["codes"] or ())) for r in rows), (),
        tuple((r["intent_id"], r["name"] or r["intent_id"]) for r in intents),
        suppressions=tuple((r["category_id"], r["phrase"], r["idiom"]) for r in idioms) or tuple(fixed.SUPPRESSIONS),
        kind_weight=kinds, source_weight=sources, official_weight=official,
    )


def folded(rules: tuple, lower_only: bool = False) -> list[str]:
    return [fold_phrase(r.phrase, lower_only) for r in rules]
