"""From raw documents to token ids: quality, near-duplicates, benchmark passages, personal data, encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a frame,
which is written as Parquet and reread as the next one's docs. Each works on all rows that its
predecessor kept. ``run`` applies them to ``documents``. Rows with nulls, empty texts and repeated
rows are treated as each operator's docstring says; columns beyond those of documents are dropped. Stages that scan
texts in Python lower the session's Arrow batches, as workers live through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftlane.llm import bpe, decontaminate, minhash, pii, quality
from driftlane.llm.base import bound, held, small_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the resampling by quality rejects."""
    small_batches(spark)
    return quality.select_good(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five words, similarity 0.8)."""
    small_batches(spark)
    return minhash.drop_near_duplicates(docs.select(COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a shorter item."""
    return decontaminate.remove_contaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces identifiers, and terms that give them away, by the name of their kind."""
    small_batches(spark)
    return pii.sanitise(docs.select(COLUMNS))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens of every document."""
    small_batches(spark)
    return bpe.encoded(docs, bpe.default_vocabulary())


STAGES = [
    ("quality", good_texts), ("near_duplicates", one_of_each), ("benchmark", without_benchmark), ("personal_data", without_personal_data), ("token_ids", token_ids),
]

#: Hashed models, sampling keys and merges are not for SQL; tests/llm compares the operators with brute force and the stages with these.
ORACLE_SQL = None


@bound("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = held(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
