"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftlane.llm import bpe, decontaminate, html, licenses, minhash, neighbours, pii, quality, substrings, toxicity

LONG = " ".join(f"word{k % 997}x{k % 13}" for k in range(30_000))
DOCS = [
    (1, "Plain words that stand here for a text, and some more of them to have shingles.", "en", "a", 1),
    (1, "Plain words that stand here for a text, and some more of them to have shingles.", "en", "a", 1),
    (2, "", None, None, None), (3, None, "en", "b", 0), (None, "a row without an id", "en", "b", 3), (4, " \n\t ", "fr", "b", 3), (5, LONG, "en", "a", 9),
    (6, "one", "de", "c", 3), (7, "ünï ćode 🙂 日本語 text", "xx", "c", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 1), (7, 1, None), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "stand here for a text"), (None, "one")], "item_id long, text string")


def clashing(df):
    for name in ("key", "node", "text_hash", "kept", "words", "hash", "label", "component_id", "items", "_id", "places", "seeds"):
        df = df.withColumn(name, F.lit("x"))
    return df


OPERATORS = {
    "licenses": lambda d, l, b: licenses.license_scan(d),
    "quality": lambda d, l, b: quality.resampled(d, l),
    "decontaminate": lambda d, l, b: decontaminate.contamination(d, b),
    "bpe": lambda d, l, b: bpe.encoded(d, bpe.default_vocabulary()),
    "bpe_digests": lambda d, l, b: bpe.encoding_digests(d, bpe.default_vocabulary()),
    "toxicity": lambda d, l, b: toxicity.toxicity(d, l),
    "pii": lambda d, l, b: pii.personal_data(d),
    "substrings": lambda d, l, b: substrings.deduplicated(d, texts=True),
    "minhash": lambda d, l, b: minhash.linked(d, 3, 85),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back(name, docs, labels, benchmark):
    plain = OPERATORS[name](docs, labels, benchmark)
    rows = plain.collect()
    assert sorted(repr(r["doc_id"]) for r in rows) == sorted(repr(d[0]) for d in DOCS)
    first, second = [r for r in rows if r["doc_id"] == 1]
    assert first == second or name == "quality"
    wide = OPERATORS[name](clashing(docs), clashing(labels), clashing(benchmark))
    assert wide.columns == plain.columns
    assert sorted(map(repr, wide.collect())) == sorted(map(repr, rows))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, docs, labels, benchmark):
    none = docs.limit(0), labels.limit(0), benchmark.limit(0)
    assert OPERATORS[name](*none).count() == 0
    assert OPERATORS[name](docs, *none[1:]).count() == len(DOCS)


@pytest.mark.parametrize("stage", [s[1] for s in corpus_pipeline.STAGES], ids=[s[0] for s in corpus_pipeline.STAGES])
def test_stages(stage, spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for given in (docs, docs.limit(0), clashing(docs)):
        out = stage(spark, given, str(tmp_path))
        assert out.count() <= given.count()
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == corpus_pipeline.COLUMNS


def test_null_and_empty_texts(docs, labels, benchmark):
    found = {r["doc_id"]: r for r in decontaminate.contamination(docs, benchmark).collect()}
    assert found[3]["n_words"] == found[2]["n_words"] == found[4]["n_words"] == 0 and not found[3]["contaminated"]
    assert found[1]["items"] == ["3"] and found[1]["n_hit"] == 5
    assert found[6]["contaminated"] and found[6]["n_hit"] == 1 and found[6]["items"] == [], "an item without an id hits, and is not listed"
    found = {r["doc_id"]: r for r in minhash.linked(docs, 3, 85).collect()}
    assert found[2]["n_shingles"] == found[3]["n_shingles"] == 0 and found[2]["component_id"] == 2 and found[3]["kept"]
    assert found[6]["n_shingles"] == 1
    cleaned = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    assert cleaned[3]["text"] is None and cleaned[5]["text"] == LONG


def test_pages(spark):
    rows = [(1, "http://a.example/x", None), (2, None, ""), (3, "http://a.example/y", "no markup at all"), (3, "http://a.example/y", "no markup at all"),
            (None, "http://a.example/z", "<p>x &amp; y<p>z " + "long " * 40_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html.extracted(clashing(pages)).collect()}
    assert found[1] == found[2] == "" and found[3] == "no markup at all"
    assert found[None].startswith("x & y\nz long long") and len(found[None]) == 6 + 2 + 40_000 * 5 - 1
    assert html.extracted(pages.limit(0)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [1.0, inf], 1), (8, [1.0, None], 1),
            (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 1), (11, [], 1), (12, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neighbours.linked(clashing(vectors.withColumnRenamed("label", "l")).withColumn("label", F.col("l")), 0.93).collect()}
    assert found[1] == (3, 1, True) and found[2] == found[12] == (3, 1, False) and found[None] == (3, 1, False)
    for alone in (3, 4, 5, 6, 7, 8, 9, 10, 11):
        assert found[alone] == (0, alone, True)
    assert neighbours.linked(vectors.limit(0), 0.93).count() == 0
