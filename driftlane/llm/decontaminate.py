"""Benchmark decontamination: a hash set of test windows, scanned over every document window.

DataFrame functions only. Items become windows of ten words (a shorter item is one window), one
row per distinct window with its items. Document windows of the same lengths are hashed next to the
text and tested against a bit array that marks every item window; the few that pass are joined with
the window table, and a hit counts only if the words themselves are equal. The window table is
broadcast when its counted size is below a limit, and joined as Spark sees fit beyond it.

Null and empty texts have no words: such documents have zero counts, such items no windows.
Rows with the same id and text are counted once and returned as often as they came. A null doc_id is
a value like any other. An item without an id has windows and hits as others have, but is in no list of
items and in no count of them. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.llm.base import bound, held, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The window table is broadcast up to so many rows (some 200 bytes each).
BROADCAST_WINDOWS = 200_000


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) words; an empty array for null."""
    split = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD)
    return F.array_remove(split, "")


def once(df: DataFrame, column: Column, name: str) -> DataFrame:
    """Adds a column that later expressions read without computing it again."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(n, hash, window, items): every distinct window with the sorted ids of its items as strings."""
    words = once(items.select(F.col("item_id").cast("string").alias("item"), "text"), words_of(F.col("text")), "words")
    words = words.where("size(words) > 0").select(
        "item", "words", F.least(F.lit(size), F.size("words")).alias("n"))
    at = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1))
    return (
        words.select("item", "words", "n", at.alias("at"))
        .select("n", "item", F.expr("slice(words, at, n)").alias("window"))
        .groupBy("n", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select("n", F.xxhash64("window").alias("hash"), "window", "items")
    )


def marked_bits(hashes: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """A bit array, as one row with an array of longs, in which every ``hash`` is marked; its mask.

    16 bits a hash, 2**20 (128 KB) at most: beyond, more starts pass and the join sorts them out.
    """
    mask = (1 << min(20, max(12, (16 * rows).bit_length()))) - 1
    marked = hashes.select(F.col("hash").bitwiseAND(F.lit(mask)).alias("h")).groupBy(F.shiftright("h", 6).alias("id")).agg(
        F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits"))
    every = hashes.sparkSession.range(0, (mask + 1) >> 6, 1, 1).join(marked, "id", "left")
    packed = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("all"))
    return packed.select(F.expr("transform(all, x -> x.bits)").alias("bits")), mask


def marked(bits: str, mask: int, hash_: str) -> str:
    return f"(shiftright({bits}[cast(shiftright({hash_} & {mask}L, 6) as int)], cast({hash_} & 63 as int)) & 1) = 1"


def contamination(documents: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items, contaminated of every document row.

    ``items`` holds the ids, as sorted strings, of items with a window that occurs in the text;
    ``n_hit`` counts words inside any occurrence.
    """
    windows = held(item_windows(items, size))
    found = windows.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).collect()  # at most ``size`` rows
    lengths, rows = sorted(r["n"] for r in found), sum(r["rows"] for r in found)
    # a start is tested by its first three words; few pass, and only they are hashed whole and tested again
    heads, head_mask = marked_bits(windows.select(F.xxhash64(F.slice("window", 1, 3)).alias("hash")), rows)
    bits, mask = marked_bits(windows, rows)
    words = once(documents.select("doc_id", "text"), words_of(F.col("text")), "words").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "words", heads.scalar().alias("heads"), bits.scalar().alias("bits"))

    def hashed(n: int) -> str:  # words[i] costs the same everywhere; slice() would walk the whole array for each start
        return f"xxhash64({', '.join(f'words[i + {k - 1}]' for k in range(n))})"

    starts = [
        F.expr(
            f"filter(transform(filter(sequence(1, size(words) - {n - 1}), i -> {marked('heads', head_mask, hashed(min(n, 3)))}), "
            f"i -> struct(i as at, {n} as n, {hashed(n)} as hash)), s -> {marked('bits', mask, 's.hash')})")
        for n in lengths
    ]
    none = F.expr("array(struct(0 as at, 0 as n, 0L as hash))")
    likely = F.concat(none, *[
        F.when(F.size("words") >= n, s).otherwise(F.expr("filter(array(struct(0 as at, 0 as n, 0L as hash)), x -> false)"))
        for n, s in zip(lengths, starts)
    ])
    likely = F.transform(likely, lambda s: F.struct(
        s["at"].alias("at"), s["n"].alias("n"), s["hash"].alias("hash"),
        F.when(s["at"] == 0, F.size("words").cast("long")).alias("n_words"),
        F.when(s["at"] > 0, F.slice("words", F.greatest(s["at"], F.lit(1)), s["n"])).alias("words"),
    ))
    scanned = words.select("doc_id", "text_hash", F.explode(likely).alias("w")).select("doc_id", "text_hash", "w.*")
    windows = windows.select(F.col("n").alias("wn"), F.col("hash").alias("wh"), "window", "items")
    if rows <= BROADCAST_WINDOWS:
        windows = F.broadcast(windows)
    hits = scanned.join(windows, F.expr("hash = wh and n = wn and words = window"), "left").where("at = 0 or items is not null")
    per_text = hits.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.count_if(F.col("at") == 0).alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("at") > 0, F.struct("at", "n")))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.expr(
        "aggregate(spans, struct(0 as upto, 0L as hit), (a, s) -> struct(greatest(a.upto, s.at + s.n - 1) as upto, "
        "a.hit + greatest(0, s.at + s.n - 1 - greatest(a.upto, s.at - 1)) as hit), a -> a.hit)")
    return per_text.select(
        "doc_id", "text_hash", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        F.explode(F.expr("sequence(1L, copies)")).alias("copy"),
    ).withColumn("contaminated", F.col("n_hit") > 0).drop("copy")


def remove_contaminated(documents: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The documents without a word inside an item's window, all their columns kept."""
    dirty = contamination(documents, items, size).where("contaminated").select(
        F.col("doc_id").alias("_dirty_id"), F.col("text_hash").alias("_dirty_hash")).distinct()
    keyed = documents.select(F.struct(*documents.columns).alias("row"), F.xxhash64("text").alias("key"))
    return keyed.join(dirty, F.expr("row.doc_id <=> _dirty_id and key = _dirty_hash"), "left_anti").select("row.*")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '" + UPPER + "', '" + LOWER + "'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
i AS (SELECT item, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p0, w FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, p0, p0 + n - 1), ' ') AS win FROM i),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p0, array_to_string(list_slice(w, p0, p0 + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p0 FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, p0, item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(p0, p0 + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@bound("op4_decontaminate", SQL)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
