"""Prefix trie of rebuilt conversations by composable fingerprints; no rebuilt text is ever made.

A conversation may start with the head of another one (its base) and go on with its own turns. A run of
turns has the fingerprint (B**length, value): values add up as ``left.value * B**right.length +
right.value`` modulo a Mersenne prime of 127 bits, so runs are combined without their turns. One sorted
pass gives every turn the fingerprint of the conversation up to it, and that of its own part after the
head; the fingerprint of a rebuilt prefix is then base head times own part, and that of the prefix without
its last turn follows by the inverse of B. A turn's value comes from the SHA-256 of its role and text.

A trie node is a group of equal (depth, fingerprint). Groups are verified through references to stored
turns: each member refers to its last turn's digest and to the fingerprint before it, and a node holds
exactly one such pair. If some fingerprint has two, the base B is drawn anew; equal fingerprints
then mean equal sequences, by induction over depth.

Sums over subtrees take no level-by-level work. A node's subtree lies in the paths of its members; each
node is charged to its smallest member, which owns the end part of its own path. So a node's sum is that
of its members' owned totals, less what its smallest member owns above it. Members of a node are only
ever counted and summed, with partial sums before the shuffle, and their ids are joined in chunks of a
bounded range of ids, then hashed in a stream; a node or a conversation with a third of all rows is no
large group in memory.

Turns go by turn number (null first), then role and digest. Null role or text counts as empty. Rows without a conv_id
belong to no conversation and are left out; repeated rows are turns like others. An empty table gives no
nodes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlane.llm.base import bound, held, table

PRIME = 2**127 - 1
#: Longest head that is taken from a base, and ids of one chunk.
MOST_HEAD, CHUNK = 8, 1 << 12
TURNS = "conv_id long, place long, head int, digest binary, n_bytes long, whole binary, own binary, shift binary"


def base_of(draw: int) -> int:
    return int.from_bytes(hashlib.sha256(f"base {draw}".encode()).digest()[:15], "little") | 1 << 100


def value_of(digest: bytes) -> int:
    return int.from_bytes(digest[:15], "little") + 1


def combine(left: int, shift: int, right: int) -> int:
    """Value of two runs one after the other; ``shift`` is the power of the right one."""
    return (left * shift + right) % PRIME


def raw(x: int) -> bytes:
    return x.to_bytes(16, "little")


def number(x: bytes) -> int:
    return int.from_bytes(x, "little")


def turn_fingerprints(turns: DataFrame, draw: int) -> DataFrame:
    """Every turn with its place, and the fingerprints of the conversation and of its part after the head up to it.

    ``turns`` has conv_id, turn, role, head, digest, n_bytes. Each task streams its conversations in
    order and keeps three numbers.
    """
    base = base_of(draw)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place, whole, own, shift = None, 0, 0, 0, 1
        for batch in batches:
            places, wholes, owns, shifts = [], [], [], []
            for conv, head, digest in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))):
                if conv != current:
                    current, place, whole, own, shift = conv, 0, 0, 0, 1
                value = value_of(digest)
                place += 1
                whole = combine(whole, base, value)
                if place > head:
                    own, shift = combine(own, base, value), shift * base % PRIME
                places.append(place), wholes.append(raw(whole)), owns.append(raw(own)), shifts.append(raw(shift))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(places, pa.int64()), *(batch.column(k) for k in (1, 2, 3)), *(pa.array(x, pa.binary()) for x in (wholes, owns, shifts)),
            ], ["conv_id", "place", "head", "digest", "n_bytes", "whole", "own", "shift"])

    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("digest")]
    rows = turns.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "head", "digest", "n_bytes")
    return rows.mapInArrow(stream, TURNS)


def paths(turns: DataFrame, bases: DataFrame, draw: int) -> DataFrame:
    """conv_id, depth, print, before, digest, n_bytes of every turn of every rebuilt conversation.

    ``turns`` are those of ``turn_fingerprints``, ``bases`` has conv_id, base, head of every
    conversation. ``print`` is the fingerprint of the first ``depth`` turns, ``before`` that without the last.
    """
    base, back = base_of(draw), pow(base_of(draw), -1, PRIME)

    @F.pandas_udf("print binary, before binary")
    def joined(left: pd.Series, shift: pd.Series, own: pd.Series, digest: pd.Series) -> pd.DataFrame:
        prints = [combine(number(a), number(s), number(b)) if a is not None else number(b) for a, s, b in zip(left, shift, own)]
        before = [raw((p - value_of(d)) * back % PRIME) for p, d in zip(prints, digest)]
        return pd.DataFrame({"print": [raw(p) for p in prints], "before": before})

    heads = turns.where(F.col("place") <= MOST_HEAD).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("place", "whole", "digest", "n_bytes"))).alias("turns"))  # MOST_HEAD at most
    none = F.expr("cast(array() as array<struct<place:long,whole:binary,digest:binary,n_bytes:long>>)")
    taken = bases.join(heads, "base", "left").select("conv_id", F.slice(F.coalesce("turns", none), F.lit(1), F.col("head")).alias("t"))
    first = taken.select("conv_id", F.explode("t").alias("t")).select(
        "conv_id", F.col("t.place").alias("depth"), F.lit(None).cast("binary").alias("left"), F.lit(raw(1)).alias("shift"),
        F.col("t.whole").alias("own"), "t.digest", "t.n_bytes")
    last = taken.select("conv_id", F.size("t").alias("kept"), F.try_element_at("t", F.lit(-1)).getField("whole").alias("left"))
    rest = turns.where("place > head").join(last, "conv_id").select(
        "conv_id", (F.col("kept") + F.col("place") - F.col("head")).alias("depth"), "left", "shift", "own", "digest", "n_bytes")
    rows = first.unionByName(rest.withColumn("depth", F.col("depth").cast("long"))).withColumn("p", joined("left", "shift", "own", "digest"))
    return rows.select("conv_id", "depth", "p.print", "p.before", "digest", "n_bytes")


def chained_hash(rows: DataFrame, key: list[str], order: str, text: str, separator: str) -> DataFrame:
    """key, sha256 of each key's texts in order, joined by the separator; each task streams its keys."""
    n, joint = len(key), separator.encode()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            done = []
            columns = [batch.column(k).to_pylist() for k in range(n + 1)]
            for *own, part in zip(*columns):
                if own != current:
                    if state is not None:
                        done.append((current, state.hexdigest()))
                    current, state = own, hashlib.sha256()
                else:
                    state.update(joint)
                state.update(part.encode())
            yield output(done)
        if state is not None:
            yield output([(current, state.hexdigest())])

    kinds = [f.dataType.simpleString() for f in rows.select(key).schema]
    schema = ", ".join(f"{k} {t}" for k, t in zip(key, kinds)) + ", sha256 string"
    types = {"bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32()}

    def output(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*(pa.array([d[0][k] for d in done], types[t]) for k, t in enumerate(kinds)), pa.array([d[1] for d in done], pa.string())], [*key, "sha256"])

    ordered = rows.repartition(*key).sortWithinPartitions(*key, order).select(*key, text)
    return ordered.mapInArrow(stream, schema)


def prefix_trie(conversations: DataFrame, bases: DataFrame) -> DataFrame:
    """The nodes: depth, print, before (null for the root), conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role, text; ``bases`` has conv_id, base, head (0 to MOST_HEAD): the
    conversation starts with the first ``head`` turns of ``base`` and goes on after its own first ``head`` turns.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"))
    bases = bases.where("conv_id is not null").select("conv_id", "base", F.col("head").cast("int").alias("head"))
    turns = turns.join(bases.select("conv_id", "head"), "conv_id")
    for draw in range(8):
        rows = held(paths(held(turn_fingerprints(turns, draw)), bases, draw))
        inner = held(rows.groupBy("depth", "print", "before", "digest").agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("n_bytes").alias("n_bytes")))
        if inner.groupBy("depth", "print").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("no base without collisions")

    top = F.lit(raw(0))
    root = bases.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), top.alias("print"), F.lit(None).cast("binary").alias("before"), "conv_id", "n_convs", F.lit(0).cast("long").alias("n_bytes"))
    nodes = inner.select("depth", "print", "before", "conv_id", "n_convs", "n_bytes").unionByName(root)
    children = inner.groupBy((F.col("depth") - 1).alias("depth"), F.col("before").alias("print")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = held(nodes.join(children, ["depth", "print"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
                 .withColumn("saving", F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("n_bytes")).otherwise(0)))

    # what each conversation owns: the nodes whose smallest member it is, and the leaf among them
    owned = nodes.groupBy("conv_id").agg(F.sum("saving").alias("owned"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    members = rows.select("conv_id", "depth", "print").unionByName(bases.select("conv_id", F.lit(0).cast("long").alias("depth"), top.alias("print")))
    sums = members.join(owned, "conv_id").groupBy("depth", "print").agg(F.sum("owned").alias("below"), F.sum("leaf").alias("n_leaves"))
    # less what a node's smallest member owns above it: running sums within blocks of depths, then over blocks
    block = F.expr(f"depth div {CHUNK}")
    blocks = nodes.groupBy("conv_id", block.alias("block")).agg(F.sum("saving").alias("s"))
    blocks = blocks.withColumn("above", F.sum("s").over(Window.partitionBy("conv_id").orderBy("block")) - F.col("s")).select("conv_id", "block", "above")
    here = F.sum("saving").over(Window.partitionBy("conv_id", "block").orderBy("depth")) - F.col("saving")
    nodes = nodes.withColumn("block", block).join(blocks, ["conv_id", "block"]).withColumn("above", here + F.col("above"))

    own_end = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "print")).alias("end"))
    ends = bases.select("conv_id").join(own_end, "conv_id", "left").select(
        F.coalesce("end.depth", F.lit(0)).alias("depth"), F.coalesce("end.print", top).alias("print"), "conv_id")
    ids = ends.groupBy("depth", "print", F.expr(f"conv_id div {CHUNK}").alias("chunk")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))  # CHUNK ids at most
    hashes = chained_hash(ids, ["depth", "print"], "chunk", "ids", ",").withColumnRenamed("sha256", "ends_sha256")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("print").alias("before"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, ["depth", "print"]).join(hashes, ["depth", "print"], "left").join(parents, ["depth", "before"], "left")
    return out.select(
        "depth", "print", "before", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("below") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


SQL = """
WITH t AS (SELECT list(c ORDER BY n) AS t FROM (
  SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n) AS c FROM range(256) r(n))),
ids AS (SELECT DISTINCT conv_id, split(conv_id::VARCHAR, '') AS s FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT conv_id, xor(list_reduce(list_transform(s, lambda x: ascii(x)::BIGINT),
  lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1]), 4294967295), 4294967295) % 9 AS h FROM ids, t),
own AS (SELECT conv_id, list({r: coalesce(role, ''), x: coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS l FROM conversations GROUP BY conv_id),
built AS (SELECT i.conv_id AS c, list_concat(coalesce(b.l[1:h], []), o.l[h + 1:]) AS s
  FROM heads i JOIN own o USING (conv_id) LEFT JOIN own b ON b.conv_id = i.conv_id - i.conv_id % 5),
p AS (SELECT c, d, len(s) = d AS stops, s[1:d] AS k FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM built)),
n AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (stops), '')) AS ends_sha256,
  CASE WHEN d > 0 THEN (count(*) - 1) * octet_length(encode(k[d].x)) ELSE 0 END AS saving FROM p GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
full_ AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
sub AS (SELECT k[1:q] AS k, sum(saving)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT k, saving, n_children, unnest(range(0, d + 1)) AS q FROM full_) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_ f JOIN sub USING (k) LEFT JOIN n u ON f.d > 0 AND u.k = f.k[1:f.d - 1]
"""


def dealt_bases(conversations: DataFrame) -> DataFrame:
    """conv_id, base, head: each conversation starts as the last one before it whose id is divisible by 5."""
    ids = conversations.where("conv_id is not null").select("conv_id").distinct()
    return ids.select("conv_id", F.expr("conv_id - conv_id % 5").alias("base"), F.expr("cast(crc32(cast(cast(conv_id as string) as binary)) % 9 as int)").alias("head"))


@bound("op12_prefix_trie", SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(conversations, held(dealt_bases(conversations))).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
