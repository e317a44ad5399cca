"""Repair of conversation structure, by a suffix-shared automaton of role and fault signatures.

A conversation's roles must read ``(s?(ua)+)?`` by their initials: an optional system turn, then pairs of
user and assistant, or nothing. Every turn has a fault: blank, duplicate (role and text seen earlier in the
conversation) or truncated (does not end a sentence), the first that holds. Turns may be kept (cost 0),
given the role that the grammar wants (3) or deleted (4; blank and duplicate turns must be), empty turns
inserted (3); a truncated turn that stays costs 3 more. Wanted are the cheapest edits, and of these the
ASCII-least audit string of their initials (D, I, K, R).

A conversation's signature is one letter per turn (role and fault), cut into blocks of BLOCK turns. The
distinct blocks of all conversations are sorted by their reversed letters, so blocks with a common ending
are neighbours and share the nodes of that ending: each node of this automaton, minimised from the end,
gets its cost-to-go and its best audit suffix once for each state of the grammar. Nodes whose costs differ by a
constant have the same edits, which are remembered under the letter and those costs. Blocks that
end a conversation start from the grammar's end; others start from the costs of the block that follows.
Those of long conversations come from costs between all pairs of states, one small record a block, which
are passed backwards through each conversation in a stream, and the states reached forwards.

Texts are not part of all this. They move once: sorted by conversation and turn, with one audit record
per block, a task streams turns and audits side by side and holds one turn at a time. So a conversation
with a third of all rows takes one task long (its repaired text is one sequence), but never much memory.

Turns go by turn number (null first), then role and the text's SHA-256. A null role or text counts as one
space, so it is blank or no role of the grammar. Rows with a null conv_id form one conversation. Repeated
rows are duplicates. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import takewhile

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlane.llm.base import bound, held, table

#: Turns of one block.
BLOCK = 256
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: States of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
STATES = range(4)
FAR = 1 << 40
#: Costs and audits after the last turn: a user turn lacks its answer, a system turn a pair.
END = ((0, 2 * INSERT, INSERT, 0), ("", "II", "I", ""))
SPACE = " \t\n\x0b\x0c\r"
#: Ascending order puts nulls first.
ORDER = ["turn", "role", "digest"]


def after(state: int) -> int:
    """The state after the turn which the grammar wants in ``state``: a user turn, or after one an assistant turn."""
    return 3 if state == 2 else 2


def letter(role: str, fault: str) -> str:
    """Column expression of a turn's letter: D must go; s u a o stay as they are, S U A O are truncated."""
    initial = f"if(left({role}, 1) in ('s', 'u', 'a'), left({role}, 1), 'o')"
    return f"case when {fault} in ('blank', 'duplicate') then 'D' when {fault} = 'truncated' then upper({initial}) else {initial} end"


@lru_cache(1 << 16)
def edits(sign: str, costs: tuple) -> tuple:
    """For each state: (cost, edit, next state) of the best edit before a turn; ``costs`` are those after it."""
    best = []
    for state in STATES:
        options = [(DELETE + costs[state], "D", state)]
        if sign != "D":
            extra, to = CUT * sign.isupper(), after(state)
            options.append((REROLE + extra + costs[to], "R", to))
            if sign.lower() == "ua"[to - 2]:
                options.append((extra + costs[to], "K", to))
            if sign.lower() == "s" and state == 0:
                options.append((extra + costs[1], "K", 1))
        best.append(min(options))
    user, answer = best[2], best[3]  # after a user turn, after an answer
    best[2] = min(user, (INSERT + answer[0], "I", 3))
    best[3] = min(answer, (INSERT + user[0], "I", 2))
    for state in (0, 1):
        best[state] = min(best[state], (INSERT + best[2][0], "I", 2))
    return tuple(best)


class Automaton:
    """The path of the last word, from its end: costs, audit suffixes and states reached, of each node."""

    def __init__(self, costs: tuple, audits: tuple):
        self.word = ""
        self.nodes = [(costs, audits, tuple(STATES))]

    def node(self, word: str) -> tuple:
        """The node of a whole word; words come sorted by their reversed letters."""
        shared = sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(reversed(word), reversed(self.word))))
        del self.nodes[shared + 1:]
        for sign in reversed(word[:len(word) - shared]):
            costs, audits, ends = self.nodes[-1]
            least = min(costs)
            best = edits(sign, tuple(c - least for c in costs))
            behind = [self._behind(best, audits, ends, state) for state in STATES]
            self.nodes.append((tuple(b[0] + least for b in best), tuple(a for a, _ in behind), tuple(e for _, e in behind)))
        self.word = word
        return self.nodes[-1]

    @staticmethod
    def _behind(best: tuple, audits: tuple, ends: tuple, state: int) -> tuple[str, int]:
        inserted = ""
        while best[state][1] == "I":
            inserted, state = inserted + "I", best[state][2]
        _, edit, to = best[state]
        return inserted + edit + audits[to], ends[to]


def evaluated(words: DataFrame) -> DataFrame:
    """block, context, costs, audits, ends (by state) of distinct ``words`` (block, context).

    A context holds the costs after the block, comma-joined, or is empty at the end of a conversation.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context, automaton = None, None
        for frame in frames:
            out = []
            for block, of in zip(frame["block"], frame["context"]):
                if of != context:
                    context = of
                    automaton = Automaton(tuple(map(int, of.split(","))), ("",) * 4) if of else Automaton(*END)
                out.append(automaton.node(block))
            yield pd.DataFrame({
                "block": frame["block"], "context": frame["context"],
                "costs": [list(o[0]) for o in out], "audits": [list(o[1]) for o in out], "ends": [list(o[2]) for o in out],
            })

    key = F.reverse("block")
    ordered = words.select("block", "context").distinct().repartitionByRange("context", key).sortWithinPartitions("context", key)
    return ordered.mapInPandas(run, "block string, context string, costs array<long>, audits array<string>, ends array<int>")


def turned(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest, blank, cut of every row."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    solid = F.rtrim(F.col("text"), F.lit(SPACE))
    return rows.select(
        "*", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        (solid == "").alias("blank"), (~F.right(solid, F.lit(1)).isin(".", "!", "?")).alias("cut"))


def examined(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, fault, illegal, new_turn, place (from 0) of every turn of ``turned``."""
    conv = Window.partitionBy("conv_id").orderBy(*ORDER)
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("turn"))
    pair = F.concat(F.lag(F.left("role", F.lit(1))).over(conv), F.left("role", F.lit(1)))
    return turns.withColumn("seen", seen).select(
        "conv_id", "turn", "role", "digest",
        F.when(F.col("blank"), "blank").when(F.col("seen") > 1, "duplicate").when(F.col("cut"), "truncated").otherwise("").alias("fault"),
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(conv))).alias("new_turn"),
        (F.row_number().over(conv) - 1).cast("long").alias("place"))


def passed(rows: DataFrame, schema: str, order, fresh, step) -> DataFrame:
    """Runs ``step(row, state) -> (output, state)`` through the rows of each conversation in order; ``fresh`` is the first state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), fresh
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != current:
                    current, state = row["conv_id"], fresh
                made, state = step(row, state)
                out.append(made)
            if out:
                yield pa.RecordBatch.from_pylist(out, types)

    types = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]) for name, kind in (f.split() for f in schema.split(", "))])
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", order).mapInArrow(run, schema)


def chosen(signatures: DataFrame) -> DataFrame:
    """conv_id, block_number, audit, cost of every block of ``signatures`` (conv_id, block_number, n_blocks, block)."""
    blocks = signatures.select("conv_id", "block_number", "n_blocks", "block", F.lit("").alias("context"))
    short = blocks.where("n_blocks = 1")
    one = short.join(evaluated(short), ["block", "context"]).select(
        "conv_id", "block_number", F.col("audits")[0].alias("audit"), F.col("costs")[0].alias("cost"))

    long = blocks.where("n_blocks > 1")
    last = F.expr("block_number = n_blocks - 1")
    units = F.expr("if(block_number = n_blocks - 1, array(''), array({}))".format(
        ", ".join("'" + ",".join("0" if s == t else str(FAR) for s in STATES) + "'" for t in STATES)))
    between = evaluated(long.select("block", F.explode(units).alias("context")))
    state_after = F.array_position(F.split("context", ","), "0")
    between = between.groupBy("block", (F.col("context") == "").alias("last")).agg(  # four records of a block at most
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(state_after.alias("t"), "costs"))), lambda x: x["costs"])).alias("between"))
    keyed = long.withColumn("last", last).join(between, ["block", "last"]).select("conv_id", "block_number", "block", "last", "between")

    def backwards(row: dict, costs: tuple) -> tuple[dict, tuple]:
        pairs = row["between"]
        context = "" if row["last"] else ",".join(map(str, costs))
        new = tuple(pairs) if row["last"] else tuple(min(pairs[4 * t + s] + costs[t] for t in STATES) for s in STATES)
        least = min(new)
        return {k: row[k] for k in ("conv_id", "block_number", "block")} | {"context": context}, tuple(c - least for c in new)

    contexts = held(passed(keyed, "conv_id long, block_number long, block string, context string", F.desc("block_number"), (0,) * 4, backwards))
    found = contexts.join(evaluated(contexts), ["block", "context"])

    def forwards(row: dict, state: int) -> tuple[dict, int]:
        end, own = row["ends"][state], row["costs"][state]
        after_ = list(map(int, row["context"].split(",")))[end] if row["context"] else 0
        return {"conv_id": row["conv_id"], "block_number": row["block_number"], "audit": row["audits"][state], "cost": own - after_}, end

    more = passed(found, "conv_id long, block_number long, audit string, cost long", F.asc("block_number"), 0, forwards)
    return one.unionByName(more)


def merged(conversations: DataFrame, audits: DataFrame, schema: str, output) -> DataFrame:
    """Turns and audits of each conversation side by side; ``output`` makes batches of a stream of (conv_id, role, text).

    The stream has (conv_id, None, None) at the start of each conversation, then its repaired turns.
    """
    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, state, queue = object(), 0, deque()

        def insertions() -> Iterator[tuple]:
            nonlocal state
            while queue and queue[0] == "I":
                queue.popleft()
                state = after(state)
                yield current, ("user", "assistant")[state - 2], ""

        for batch in batches:
            for conv, audit, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if conv != current:
                    yield from insertions()
                    current, state = conv, 0
                    yield conv, None, None
                if audit is not None:
                    queue.extend(audit)
                    continue
                yield from insertions()
                edit = queue.popleft()
                if edit == "K":
                    state = 1 if role[:1] == "s" else after(state)
                    yield conv, role, text
                elif edit == "R":
                    state = after(state)
                    yield conv, ("user", "assistant")[state - 2], text
        yield from insertions()

    rows = turned(conversations).select("conv_id", "turn", "role", "digest", F.lit(-1).cast("long").alias("block_number"), F.lit(None).cast("string").alias("audit"), "text") \
        .unionByName(audits.select("conv_id", "first.*", "block_number", "audit", F.lit(None).cast("string").alias("text")))
    # an audit comes before the turns that equal its first one
    order = ["conv_id", *ORDER, F.col("audit").isNull(), "block_number"]
    ordered = rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "audit", "role", "text")
    return ordered.mapInArrow(lambda batches: output(edited(batches)), schema)


def as_turns(turns: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    place, out, size = 0, [], 0

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["conv_id", "place", "role", "text"])

    for conv, role, text in turns:
        if role is None:
            place = 0
            continue
        out.append((conv, place, role, text))
        place, size = place + 1, size + len(text)
        if len(out) >= 1000 or size > 1 << 20:
            yield batch()
            out, size = [], 0
    yield batch()


def as_digests(turns: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1].hexdigest() for o in out], pa.string())], ["conv_id", "sha256"])

    out, joint = [], b""
    for conv, role, text in turns:
        if role is None:
            if len(out) >= 1000:
                yield batch()
                out = []
            out.append((conv, hashlib.sha256()))
            joint = b""
        else:
            out[-1][1].update(joint + f"{role}:{text}".encode())
            joint = b"\n"
    yield batch()


def repair(conversations: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings, repaired turns, and digests of the repaired conversations; ``conversations`` has conv_id, turn, role, text.

    Findings: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Turns: conv_id, place (from 0), role,
    text. Digests: conv_id, sha256 of the turns as ``role:text``, newline-joined.
    """
    rows = examined(turned(conversations).drop("text"))
    faults = ("blank", "duplicate", "truncated")
    signed = rows.withColumn("sign", F.expr(letter("role", "fault"))).groupBy("conv_id", F.expr(f"place div {block}").alias("block_number")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "sign"))), lambda x: x["sign"]), "").alias("block"),  # ``block`` letters at most
        F.min_by(F.struct("turn", "role", "digest"), "place").alias("first"), F.min("turn").alias("low"), F.max("turn").alias("high"),
        *(F.count_if(F.col("fault") == f).alias(f) for f in faults), F.count_if("illegal").alias("illegal"), F.count_if("new_turn").alias("turns"))
    signed = held(signed.withColumn("n_blocks", F.max("block_number").over(Window.partitionBy("conv_id")) + 1))
    same = F.expr("conv_id <=> _conv and block_number = _number")
    picked = chosen(signed.select("conv_id", "block_number", "n_blocks", "block")).withColumnsRenamed({"conv_id": "_conv", "block_number": "_number"})
    audits = held(signed.join(picked, same).drop("_conv", "_number", "block", "n_blocks"))
    findings = audits.groupBy("conv_id").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).cast("long").alias("gaps"),
        *(F.sum(f).alias(f) for f in (*faults, "illegal", "cost")),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_number", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    return (findings, merged(conversations, audits, "conv_id long, place long, role string, text string", as_turns),
            merged(conversations, audits, "conv_id long, sha256 string", as_digests))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with rows dropped, emptied, cut, repeated or given to the user, by a hash of id and turn."""
    spot = F.expr("crc32(cast(concat(coalesce(cast(conv_id as string), ' '), ':', coalesce(cast(turn as string), ' ')) as binary)) % 20")
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), spot.alias("spot")).where("spot <> 0")
    return rows.withColumn("copy", F.explode(F.expr("sequence(0, if(spot = 3, 1, 0))"))).select(
        "conv_id", "turn", F.when(F.col("spot") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("spot") == 1, "").when(F.col("spot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"))


def _more(value: str, cost, edit: str) -> str:
    """SQL of a cost of nine digits and an audit, with one edit put before."""
    return f"(lpad((left({value}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{edit}' || {value}[10:])"


def _step(v: str, x: str) -> str:
    """SQL of the four best (cost, audit) before a turn with letter x, from those after it."""
    direct = []
    for state in STATES:
        to, extra = after(state), f"{CUT} * ({x} = upper({x}))::INT"
        options = [_more(f"{v}[{state + 1}]", DELETE, "D"), f"CASE WHEN {x} <> 'D' THEN {_more(f'{v}[{to + 1}]', f'{REROLE} + {extra}', 'R')} END",
                   f"CASE WHEN lower({x}) = '{'ua'[to - 2]}' THEN {_more(f'{v}[{to + 1}]', extra, 'K')} END"]
        if state == 0:
            options.append(f"CASE WHEN lower({x}) = 's' THEN {_more(f'{v}[2]', extra, 'K')} END")
        direct.append(f"least({', '.join(options)})")
    pair = f"least(d[3], {_more('d[4]', INSERT, 'I')})", f"least(d[4], {_more('d[3]', INSERT, 'I')})"
    closed = [f"least(d[{k}], {_more('p[1]', INSERT, 'I')})" for k in (1, 2)]
    return (f"list_transform([[{', '.join(direct)}]], lambda d: list_transform([[{pair[0]}, {pair[1]}]], "
            f"lambda p: [{closed[0]}, {closed[1]}, p[1], p[2]])[1])[1]")


SQL = rf"""
WITH t AS (SELECT list(c ORDER BY n) AS t FROM (
  SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n) AS c FROM range(256) r(n))),
spots AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_transform(split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
    lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1]), 4294967295), 4294967295) % 20 AS spot FROM conversations, t),
dam AS (SELECT conv_id, turn, CASE WHEN spot = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN spot = 1 THEN '' WHEN spot = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(0, CASE WHEN spot = 3 THEN 2 ELSE 1 END)) AS copy
  FROM spots WHERE spot <> 0),
seq AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS place,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM dam),
fau AS (SELECT *, left(role, 1) AS i, CASE WHEN solid = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) AS pair FROM seq),
sig AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'D' WHEN fault = 'truncated' THEN upper(CASE WHEN i IN ('s', 'u', 'a') THEN i ELSE 'o' END)
  WHEN i IN ('s', 'u', 'a') THEN i ELSE 'o' END AS sign FROM fau),
per AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
  list_reduce(list(sign ORDER BY place DESC), lambda v, x: {_step('v', 'x[1]')}, ['000000000', '000000006II', '000000003I', '000000000']) AS best
  FROM (SELECT * REPLACE ([sign] AS sign) FROM sig) GROUP BY conv_id),
ed AS (SELECT conv_id, unnest(split(best[1][10:], '')) AS e, generate_subscripts(split(best[1][10:], ''), 1) AS k FROM per WHERE length(best[1]) > 9),
num AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS place FROM ed),
outs AS (SELECT n.conv_id, n.k, n.e, s.role, s.text, row_number() OVER (PARTITION BY n.conv_id ORDER BY n.k) - 1 AS m
  FROM num n LEFT JOIN sig s ON n.e <> 'I' AND s.conv_id IS NOT DISTINCT FROM n.conv_id AND s.place = n.place WHERE n.e <> 'D'),
led AS (SELECT *, max((m = 0 AND e = 'K' AND left(role, 1) = 's')::INT) OVER (PARTITION BY conv_id) AS led FROM outs),
txt AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (m - led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS r
  FROM led GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(left(best[1], 9)::BIGINT, 0) AS cost, coalesce(best[1][10:], '') AS audit, sha256(coalesce(r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN per p ON p.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN txt x ON x.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@bound("op11_turn_repair", SQL)
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    findings, _, digests = repair(damaged(conversations))
    found = findings.join(digests.withColumnRenamed("conv_id", "_id"), F.expr("conv_id <=> _id")).withColumnRenamed("conv_id", "_conv").drop("_id")
    out = conversations.select("conv_id").distinct().join(found, F.expr("conv_id <=> _conv"), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
