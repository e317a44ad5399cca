"""Turn repair and prefix trie against brute force on small random tables, and their edge cases."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from driftlane.llm import prefix_trie, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def random_turns(seed, conversations=30, longest=14):
    draw = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for _ in range(draw.randrange(longest)):
            rows.append((
                draw.choice([conv, conv, conv, None]) if conv == 7 else conv, draw.choice([None, *range(12)]), draw.choice(["system", "user", "assistant", "tool", "", None, "User"]),
                draw.choice(["One.", "Two", "Three!  \n", " \t", "", None, "Four?", f"Said {draw.randrange(3)}.", "x" * 50]),
            ))
    return rows


def plain_repair(rows):
    """Findings and repaired lines of one conversation, by a table over (turn, state)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda q: (q[0] is not None, q[0] or 0, q[1], hashlib.sha256(q[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = text.rstrip(WHITE)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {}
    for i in range(len(rows), -1, -1):
        inf = (10**9, "~")
        best.update({(i, s): inf for s in "-sua"})
        for _ in range(4):  # insertions may chain
            for s in "-sua":
                wanted = "a" if s == "u" else "u"
                options = [best[i, s]]
                if i == len(rows):
                    if s in "-a":
                        options.append((0, ""))
                else:
                    fault, role = faults[i], rows[i][1]
                    c, a = best[i + 1, s]
                    options.append((c + 4, "D" + a))
                    if fault not in ("blank", "duplicate"):
                        more = 3 * (fault == "truncated")
                        c, a = best[i + 1, wanted]
                        options.append((c + 3 + more, "R" + a))
                        if role[:1] == wanted:
                            options.append((c + more, "K" + a))
                        if s == "-" and role[:1] == "s":
                            c, a = best[i + 1, "s"]
                            options.append((c + more, "K" + a))
                c, a = best[i, wanted]
                options.append((c + 3, "I" + a))
                best[i, s] = min(options)
    cost, audit = best[0, "-"]
    out, state, turns = [], "-", iter(rows)
    for edit in audit:
        _, role, text = next(turns) if edit != "I" else (None, None, "")
        if edit == "D":
            continue
        state = role[0] if edit == "K" else "a" if state == "u" else "u"
        out.append((role if edit == "K" else {"u": "user", "a": "assistant"}[state], text))
    known = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit), out


@pytest.mark.parametrize("seed, block", [(1, 256), (2, 3), (3, 1)])
def test_repair_equals_a_plain_table(spark, seed, block):
    rows = random_turns(seed)
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(tuple(rest))
    findings, turns, digests = turn_repair.repair(spark.createDataFrame(rows, SCHEMA).withColumn("place", F.lit("x")), block)
    found = {r[0]: tuple(r)[1:] for r in findings.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").collect()}
    lines = {}
    for r in turns.orderBy("conv_id", "place").collect():
        assert r["place"] == len(lines.setdefault(r["conv_id"], []))
        lines[r["conv_id"]].append((r["role"], r["text"]))
    hashes = {r["conv_id"]: r["sha256"] for r in digests.collect()}
    assert found.keys() == by.keys() == hashes.keys()
    for conv, own in by.items():
        want, kept = plain_repair(own)
        assert found[conv] == want, conv
        assert lines.get(conv, []) == kept
        assert hashes[conv] == sha("\n".join(f"{r}:{t}" for r, t in kept))


def test_a_long_conversation_crosses_blocks(spark):
    draw = random.Random(5)
    rows = [(1, k, draw.choice(["user", "assistant", "tool"]), draw.choice([f"Turn {k}.", f"turn {k}", ""])) for k in range(700)]
    rows += [(2, k, "user", "w " * 60_000) for k in range(3)]
    findings, turns, _ = turn_repair.repair(spark.createDataFrame(rows, SCHEMA), 16)
    want, kept = plain_repair([r[1:] for r in rows if r[0] == 1])
    assert tuple(findings.where("conv_id = 1").drop("conv_id").select("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").first()) == want
    assert [(r["role"], r["text"]) for r in turns.where("conv_id = 1").orderBy("place").collect()] == kept


def test_nodes_of_a_common_ending_are_made_once():
    automaton = turn_repair.Automaton(*turn_repair.END)
    automaton.node("uua")
    before = automaton.nodes[:3]
    costs, audits, _ = automaton.node("aua")
    assert automaton.nodes[:3] == before and all(x is y for x, y in zip(automaton.nodes, before))
    assert costs[0] == 3
    assert audits[0] == plain_repair([(0, "assistant", "A."), (1, "user", "B."), (2, "assistant", "C.")])[0][-1]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert [df.count() for df in turn_repair.repair(empty)] == [0, 0, 0]
    assert prefix_trie.prefix_trie(empty, prefix_trie.dealt_bases(empty)).count() == 0


def plain_trie(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [q[2:] for q in sorted(v, key=lambda q: (q[:3], hashlib.sha256(f"{len(q[2].encode())}:{q[2]}{q[3]}".encode()).digest()))] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[:len(key)] == key]
        inner = {k[:-1] for k in nodes if k}
        ends = sorted(c for c in members if len(built[c]) == len(key))
        out.append((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(1 for k in nodes if k and k[:-1] == key),
            sum(1 for k in below if k not in inner), sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in below if k), sha(",".join(map(str, ends))),
        ))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_listed_prefixes(spark, seed):
    draw = random.Random(seed)
    rows = [(c, t, draw.choice(["user", None]), draw.choice(["a", "ä" * 3, None, "long " * 5])) for c in range(60) for t in [*range(draw.randrange(13)), None][:draw.randrange(14)]]
    rows += rows[:9] + [(None, 1, "user", "of nobody")] + [(5, 0, "user", "z" * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("head", F.lit("x")).withColumn("print", F.lit(1))
    nodes = prefix_trie.prefix_trie(df, prefix_trie.dealt_bases(df)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert sorted(map(tuple, nodes), key=repr) == plain_trie(rows)


def test_fingerprints_compose():
    values = [prefix_trie.value_of(hashlib.sha256(bytes([k])).digest()) for k in range(6)]
    base = prefix_trie.base_of(0)

    def run(part):
        whole, shift = 0, 1
        for v in part:
            whole, shift = prefix_trie.combine(whole, base, v), shift * base % prefix_trie.PRIME
        return whole, shift

    for cut in range(7):
        left, right = run(values[:cut]), run(values[cut:])
        assert prefix_trie.combine(left[0], right[1], right[0]) == run(values)[0]


def test_colliding_fingerprints_draw_a_new_base(spark, monkeypatch):
    true = prefix_trie.base_of
    monkeypatch.setattr(prefix_trie, "base_of", lambda draw: 1 if draw == 0 else true(draw))  # base 1: order is lost
    rows = [(c, t, "user", x) for c, xs in ((0, "ab"), (1, "ba"), (2, "ab")) for t, x in enumerate(xs)]
    df = spark.createDataFrame(rows, SCHEMA)
    bases = spark.createDataFrame([(c, 99, 0) for c in range(3)], "conv_id long, base long, head int")
    found = prefix_trie.prefix_trie(df, bases).select("depth", "n_convs").collect()
    assert sorted(map(tuple, found)) == [(0, 3), (1, 1), (1, 2), (2, 1), (2, 2)]
