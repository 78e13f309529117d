"""Conversation repair against plain recursion over all edits, by rows and by whole tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tillroll.llm import catalog, dialogue_repair
from tillroll.llm.dialogue_repair import ASSISTANT, START, SYSTEM, USER, cheapest

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]")
EMPTY = hashlib.sha256(b"").hexdigest()


def apply(rows, audit):
    """Cost and messages of an audit over ``(role, text, fault)`` rows, or None if it is not allowed."""
    left, out, cost = list(rows), [], 0
    for edit in audit:
        due = "user" if not out or out[-1][0][:1] in ("s", "a") else "assistant"
        if edit == "I":
            out.append((due, ""))
            cost += 2
            continue
        if not left:
            return None
        role, text, fault = left.pop(0)
        if edit == "D":
            cost += 3
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += (fault == "truncated") + 2 * (edit == "R")
        out.append((role if edit == "K" else due, text))
    roles = [r[:1] for r, _ in out]
    if left or "" in roles or not re.fullmatch("(s?(ua)+)?", "".join(roles)):
        return None
    return cost, out


def every_audit(rows, extra):
    best = None
    for n in range(len(rows), len(rows) + extra + 1):
        for audit in itertools.product("DIKR", repeat=n):
            if audit.count("I") == n - len(rows) and (got := apply(rows, audit)):
                way = got[0], "".join(audit)
                best = way if best is None else min(best, way)
    return best


def by_steps(rows):
    """Least (cost, audit) for each role at hand, row by row."""
    turn = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    ways = {"": (0, "")}

    def put(new, q, way):
        if q not in new or way < new[q]:
            new[q] = way

    def insert(new):
        for _ in range(4):
            for q, (c, a) in list(new.items()):
                put(new, turn[q][0], (c + 2, a + "I"))
        return new

    insert(ways)
    for role, _, fault in rows:
        new = {}
        for q, (c, a) in ways.items():
            put(new, q, (c + 3, a + "D"))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                put(new, turn[q][0], (c + 2 + more, a + "R"))
                if (q, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    put(new, role[:1], (c + more, a + "K"))
        ways = insert(new)
    return min(ways[q] for q in ("", "a") if q in ways)


def coded(rows):
    return [(r[:1] if r[:1] in ("s", "u", "a") else "x", {"": ""}.get(f, f[:1])) for r, _, f in rows]


def faulty(rows):
    """(role, text, fault) of the rows (turn, role, text) of a conversation, in order."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, out = set(), []
    for _, role, text in rows:
        marks = WORDS.findall(text)
        fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute(table):
    groups = {}
    for c, t, r, x in table:
        groups.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 1:
            x = ""
        if kind == 2:
            x = re.sub("[.!?]", "", x)
        if kind == 4:
            r = "user"
        groups[c] += [(t, r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = set()
    for c, damaged in groups.items():
        rows = faulty(damaged)
        turns = {t for t, _, _ in damaged if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = by_steps(rows)
        faults = [f for _, _, f in rows]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        text = "\n".join(f"{r}:{x}" for r, x in apply(rows, audit)[1])
        out.add((c, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                 hashlib.sha256(text.encode()).hexdigest()))
    return out


SCHEMA = "conv_id long, turn int, role string, text string"


def got(df):
    rows = df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert len({tuple(r) for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def random_rows(rng, n):
    return [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), "x", rng.choice(["", "", "", "blank", "duplicate", "truncated"]))
            for _ in range(n)]


def test_search_takes_the_cheapest_and_least_of_all_audits():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 3, 4, 4):
        for _ in range(12):
            rows = random_rows(rng, n)
            assert cheapest(coded(rows)) == every_audit(rows, 3), rows


def test_search_equals_steps_over_longer_conversations():
    rng = random.Random(2)
    for _ in range(300):
        rows = random_rows(rng, rng.randrange(40))
        assert cheapest(coded(rows)) == by_steps(rows), rows


def test_blocks_put_together_equal_the_whole():
    rng = random.Random(3)
    for _ in range(60):
        rows = coded(random_rows(rng, rng.randrange(2, 30)))
        cut = rng.randrange(1, len(rows))
        ways = {}
        for q in (START, SYSTEM, USER, ASSISTANT):
            a, b = cheapest(rows[:cut], START, (q,)), cheapest(rows[cut:], q)
            if a and b:
                ways[q] = a[0] + b[0], a[1] + b[1]
        assert min(ways.values()) == cheapest(rows)


def test_query_equals_brute_force(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    result = catalog.op11_conversation_repair(spark, SF)
    assert got(result) == brute(table)
    assert dict(result.dtypes) == {"conv_id": "bigint", "audit": "string", "repaired_sha256": "string",
                                   **dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], "bigint")}


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_long_conversation_over_blocks_and_partitions(spark, block):
    rng = random.Random(4)
    table = [(7, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["One.", "Two", f"Row {t}.", " ", f"Row {t}"])) for t in range(400)]
    table += [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {t}.") for c in (6, 8, 9) for t in range(4)]
    df = spark.createDataFrame(table, SCHEMA).repartition(6)
    fixed = dialogue_repair.repair(df, block=block)
    want = {}
    for c in (6, 7, 8, 9):
        rows = faulty([(t, r, x) for i, t, r, x in table if i == c])
        want[c] = (*by_steps(rows), apply(rows, by_steps(rows)[1])[1])
    assert {r.conv_id: (r.cost, r.audit) for r in fixed.paths.collect()} == {c: w[:2] for c, w in want.items()}
    told = {}
    for r in dialogue_repair.messages(fixed).orderBy("conv_id", "seq").collect():
        told.setdefault(r.conv_id, []).append((r.role, r.text))
    assert told == {c: w[2] for c, w in want.items() if w[2]}
    digest = {r.conv_id: r.repaired_sha256 for r in dialogue_repair.digests(fixed).collect()}
    assert digest == {c: hashlib.sha256("\n".join(f"{r}:{x}" for r, x in w[2]).encode()).hexdigest() for c, w in want.items()}


def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark):
    long = "word " * 200_000
    table = [
        (None, None, None, None), (None, 1, "user", None), (None, 1, "user", "Hello."), (None, 2, None, "There."),
        (1, None, "user", "Early."), (1, None, "user", "Early."), (1, 5, "assistant", "Late."), (1, 5, "assistant", "Earlier."), (1, 9, "user", "Early."),
        (2, 1, "user", long), (2, 2, "assistant", long + "."), (2, 3, "user", long), (2, 4, "assistant", "\x0b\x0c \t"),
        (3, 1, "", "No role."), (3, 2, "user", "é ."), (4, 1, "system", "Only."), (5, 3, "user", "Bye.\n"),
    ] + [(6, 1, "user", "Again.")] * 50
    df = spark.createDataFrame([(*r, "x", 1) for r in table], SCHEMA + ", audit string, digest int")
    assert got(dialogue_repair.repair_damaged(df)) == brute(table)


def test_all_rows_dropped_and_empty_tables(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 1, "user", "Hi.")], SCHEMA)
    assert got(dialogue_repair.repair_damaged(df)) == {(gone, 0, 0, 0, 0, 0, 0, "", EMPTY)}
    empty = spark.createDataFrame([], SCHEMA)
    assert got(dialogue_repair.repair_damaged(empty)) == set()
    assert dialogue_repair.messages(dialogue_repair.repair(empty)).count() == 0
    assert dialogue_repair.gaps(df.withColumn("turn", F.lit(None).cast("int"))).collect()[0].gaps == 0
