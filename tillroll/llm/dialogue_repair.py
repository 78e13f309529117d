"""Conversation structure repair: the cheapest edits that make roles take turns.

A conversation's rows and the roles written so far span a lattice of
``(rows read, last role)``. Its edges are the edits: keep a row (0), change its
role (2), delete it (3, the only way for blank and duplicate rows) and insert
an empty message (2); a truncated row that stays costs 1 more. The written
roles must be an optional system message and then pairs of user and assistant.
:func:`cheapest` runs Dijkstra's search from both ends, goes on until no
crossing of equal cost can be missing, and takes the crossing whose audit (the
edits' initials in order) is least.

Rows are sorted over all partitions at once, so a conversation of any length is
spread over tasks and cut into blocks of ``BLOCK`` rows. A block that holds a
whole conversation is solved outright, any other for each pair of roles at its
two ends; a conversation's blocks are then folded in order. Only the audits
(a byte a row, part of the result) meet in one place: texts pass by as a stream.
Copies of a row are counted before the sort, so a row repeated very often is one row there.

Edge cases: a null role or text counts as one space; rows are ordered by turn
(null first), then role, text (its first 64 characters, then its hash); equal
rows are each an own row, all but the first of them duplicates; null ids are one
conversation; a conversation without rows is not in the result; an empty table
gives no rows; long texts are hashed, never compared; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.session import materialize

SPACES = " \t\n\x0b\x0c\r"
#: What was written last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
ROLE_AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what a changed or new message becomes
KEPT_AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
BEFORE_ROLE = {to: [q for q in range(4) if ROLE_AFTER[q] == to] for to in range(4)}
BEFORE_KEPT = {(to, c): [q for (q, d), t in KEPT_AFTER.items() if (t, d) == (to, c)] for to in range(4) for c in "sua"}
LEGAL = {"su", "ua", "au"}
CHANGE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
#: Rows of a block: a task solves so many at a time.
BLOCK = 1024


class Repair(NamedTuple):
    """``paths``: conv_id, blank, duplicate, truncated, illegal, cost, audit. ``rows``: the rows they were found for."""

    paths: DataFrame
    rows: DataFrame


def cheapest(rows: list[tuple[str, str]], start: int = START, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits of ``rows`` (initial of the role; ``b``, ``d``, ``t`` for blank,
    duplicate, truncated, else empty) from ``start`` to one of ``ends``; of several, the least audit."""
    n = len(rows)
    if not n and start in ends:
        return 0, ""  # staying costs nothing, any insertion does

    def onward(i: int, q: int) -> list[tuple[str, int, int, int]]:
        out = [("I", i, ROLE_AFTER[q], INSERT)]
        if i < n:
            initial, fault = rows[i]
            out.append(("D", i + 1, q, DELETE))
            if fault not in ("b", "d"):
                more = CUT_SHORT * (fault == "t")
                out.append(("R", i + 1, ROLE_AFTER[q], CHANGE + more))
                if (q, initial) in KEPT_AFTER:
                    out.append(("K", i + 1, KEPT_AFTER[q, initial], more))
        return out

    def backward(i: int, q: int) -> list[tuple[str, int, int, int]]:
        out = [("I", i, p, INSERT) for p in BEFORE_ROLE[q]]
        if i:
            initial, fault = rows[i - 1]
            out.append(("D", i - 1, q, DELETE))
            if fault not in ("b", "d"):
                more = CUT_SHORT * (fault == "t")
                out += [("R", i - 1, p, CHANGE + more) for p in BEFORE_ROLE[q]]
                out += [("K", i - 1, p, more) for p in BEFORE_KEPT.get((q, initial), ())]
        return out

    # Heaps of (cost, rows read from that end, audit, role). Edges that cost nothing read a row, so of
    # equal costs those with fewer rows come first: each node leaves its heap with its least audit.
    heaps = [[(0, 0, "", start)], [(0, 0, "", q) for q in ends]]
    done: tuple[dict, dict] = ({}, {})
    best: tuple[int, str] | None = None
    while True:
        top = [h[0][0] if h else float("inf") for h in heaps]
        if best is not None and top[0] + top[1] > best[0] or not (heaps[0] or heaps[1]):
            return best
        if len(done[1]) < len(ends) or not heaps[0]:  # all ends first
            side = 1
        elif not done[0] or not heaps[1]:
            side = 0
        else:
            side = int((top[1], len(done[1])) < (top[0], len(done[0])))
        cost, read, audit, q = heappop(heaps[side])
        i = n - read if side else read
        if (i, q) in done[side]:
            continue
        done[side][i, q] = cost, audit
        for edit, j, p, more in (backward if side else onward)(i, q):
            extended = edit + audit if side else audit + edit
            if (j, p) not in done[side]:
                heappush(heaps[side], (cost + more, n - j if side else j, extended, p))
            if (j, p) in done[1 - side]:
                other, rest = done[1 - side][j, p]
                if best is None or cost + more + other <= best[0]:
                    crossing = cost + more + other, rest + extended if side else extended + rest
                    best = crossing if best is None else min(best, crossing)


def _null_safe(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


ORDER = ["conv_id", "turn", "role", "head", "digest"]


def _ordered_rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Distinct rows: the columns of ``ORDER``, ``copies`` and ``text``."""
    role = F.coalesce(conversations[role_col].cast("string"), F.lit(" "))
    text = F.coalesce(conversations[text_col].cast("string"), F.lit(" "))
    rows = conversations.select(
        conversations[conv_col].alias("conv_id"), conversations[turn_col].alias("turn"), role.alias("role"), text.alias("text"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"))
    return rows.groupBy("conv_id", "turn", "role", "digest").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text")).withColumn(
        "head", F.substring("text", 1, 64))


def _faults(rows: DataFrame) -> DataFrame:
    """The rows without their texts, with ``initial`` and ``fault``."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    tagged = rows.select(*ORDER, "copies", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
                         F.right(end, F.lit(1)).alias("last"))
    # where a text comes back, the turn of its first row; nearly all texts come once and need no join
    seen = (rows.groupBy("conv_id", "digest")
            .agg(F.count(F.lit(1)).alias("n"), F.max(F.col("turn").isNull()).alias("no_turn"), F.min("turn").alias("first_turn"))
            .where("n > 1").select(F.col("conv_id").alias("s_conv"), F.col("digest").alias("s_digest"), "no_turn", "first_turn"))
    both = tagged.join(seen, tagged.conv_id.eqNullSafe(seen.s_conv) & (tagged.digest == seen.s_digest), "left")
    later = F.col("s_digest").isNotNull() & F.col("turn").isNotNull() & (F.col("no_turn") | (F.col("turn") > F.col("first_turn")))
    fault = (F.when(F.col("last") == "", "b").when(later, "d").when(~F.col("last").isin(".", "!", "?"), "t").otherwise(""))
    return both.select(*ORDER, "copies", "initial", fault.alias("fault"))


def _solve_blocks(marked: DataFrame, block: int) -> DataFrame:
    """Cheapest edits of blocks of rows that follow each other, for each pair of roles at their ends."""
    kind = marked.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {kind}, part int, seq long, head string, tail string, blank long, duplicate long, truncated long, "
              "illegal long, start int, end int, cost long, audit string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, own = TaskContext.get().partitionId(), 0, 0
        conv, held, inside, out = None, [], False, []

        def solve(whole: bool) -> None:
            nonlocal seq
            faults = [f for _, f in held]
            common = (conv, part, seq, held[0][0], held[-1][0], faults.count("b"), faults.count("d"), faults.count("t"),
                      sum(a + b not in LEGAL for (a, _), (b, _) in zip(held, held[1:])))
            ways = [(START, -1, cheapest(held))] if whole else [(q, r, cheapest(held, q, (r,))) for q in range(4) for r in range(4)]
            out.extend((*common, q, r, *found) for q, r, found in ways if found)
            seq += 1
            held.clear()

        def table() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for b in batches:
            types = [b.schema.field("conv_id").type, pa.int32(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.int64(), pa.string()]
            names = ["conv_id", "part", "seq", "head", "tail", "blank", "duplicate", "truncated", "illegal", "start", "end", "cost", "audit"]
            for c, initial, fault, copies in zip(*(b.column(x).to_pylist() for x in ("conv_id", "initial", "fault", "copies"))):
                if own and c != conv:
                    if held:
                        solve(inside)  # neither the task's first conversation nor cut: nothing of it is elsewhere
                    inside = True
                conv, own = c, own + 1
                for k in range(copies):
                    held.append((initial, fault if fault == "b" or not k else "d"))
                    if len(held) == block:
                        solve(False)
                        inside = False
            yield table()
        if held:
            solve(False)
            yield table()

    sorted_rows = marked.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return sorted_rows.select("conv_id", "initial", "fault", "copies").mapInArrow(run, schema)


def _fold(blocks: DataFrame) -> DataFrame:
    """One row a conversation out of its blocks, taken in order."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at, tail, counts, ways, ahead, out, first = None, None, "", [0] * 4, {}, {}, [], True

        def close() -> None:
            ends = [way for q, way in ahead.items() if q in (-1, *ENDS)]
            out.append((conv, *counts, *min(ends)))

        for b in batches:
            types = [b.schema.field("conv_id").type, *[pa.int64()] * 5, pa.string()]
            for c, part, seq, head, last, *sums, start, end, cost, audit in zip(*(x.to_pylist() for x in b.columns)):
                if first or c != conv:
                    if not first:
                        close()
                    conv, at, tail, counts, ways, ahead, first = c, None, "", [0] * 4, {START: (0, "")}, {START: (0, "")}, False
                if (part, seq) != at:  # a further block
                    sums[3] += bool(tail) and tail + head not in LEGAL
                    counts = [x + y for x, y in zip(counts, sums)]
                    at, tail, ways, ahead = (part, seq), last, ahead, {}
                if start in ways:
                    way = ways[start][0] + cost, ways[start][1] + audit
                    ahead[end] = min(ahead.get(end, way), way)
            columns, out = list(zip(*out)) if out else [()] * len(types), []
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names)
        if not first:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, schema)


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", block: int = BLOCK) -> Repair:
    """The cheapest edits of each conversation; :func:`messages` applies them."""
    rows = materialize(_ordered_rows(conversations, conv_col, turn_col, role_col, text_col), "turns")
    blocks = materialize(_solve_blocks(_faults(rows), block), "edit-blocks")
    return Repair(materialize(_fold(blocks), "edit-paths"), rows)


def _streams(fixed: Repair) -> DataFrame:
    """Each conversation's audit, then its rows in order, side by side in one partition."""
    paths = fixed.paths.select("conv_id", F.lit(0).alias("kind"), "audit", *[
        F.lit(None).cast(fixed.rows.schema[c].dataType).alias(c) for c in (*ORDER[1:], "copies", "text")])
    rows = fixed.rows.select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), *ORDER[1:], "copies", "text")
    return (paths.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER[1:])
            .select("conv_id", "audit", "role", "copies", "text"))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """For each batch of :func:`_streams` the messages ``(conv_id, seq, edit, role, text)`` that are written;
    a conversation begins with ``(conv_id, 0, None, None, None)``."""
    conv, audit, at, seq, after = None, "", 0, 0, START

    def inserted() -> Iterator[tuple]:
        """The new messages that come next in the audit."""
        nonlocal at, seq, after
        while at < len(audit) and audit[at] == "I":
            after = ROLE_AFTER[after]
            seq, at = seq + 1, at + 1
            yield conv, seq, "I", "user" if after == USER else "assistant", ""

    for b in batches:
        out: list[tuple] = []
        for c, path, role, copies, text in zip(*(x.to_pylist() for x in b.columns)):
            if path is not None:
                out.extend(inserted())
                conv, audit, at, seq, after = c, path, 0, 0, START
                out.append((c, 0, None, None, None))
                continue
            for _ in range(copies):
                out.extend(inserted())
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                after = KEPT_AFTER[after, role[:1]] if edit == "K" else ROLE_AFTER[after]
                seq += 1
                out.append((conv, seq, edit, role if edit == "K" else "user" if after == USER else "assistant", text))
        # what is inserted behind the last row of the batch comes with the next one, or here where the audit ends
        if at < len(audit) and set(audit[at:]) == {"I"}:
            out.extend(inserted())
        yield out


def messages(fixed: Repair) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``seq`` (from 1), ``edit`` (K, R or I), ``role``, ``text``."""
    kind = fixed.paths.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "seq", "edit", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def typed():
            nonlocal types
            for b in batches:
                types = [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
                yield b

        types: list = []
        for out in _edited(typed()):
            rows = [m for m in out if m[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], names)

    return _streams(fixed).mapInArrow(run, f"conv_id {kind}, seq long, edit string, role string, text string")


def digests(fixed: Repair) -> DataFrame:
    """``conv_id`` and ``repaired_sha256``, the SHA-256 of the repaired ``role:text`` messages, newline-joined."""
    kind = fixed.paths.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def typed():
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field("conv_id").type
                yield b

        def table(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), pa.array([r[1].hexdigest() for r in rows])],
                                              ["conv_id", "repaired_sha256"])

        id_type, current = None, None
        for out in _edited(typed()):
            ended = []
            for conv, seq, _, role, text in out:
                if not seq:
                    if current:
                        ended.append(current)
                    current = conv, hashlib.sha256()
                else:
                    current[1].update(f"{chr(10) * (seq > 1)}{role}:{text}".encode("utf-8", "surrogatepass"))
            yield table(ended)
        if current:
            yield table([current])

    return _streams(fixed).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def gaps(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """``conv_id`` and ``gaps``, the turns missing between its first and last (none known: 0)."""
    t = conversations.select(conversations[conv_col].alias("conv_id"), conversations[turn_col].alias("turn"))
    return t.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` with one row in twenty each dropped, emptied, without sentence ends, repeated or given to the user."""
    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", known("conv_id"), known("turn"))) % 20
    return conversations.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(known("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text")).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        kind.alias("kind"),
    ).where("kind <> 0").drop("copy", "kind")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damages the conversations and repairs them: a row for each original ``conv_id``."""
    broken = materialize(damage(conversations), "damaged")
    fixed = repair(broken)
    ids = conversations.select("conv_id").distinct()
    out = ids
    for part in (gaps(broken), fixed.paths, digests(fixed)):
        out = out.join(part, _null_safe(ids, part, "conv_id"), "left").drop(part["conv_id"])
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
