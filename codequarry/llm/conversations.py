"""Repair of a conversation's turn structure at the least cost, by dynamic programming over turns and the states of a role grammar.

A conversation should read s?(ua)+ or nothing, by its roles' initials. Going backward over the turns, each state of the grammar gets its
cost to go: the least cost of making the turns from here on end well. Going forward from the first state, each step takes the
ASCII-least edit among those that are tight (whose cost and cost to go after it add up to the cost to go here), which gives
the ASCII-least of all cheapest edit strings. In each state an insertion or a new role can only be one: what the grammar asks for next.

Turns are ordered by Spark in ranges of conversation and turn, so a conversation of any length is dealt out over many tasks as pieces
of bounded length. Equal rows stand once, with their number. A piece is worth a small table: the least cost from each state at its start to
each state at its end. Those tables, chained backward, give the cost to go at each piece's end; every piece then walks from
each state that it could start in, and the states reached, chained forward, say which walk counts. Chains take a row per
piece and hold one at a time. Conversations that lie inside one piece, nearly all, need no chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codequarry.llm.common import forget, ship, written

BLANKS = " \t\n\x0b\f\r"
#: Rows of a conversation in one piece at most.
PIECE = 1 << 14
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
#: States: at the start, behind s, behind u, behind a. What the grammar asks for next is u, u, a, u.
WANTED = "uuau"
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FORCED = (AFTER[0, "u"], AFTER[1, "u"], AFTER[2, "a"], AFTER[3, "u"])
ROLES = {"u": "user", "a": "assistant"}
INF = 1 << 40
Costs = tuple[int, int, int, int]


def closed(costs: list[int]) -> list[int]:
    """Costs to go where turns may be inserted first."""
    two, three = min(costs[2], costs[3] + INSERT), min(costs[3], costs[2] + INSERT)
    return [min(costs[0], two + INSERT), min(costs[1], two + INSERT), two, three]


#: Cost to go behind the last turn: the start and a finished pair are good ends.
END: Costs = tuple(closed([0, INF, INF, 0]))


@lru_cache(maxsize=1 << 16)
def back(initial: str, cut: bool, after: Costs) -> tuple[Costs, int]:
    """Cost to go before a turn, less its least, and that least."""
    own = TRUNCATED * cut
    costs = []
    for s in range(4):
        kept = AFTER.get((s, initial))
        costs.append(min(DELETE + after[s], REROLE + own + after[FORCED[s]], INF if kept is None else KEEP + own + after[kept]))
    costs = closed(costs)
    least = min(costs)
    return tuple(INF if c >= INF >> 1 else c - least for c in costs), least


@lru_cache(maxsize=1 << 16)
def step(initial: str, cut: bool, after: Costs, state: int) -> tuple[str, int]:
    """The tight edits at a turn (insertions before it, and then its own), ASCII-least, and the state behind it. after: cost to go behind the turn."""
    before, least = back(initial, cut, after)
    here = [c + least for c in before]
    own, edits = TRUNCATED * cut, ""
    while True:
        if DELETE + after[state] == here[state]:
            return edits + "D", state
        if INSERT + here[FORCED[state]] == here[state]:
            edits, state = edits + "I", FORCED[state]
            continue
        kept = AFTER.get((state, initial))
        if kept is not None and KEEP + own + after[kept] == here[state]:
            return edits + "K", kept
        return edits + "R", FORCED[state]


def ending(state: int) -> str:
    """The insertions behind the last turn."""
    edits = ""
    while END[state]:
        edits, state = edits + "I", FORCED[state]
    return edits


def table_of(turns: list[tuple[str, bool]]) -> np.ndarray:
    """Least cost from each state before some turns to each state behind them (no insertion behind the last)."""
    out = np.full((4, 4), INF, np.int64)
    for end in range(4):
        costs, total = tuple(0 if s == end else INF for s in range(4)), 0
        for initial, cut in reversed(turns):
            costs, least = back(initial, cut, costs)
            total += least
        out[:, end] = [INF if c >= INF >> 1 else c + total for c in costs]
    return out


def walk(turns: list[tuple[str, bool]], after: Costs, state: int) -> tuple[list[str], int]:
    """The edits at each of some turns from a state, and the state behind them. after: cost to go behind the last."""
    goes = [after]
    for initial, cut in reversed(turns):
        goes.append(back(initial, cut, goes[-1])[0])
    goes.reverse()
    out = []
    for (initial, cut), to_go in zip(turns, goes[1:], strict=True):
        edits, state = step(initial, cut, to_go, state)
        out.append(edits)
    return out, state


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """rows with faults put in by crc32 of `conv:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes .!? out of it, 3 lists it twice, 4 makes its role user.

    Nulls are one space: in the text, in the role and in what is hashed. Other columns stay as they are.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    role, text = said(role_col), said(text_col)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    shown = {role_col: F.when(kind == 4, "user").otherwise(role), text_col: text}
    own = [shown[c].alias(c) if c in shown else F.col(c) for c in rows.columns]
    times = F.array_repeat(F.lit(1), F.when(kind == 3, 2).otherwise(1))
    return rows.where(kind != 0).select(*own, F.explode(times).alias("damage_copy")).drop("damage_copy")


@dataclass
class Repaired:
    """report: conv, gaps, blank, duplicate, truncated, illegal, cost (longs), audit (the edits' initials).
    turns: conv, part, seq, i, j (in this order a turn's place), role, text: the repaired conversations."""

    report: DataFrame
    turns: DataFrame


def _narrow(rows: DataFrame) -> DataFrame:
    """Of rows (conv, turn, role, text): k1, k2 (hash of the row), conv, turn, role, d1, d2 (hash of role and text), initial, fault (0 none,
    1 blank, 3 truncated), n: equal rows once."""
    solid = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(solid == "", 1).when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.left("role", F.lit(1))
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    both = lambda *x: [F.xxhash64(*x), F.xxhash64(F.lit(7), *x)]
    (k1, k2), (d1, d2) = both(*_row_key()), both("role", "text")
    keyed = rows.select(k1.alias("k1"), k2.alias("k2"), "conv", "turn", F.xxhash64("role").alias("role"), d1.alias("d1"), d2.alias("d2"), initial.alias("initial"), fault.alias("fault"))
    return keyed.groupBy(keyed.columns).agg(F.count("*").alias("n"))


def _row_key() -> list[Column]:
    return [F.col("conv").isNull(), F.col("conv"), F.col("turn").isNull(), F.col("turn"), F.col("role"), F.col("text")]


_ORDER = ["conv", "turn", "role", "d1", "d2"]
_PIECES = "whole boolean, part int, seq long, first string, last string, illegal long, turns binary, ns array<long>, k1 array<long>, k2 array<long>, costs array<long>"
_FAULTS = {0: 0, 1: 1, 2: 1, 3: 2}  # as written in a piece: sound, forced out, truncated


def _with_ddl(schema: T.StructType, more: str) -> T.StructType:
    return T.StructType(schema.fields + T.StructType.fromDDL(more).fields)


def _decoded(data: bytes) -> list[tuple[str, bool]]:
    """A piece's turns that aren't forced out: initial and whether it is truncated."""
    return [("-sua"[x >> 2], x & 3 == 2) for x in data if x & 3 != 1]


def _pieces(ordered: DataFrame, piece: int) -> DataFrame:
    """Pieces of conversations out of ordered rows: with a table of costs unless the piece is a whole conversation."""
    schema = _with_ddl(ordered.select("conv").schema, _PIECES)
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        rows, seq, conv, part, before = [], 0, None, None, None
        opened = True  # the conversation may have begun in the partition before, or in the piece before

        def close(whole: bool) -> None:
            nonlocal rows, seq, before
            if not rows:
                return
            initials = [r[0] for r in rows]
            illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False)) + sum(r[2] - 1 for r in rows)
            illegal += before is not None and before + initials[0] not in ("su", "ua", "au")
            turns = bytes("-sua".index(r[0]) << 2 | _FAULTS[r[1]] for r in rows)
            costs = None if whole else table_of(_decoded(turns)).ravel().tolist()
            made.append({"conv": conv, "whole": whole, "part": part, "seq": seq, "first": initials[0] if before is None else None, "last": initials[-1], "illegal": illegal, "turns": turns, "ns": [r[2] for r in rows], "k1": [r[3] for r in rows], "k2": [r[4] for r in rows], "costs": costs})
            before, seq, rows = initials[-1], seq + 1, []

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("conv", "part", "initial", "fault", "n", "k1", "k2")]
            for c, p, *row in zip(*columns, strict=True):
                if part is None:
                    part, conv = p, c
                elif c != conv:
                    close(not opened)
                    conv, before, opened = c, None, False
                rows.append(row)
                if len(rows) == piece:
                    close(False)
                    opened = True
            if sum(len(m["ns"]) for m in made) >= 1 << 16:
                yield pa.RecordBatch.from_pylist(made, schema=arrow)
                made = []
        close(False)  # it may go on in the next partition
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return ordered.mapInArrow(cut, schema)


def _chained(pieces: DataFrame, backward: bool, out: str) -> DataFrame:
    """Streams pieces conversation by conversation, in order or against it, a row at a time.

    Backward, part, seq and after: the cost to go behind each piece, less its least. Forward, over pieces with `exits` (the state
    behind each for each state before): part, seq, state (before the piece), extra (illegal neighbours across pieces), end (whether it is the conversation's last).
    """
    keys = [F.col("conv"), F.desc("part") if backward else F.col("part"), F.desc("seq") if backward else F.col("seq")]
    arrow = to_arrow_schema(T.StructType.fromDDL(out))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, carry, last = False, None, None, None
        for b in batches:
            found = []
            for r in b.to_pylist():
                fresh = not begun or r["conv"] != conv
                begun, conv = True, r["conv"]
                if backward:
                    after = END if fresh else carry
                    found.append((r["part"], r["seq"], list(after)))
                    table = np.array(r["costs"]).reshape(4, 4)
                    costs = closed((table + np.array(after)).min(axis=1).tolist())
                    carry = tuple(c - min(costs) for c in costs)
                else:
                    state, end = (0, None) if fresh else (carry, last)
                    extra = int(end is not None and r["first"] is not None and end + r["first"] not in ("su", "ua", "au"))
                    found.append((r["part"], r["seq"], state, extra))
                    carry, last = r["exits"][state], r["last"]
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, x, strict=True)) for x in found], schema=arrow)

    return pieces.repartition("conv").sortWithinPartitions(*keys).mapInArrow(go, out)


def _walked(pieces: DataFrame) -> DataFrame:
    """pieces (with `after`, and `starts`: the states to walk from) with exits (a state for each start, else 0) and walks (a string of
    edits for each start: a turn's edits end with K, R or D)."""
    schema = _with_ddl(pieces.schema, "exits array<int>, walks array<string>")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            exits, walks = [], []
            for data, after, starts in zip(*(b.column(c).to_pylist() for c in ("turns", "after", "starts")), strict=True):
                turns, ends, said = _decoded(data), [0] * 4, [""] * 4
                for s in starts:
                    edits, ends[s] = walk(turns, tuple(after), s)
                    said[s] = "".join(edits)
                exits.append(ends)
                walks.append(said)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(exits, pa.list_(pa.int32())), pa.array(walks, pa.list_(pa.string()))], names=[*b.schema.names, "exits", "walks"])

    return pieces.mapInArrow(go, schema)


_EDITED = "audit string, cost long, extra long, before array<string>, own array<string>, i array<long>, x1 array<long>, x2 array<long>"


def _edited(pieces: DataFrame) -> DataFrame:
    """Per piece its audit and cost, and the turns that come out of it: before (initials of the turns inserted), own (the new role, '' for its own, null for none), x1, x2 (its row's key)."""
    schema = _with_ddl(pieces.select("conv", "part", "seq", "illegal").schema, _EDITED)
    arrow = to_arrow_schema(schema)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                state, at, audit, cost = r["state"], 0, [], 0
                edits, made = r["walks"][state], []
                for i, (x, n, k1, k2) in enumerate(zip(r["turns"], r["ns"], r["k1"], r["k2"], strict=True)):
                    if x & 3 == 1:
                        audit.append("D" * n)
                        cost += DELETE * n
                        continue
                    own = edits[at : next(j for j in range(at, len(edits)) if edits[j] != "I") + 1]
                    at += len(own)
                    before = ""
                    for _ in own[:-1]:
                        before, state = before + WANTED[state], FORCED[state]
                    cost += INSERT * len(before) + {"K": KEEP, "R": REROLE, "D": DELETE}[own[-1]] + TRUNCATED * (own[-1] != "D" and x & 3 == 2) + DELETE * (n - 1)
                    audit.append(own + "D" * (n - 1))
                    role = {"K": "", "R": ROLES[WANTED[state]], "D": None}[own[-1]]
                    state = AFTER[state, "-sua"[x >> 2]] if own[-1] == "K" else FORCED[state] if own[-1] == "R" else state
                    if before or role is not None:
                        made.append((before, role, i, k1, k2))
                if r["end"]:
                    rest, before = ending(state), ""
                    for _ in rest:
                        before, state = before + WANTED[state], FORCED[state]
                    audit.append(rest)
                    cost += INSERT * len(rest)
                    if before:
                        made.append((before, None, len(r["ns"]), None, None))
                before, own, i, k1, k2 = (list(c) for c in zip(*made, strict=True)) if made else ([], [], [], [], [])
                out.append({"conv": r["conv"], "part": r["part"], "seq": r["seq"], "illegal": r["illegal"], "audit": "".join(audit), "cost": cost, "extra": r["extra"], "before": before, "own": own, "i": i, "x1": k1, "x2": k2})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return pieces.mapInArrow(go, schema)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece: int = PIECE) -> Repaired:
    """Faults of each conversation and its repair at the least cost.

    Rows are ordered by turn, nulls first; rows of one turn by the hash of role, then of role and text, so that equal rows stand together. A null role or text
    is one space. A row's first fault counts: blank (nothing but blanks), duplicate (role and text stand earlier in the conversation), truncated
    (the last character that is no blank isn't one of .!?). Keeping a turn costs 0, giving it the role that the grammar asks for 3, deleting it 4,
    inserting an empty turn 3; blank and duplicate turns are deleted, truncated ones that stay cost 3 more. Roles count by their first character; one that
    isn't s, u or a can't be kept. illegal counts neighbours whose initials aren't su, ua or au. gaps: turns missing between the least and the largest (0 where all are
    null). A null conversation is one of its own; conversations without rows aren't in the report; columns beside the four take no part; an empty table gives no rows. Texts
    are hashed where they lie and shuffled once, to meet their edits; memory is bounded by `piece` rows, without their texts, but for the audit, a
    character a row, which is one value for each conversation.
    """
    ship(rows.sparkSession)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"))
    narrow = written(_narrow(rows), "turns")
    first = narrow.groupBy("conv", "d1", "d2").agg(F.min(F.struct("turn", "k1", "k2")).alias("x")).select("x.k1", "x.k2", F.lit(True).alias("is_first"))
    fault = F.when((F.col("fault") != 1) & F.col("is_first").isNull(), 2).otherwise(F.col("fault"))
    narrow_judged = written(narrow.join(first, ["k1", "k2"], "left").withColumn("fault", fault).drop("is_first"), "judged")
    count = lambda kind: F.sum(F.when(F.col("fault") == kind, F.col("n")).otherwise(0))
    again = F.sum(F.when(F.col("fault") != 1, F.col("n") - 1).otherwise(0))  # equal rows of a sound one are duplicates
    of_two = F.sum(F.when(F.col("fault") == 2, 1).otherwise(0))
    truncated = F.sum(F.when(F.col("fault") == 3, 1).otherwise(0))
    faults = narrow_judged.groupBy("conv").agg(count(1).alias("blank"), (of_two + again).alias("duplicate"), truncated.alias("truncated"))
    distinct = narrow_judged.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one"))
    span = distinct.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))

    ordered = narrow_judged.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).withColumn("part", F.spark_partition_id())
    pieces = written(_pieces(ordered.select("conv", "part", "initial", "fault", "n", "k1", "k2"), piece), "pieces")
    forget(narrow)
    end = F.array(*[F.lit(c) for c in END]).cast("array<long>")
    alone = pieces.where("whole").drop("costs").withColumn("after", end).withColumn("starts", F.array(F.lit(0)))
    alone = _walked(alone).withColumns({"state": F.lit(0), "extra": F.lit(0).cast("long"), "end": F.lit(True)})
    parted = pieces.where("not whole")
    to_go = _chained(parted.select("conv", "part", "seq", "costs"), True, "part int, seq long, after array<long>")
    walked = written(_walked(parted.drop("costs").join(to_go, ["part", "seq"]).withColumn("starts", F.array(*[F.lit(s) for s in range(4)]))), "walked")
    entered = _chained(walked.select("conv", "part", "seq", "first", "last", "exits"), False, "part int, seq long, state int, extra long")
    behind = walked.groupBy("conv").agg(F.max(F.struct("part", "seq")).alias("x")).select("x.part", "x.seq", F.lit(True).alias("end"))
    walked_on = walked.join(entered, ["part", "seq"]).join(behind, ["part", "seq"], "left").withColumn("end", F.coalesce("end", F.lit(False)))
    edited = written(_edited(alone.unionByName(walked_on)), "edited")
    forget(pieces, walked)

    parts = F.array_sort(F.collect_list(F.struct("part", "seq", "audit")))
    sums = edited.groupBy("conv").agg(F.sum(F.col("illegal") + F.col("extra")).alias("illegal"), F.sum("cost").alias("cost"), F.concat_ws("", F.transform(parts, lambda x: x["audit"])).alias("audit"))
    report = faults.join(sums.withColumnRenamed("conv", "sc"), F.col("conv").eqNullSafe(F.col("sc")))
    report = report.join(span.withColumnRenamed("conv", "gc"), F.col("conv").eqNullSafe(F.col("gc")), "left")
    report = report.select("conv", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    spots = edited.select("conv", "part", "seq", F.explode(F.arrays_zip("i", "before", "own", "x1", "x2")).alias("x")).select("conv", "part", "seq", "x.*")
    k1, k2 = F.xxhash64(*_row_key()), F.xxhash64(F.lit(7), *_row_key())
    kept = spots.where("own is not null")
    texts = rows.select(k1.alias("x1"), k2.alias("x2"), F.col("role").alias("said"), "text").groupBy("x1", "x2").agg(F.first("said").alias("said"), F.first("text").alias("text"))
    stay = kept.join(texts, ["x1", "x2"]).select("conv", "part", "seq", "i", F.lit(1 << 30).alias("j"), F.when(F.col("own") == "", F.col("said")).otherwise(F.col("own")).alias("role"), "text")
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    new = spots.where("before <> ''").select("conv", "part", "seq", "i", F.posexplode(F.split("before", "")).alias("j", "x")).where("x <> ''").select("conv", "part", "seq", "i", "j", names[F.col("x")].alias("role"), F.lit("").alias("text"))
    return Repaired(report, new.unionByName(stay))


def digests(turns: DataFrame) -> DataFrame:
    """conv, repaired_sha256: hash of each conversation's `role:text`, newline-joined. A conversation streams through one task, a turn at a time."""
    schema = turns.select("conv").schema.add("repaired_sha256", "string")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for b in batches:
            done: list[tuple] = []
            for c, line in zip(b.column("conv").to_pylist(), b.column("line").to_pylist(), strict=True):
                if state is not None and c == conv:
                    state.update(b"\n")
                else:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                state.update(line.encode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], b.schema.field("conv").type), pa.array([s for _, s in done], pa.string())], names=["conv", "repaired_sha256"])
            kind = b.schema.field("conv").type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([state.hexdigest()])], names=["conv", "repaired_sha256"])

    lines = turns.select("conv", "part", "seq", "i", "j", F.concat_ws(":", "role", "text").alias("line"))
    return lines.repartition("conv").sortWithinPartitions("conv", "part", "seq", "i", "j").select("conv", "line").mapInArrow(go, schema)


def summary(originals: DataFrame, repaired: Repaired, conv_col: str = "conv_id") -> DataFrame:
    """conv_id, the report's columns and repaired_sha256 for every conversation of originals; zeros and an empty audit for those without a row in the report."""
    every = originals.select(F.col(conv_col).alias("conv_id")).distinct()
    report, digest = repaired.report.withColumnRenamed("conv", "rc"), digests(repaired.turns).withColumnRenamed("conv", "dc")
    out = every.join(report, F.col("conv_id").eqNullSafe(F.col("rc")), "left").join(digest, F.col("conv_id").eqNullSafe(F.col("dc")), "left")
    longs = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
