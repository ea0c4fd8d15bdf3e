"""Conversation structure repair by a dynamic program over the turns that are retained.

A repaired conversation's role initials are (s?(ua)+)?, or it is empty.  A turn is kept, reroled to user or assistant, or
deleted, and turns without text may be inserted.  The program runs from the last turn to the first, so that an audit can be
read off from the front: for each state (the initial of the last retained turn) it holds the running minimum of what the rest
costs, less the sum of deleting all of it.  Deletion sums so price any gap between retained turns, and the pair of states
tells which turns must be inserted.  Among the cheapest audits the ASCII-least is read off choice by choice.

No conversation is gathered: turns are sorted by ranges, and a range packs a conversation's turns into segments of a byte a
turn.  A conversation inside one segment is solved at once.  For longer ones segments become (min, +) matrices over the
states, a scan over these gives the costs at the segments' borders and the states in which they are entered, and each segment
reads off its part of the audit.  Only the digest of a repaired conversation is sequential by its nature; it streams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved

#: Turns in a segment at most.
SEGMENT = 8192
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {"u": "user", "a": "assistant"}
#: Turns to insert between the last retained initial and the next, or the end.
BETWEEN = {(START, SYSTEM): "", (START, USER): "", (SYSTEM, USER): "", (ASSISTANT, USER): "", (USER, USER): "a", (USER, ASSISTANT): "", (START, ASSISTANT): "u", (SYSTEM, ASSISTANT): "u", (ASSISTANT, ASSISTANT): "u"}
CLOSING = ("", "ua", "a", "")
FINAL = tuple(float(INSERT * len(x)) for x in CLOSING)
#: A turn's code: its state if its role is kept (0: it can't be), and these bits.
MUST_GO, CUT_SHORT = 4, 8
INFINITE = float("inf")


@lru_cache(maxsize=1 << 16)
def step(code: int, after: tuple[float, ...]) -> tuple[tuple[float, ...], tuple[tuple[str, int], ...]]:
    """(costs before a turn, (edits, next state) for each state); costs are of all that follows, less its deletion sum."""
    before, choices = [], []
    for state in range(4):
        options = [(after[state], "D", state)]
        for target in (SYSTEM, USER, ASSISTANT) if not code & MUST_GO else ():
            keep = target == code & 3
            if (state, target) in BETWEEN and (keep or target != SYSTEM):
                edits = "I" * len(BETWEEN[state, target]) + ("K" if keep else "R")
                cost = INSERT * (len(edits) - 1) + (KEEP if keep else REROLE) + (TRUNCATED if code & CUT_SHORT else 0)
                options.append((cost - DELETE + after[target], edits, target))
        cost, edits, target = min(options)
        before.append(cost)
        choices.append((edits, target))
    return tuple(before), tuple(choices)


def solve(codes: bytes, final: tuple[float, ...]) -> tuple[tuple[float, ...], list[tuple]]:
    """(costs before a segment less its deletion sum, the choices of each of its turns)."""
    base, at, found = 0.0, final, []
    for code in reversed(codes):
        low = min(at)
        base += low
        at, choices = step(code, tuple(x - low for x in at))  # differences of states are few, so that steps are remembered
        found.append(choices)
    return tuple(x + base for x in at), found[::-1]


def audit_of(codes: bytes, choices: list[tuple], state: int) -> tuple[str, int, int]:
    """(edits, last state, cost) from an entry state."""
    out, cost = [], 0
    for code, options in zip(codes, choices, strict=True):
        edits, state = options[state]
        out.append(edits)
        if code & CUT_SHORT and edits != "D":
            cost += TRUNCATED
    audit = "".join(out)
    return audit, state, cost + DELETE * audit.count("D") + REROLE * audit.count("R") + INSERT * audit.count("I")


def matrix_of(codes: bytes) -> list[float]:
    """16 costs, by entry and exit state, less the deletion sum."""
    columns = [solve(codes, tuple(0.0 if q == x else INFINITE for q in range(4)))[0] for x in range(4)]
    return [columns[q][p] for p in range(4) for q in range(4)]


# ------------------------------------------------------------------ turns


def ordered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, key, role, text): a conversation's order is turn, nulls first, then key."""
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text")
    )
    return rows.select("conv", "turn", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("key"), "role", "text")


def ends_open(text: Column) -> Column:
    """The last character that is no blank is none of .!?"""
    return ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def _segmenter(most: int):
    def segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of sorted (conv, turn, key, role code, blank, cut, first turn of its text): see _SEGMENT."""
        part = TaskContext.get().partitionId()
        out, seq = [], 0
        state: dict = {}

        def closed(ended: bool):
            nonlocal seq
            codes, whole = bytes(state["codes"]), ended and state["opened"] and not state["first"]
            audit = cost = None
            if whole:
                audit, last, cost = audit_of(codes, solve(codes, FINAL)[1], START)
                audit, cost = audit + "I" * len(CLOSING[last]), cost + INSERT * len(CLOSING[last])
            out.append((state["conv"], part, seq, whole, codes, audit, cost, state["low"], state["high"], state["known"], state["blank"], state["duplicate"], state["truncated"], state["illegal"], state["head"], state["tail"]))
            seq += 1

        def begin(conv, first: bool, opened: bool):
            state.clear()
            state.update(conv=conv, first=first, opened=opened, codes=bytearray(), low=None, high=None, known=0, blank=0, duplicate=0, truncated=0, illegal=0, head=None, tail=None)

        started, before = False, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for conv, turn, key, role, blank, cut, since_null, since in zip(*columns, strict=True):
                if not started or conv != state["conv"]:
                    if started:
                        closed(True)
                    begin(conv, not started, True)  # a range's first conversation may have begun in the range before
                    started, before = True, None
                elif len(state["codes"]) == most:
                    closed(False)
                    begin(conv, state["first"], False)
                same = before == (turn, key)
                before = (turn, key)
                # a text was seen before if its first turn comes earlier (nulls come first)
                again = same or (since_null is not None and turn is not None and (since_null or since < turn))
                code = role
                if blank:
                    state["blank"] += 1
                    code |= MUST_GO
                elif again:
                    state["duplicate"] += 1
                    code |= MUST_GO
                elif cut:
                    state["truncated"] += 1
                    code |= CUT_SHORT
                if state["codes"]:
                    state["illegal"] += (state["tail"], role) not in LEGAL
                else:
                    state["head"] = role
                state["tail"] = role
                state["codes"].append(code)
                if turn is not None:
                    state["known"] += turn != state["high"]
                    state["low"] = turn if state["low"] is None else state["low"]
                    state["high"] = turn
                if len(out) >= 5000:
                    yield _packed(out)
                    out = []
        if started:
            closed(False)  # it may go on in the next range
        if out:
            yield _packed(out)

    return segmented


LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
_SEGMENT = "part long, seq long, whole boolean, codes binary, audit string, cost long, low long, high long, known long, blank long, duplicate long, truncated long, illegal long, head int, tail int"
_kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "int": pa.int32()}
_FIELDS = [(n, _kinds[k]) for n, k in (x.split() for x in _SEGMENT.split(", "))]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0]), *(pa.array(c, k) for c, (_, k) in zip(columns[1:], _FIELDS, strict=True))], names=["conv", *(n for n, _ in _FIELDS)])


def segments(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """The segments of ordered turns, solved where a conversation lies in one."""
    kind = rows.schema["conv"].dataType.simpleString()
    twice = rows.groupBy(F.col("conv").alias("c"), F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("turn").isNull()).alias("nulls"), F.min("turn").alias("since"))
    twice = twice.filter("n > 1").select("c", "k", (F.col("nulls") > 0).alias("since_null"), "since")
    initial = F.substring("role", 1, 1)
    coded = rows.select(
        "conv", "turn", "key", F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0).alias("code"),
        (~F.col("text").rlike(WORD)).alias("blank"), ends_open(F.col("text")).alias("cut"),
    )
    coded = coded.join(twice, F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left").drop("c", "k")
    order = ["conv", "turn", "key"]
    return coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_segmenter(most), f"conv {kind}, {_SEGMENT}")


# ------------------------------------------------------------------ conversations of several segments


def _matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"part": b["part"], "seq": b["seq"], "matrix": [matrix_of(x) for x in b["codes"]]})


def _borders(group: pd.DataFrame) -> pd.DataFrame:
    """The costs behind each segment of a conversation, from its last to its first."""
    group = group.sort_values(["part", "seq"])
    at, out = np.array(FINAL), []
    for flat in reversed(group["matrix"].to_list()):
        out.append(at.tolist())
        at = (np.array(flat).reshape(4, 4) + at).min(1)
        at -= at.min()
    return pd.DataFrame({"part": group["part"], "seq": group["seq"], "behind": out[::-1]})


def _readings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        read = []
        for codes, behind in zip(b["codes"], b["behind"], strict=True):
            choices = solve(codes, tuple(behind))[1]
            read.append(list(zip(*(audit_of(codes, choices, state) for state in range(4)), strict=True)))
        yield pd.DataFrame({"part": b["part"], "seq": b["seq"]} | {name: [list(r[k]) for r in read] for k, name in enumerate(("audits", "exits", "costs"))})


def _entries(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["part", "seq"])
    state, entered = START, []
    for exits in group["exits"]:
        entered.append(state)
        state = int(exits[state])
    tails = [""] * (len(group) - 1) + ["I" * len(CLOSING[state])]
    return pd.DataFrame({"part": group["part"], "seq": group["seq"], "entered": entered, "tail_edits": tails})


def _long_audits(open_segments: DataFrame) -> DataFrame:
    """(p, s, read, read_cost): each segment's part of its conversation's audit, found by a scan over matrices."""
    place = "part long, seq long"
    # what a scan gathers is a row for each SEGMENT turns of a conversation
    grouped = lambda df: df.groupBy("conv", F.col("conv").isNull().alias("none"))
    joined = lambda a, b: a.join(b.withColumnsRenamed({"part": "p", "seq": "s"}), (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).drop("p", "s")
    names = open_segments.select("conv", "part", "seq")
    matrices = saved(open_segments.select("part", "seq", "codes").mapInPandas(_matrices, f"{place}, matrix array<double>"), "matrices")
    behind = saved(grouped(joined(names, matrices)).applyInPandas(_borders, f"{place}, behind array<double>"), "borders")
    read = saved(joined(open_segments.select("part", "seq", "codes"), behind).mapInPandas(_readings, f"{place}, audits array<string>, exits array<int>, costs array<long>"), "readings")
    entered = grouped(joined(names, read.drop("audits", "costs"))).applyInPandas(_entries, f"{place}, entered int, tail_edits string")
    found = joined(read, saved(entered, "entries"))
    at = F.col("entered") + 1
    cost = F.element_at("costs", at) + INSERT * F.length("tail_edits")
    return found.select(F.col("part").alias("p"), F.col("seq").alias("s"), F.concat(F.element_at("audits", at), "tail_edits").alias("read"), cost.alias("read_cost"))


def audits(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(conv, n_turns, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has turns.

    A turn's first fault counts: blank (nothing but blanks), duplicate (role and text stood in an earlier turn), truncated (the
    last character that is no blank is none of .!?).  gaps: turn numbers that are missing between the first and the last; illegal:
    neighbours whose role initials are none of su, ua, au.  Edits: keep 0, rerole to user or assistant 3, delete 4 (blank and
    duplicate turns must go), insert a user or assistant turn without text 3; a truncated turn that stays costs 3 more.  audit:
    the initials of the cheapest edits in order, the ASCII-least of equals.
    Turns come by number, nulls first, and those of one number by a hash of role and text.  A null role or text is one blank, a
    null conversation is one.  Repeated rows are turns of their own (and duplicates).  Long texts count whole; an empty table gives
    no rows; other columns are ignored, whatever their names.  segment: how many turns a task solves at once.
    """
    found = saved(segments(ordered(turns, conv_col, turn_col, role_col, text_col), segment), "segments")
    read = _long_audits(found.filter("NOT whole"))
    found = found.join(read, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")), "left").withColumns({"audit": F.coalesce("audit", "read"), "cost": F.coalesce("cost", "read_cost")})
    along = Window.partitionBy("conv").orderBy("part", "seq")  # over segments, not turns
    known = F.col("known") - F.when(F.lag("high").over(along) == F.col("low"), 1).otherwise(0)
    crossing = F.lag("tail").over(along).isNotNull() & ~F.concat(F.lag("tail").over(along).cast("string"), F.col("head").cast("string")).isin(*(f"{a}{b}" for a, b in LEGAL))
    found = found.withColumns({"known": known, "illegal": F.col("illegal") + crossing.cast("long"), "n": F.octet_length("codes").cast("long")})
    total = found.groupBy("conv").agg(
        F.sum("n").alias("n_turns"), F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("known"), F.lit(0)).cast("long").alias("gaps"),
        *(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    return total.select(F.col("conv").alias(conv_col), "n_turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


# ------------------------------------------------------------------ repaired conversations


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, place, edit, role, text) of repaired turns, and (conv, None, ...) at the end of each conversation, from sorted
    (conv, kind, role, text): a conversation's audit, of kind 0, and then its turns."""
    conv = audit = None
    at = place = state = 0

    def inserted():
        nonlocal at, place, state
        while at < len(audit) and audit[at] == "I":
            initial = "a" if state == USER else "u"
            yield conv, place, "I", NAMES[initial], ""
            at, place, state = at + 1, place + 1, USER if initial == "u" else ASSISTANT

    for batch in batches:
        for own, kind, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:
                if audit is not None:
                    yield from inserted()
                    yield conv, None, None, None, None
                conv, audit, at, place, state = own, text, 0, 0, START
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]] if edit == "K" else ASSISTANT if state == USER else USER
            yield conv, place, edit, role if edit == "K" else NAMES["u" if state == USER else "a"], text
            place += 1
    if audit is not None:
        yield from inserted()
        yield conv, None, None, None, None


def _writer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flushed():
        columns = list(zip(*held, strict=True))
        kinds = (None, pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv", "place", "edit", "role", "text"])

    for row in _edited(batches):
        if row[1] is not None:
            held.append(row)
            size += len(row[4])
            if len(held) >= 10_000 or size > 16 << 20:
                yield flushed()
                held, size = [], 0
    if held:
        yield flushed()


def _digester(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, sha256): lines go into the digest as they pass, so that none are held."""
    digest, convs, found = hashlib.sha256(), [], []
    for conv, place, _, role, text in _edited(batches):
        if place is None:
            convs.append(conv)
            found.append(digest.hexdigest())
            digest = hashlib.sha256()
            if len(convs) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(convs), pa.array(found)], names=["conv", "sha256"])
                convs, found = [], []
        else:
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
    if convs:
        yield pa.RecordBatch.from_arrays([pa.array(convs), pa.array(found)], names=["conv", "sha256"])


def _streamed(turns: DataFrame, solved: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, kind, role, text), sorted: the texts are shuffled once and stream by conversation; only audits are held."""
    rows = ordered(turns, conv_col, turn_col, role_col, text_col).withColumn("kind", F.lit(1))
    heads = solved.select(F.col(conv_col).alias("conv"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("key"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("kind"))
    return rows.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "key").select("conv", "kind", "role", "text")


def repaired(turns: DataFrame, solved: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, edit, role, text): the turns of repaired conversations by solved, the result of audits(turns)."""
    rows = _streamed(turns, solved, conv_col, turn_col, role_col, text_col)
    kind = rows.schema["conv"].dataType.simpleString()
    return rows.mapInArrow(_writer, f"conv {kind}, place long, edit string, role string, text string").withColumnRenamed("conv", conv_col)


def digests(turns: DataFrame, solved: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, sha256) of each repaired conversation: the digest of its turns as role:text, joined by line feeds."""
    rows = _streamed(turns, solved, conv_col, turn_col, role_col, text_col)
    kind = rows.schema["conv"].dataType.simpleString()
    return rows.mapInArrow(_digester, f"conv {kind}, sha256 string").withColumnRenamed("conv", conv_col)


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults put in by a checksum of conversation and turn: of 20, one drops a turn, one empties its
    text, one takes its .!? away, one repeats it, and one makes its role user.  Nulls count as one blank."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(blank(F.col(conv_col)), F.lit(":"), blank(F.col(turn_col)))) % 20
    rows = turns.select(
        F.col(conv_col), F.col(turn_col), F.when(lot == 4, "user").otherwise(blank(F.col(role_col))).alias(role_col),
        F.when(lot == 1, "").when(lot == 2, F.regexp_replace(blank(F.col(text_col)), "[.!?]", "")).otherwise(blank(F.col(text_col))).alias(text_col), lot.alias("_lot"),
    ).filter("_lot <> 0")
    return rows.withColumn("_lot", F.explode(F.when(F.col("_lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_lot")
