"""Structure repair: against all edit scripts of short conversations, in segments of any length, and against the SQL."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from duneveil.llm import oracle, queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def in_order(rows):
    """Rows (turn, role, text) in the order of a conversation, nulls as blanks."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()))


def facts(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return faults, gaps, illegal


def every_script(rows, faults):
    """The least (cost, audit) of all edit scripts, and its lines: nothing is pruned."""
    best = None
    for inserts in itertools.product((0, 1, 2), repeat=len(rows) + 1):
        choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "R"] for f in faults]
        for edits in itertools.product(*choices):
            audit = "".join("I" * n + e for n, e in zip(inserts, edits, strict=False)) + "I" * inserts[-1]
            lines, initials, cost, k = [], "", 3 * sum(inserts), 0
            for edit in audit:
                due = "a" if initials.endswith("u") else "u"
                if edit == "I":
                    lines.append({"u": "user", "a": "assistant"}[due] + ":")
                    initials += due
                    continue
                (_, role, text), fault = rows[k], faults[k]
                k += 1
                if edit == "D":
                    cost += 4
                    continue
                cost += 3 * (fault == "truncated") + 3 * (edit == "R")
                initial, name = (role[:1], role) if edit == "K" else (due, {"u": "user", "a": "assistant"}[due])
                initials += initial or " "
                lines.append(f"{name}:{text}")
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def conversation(rng, n):
    texts = ["Yes.", "No!", "cut short", "", "  \n", "Why? ", "end", None]
    return [(rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None]), rng.choice(texts)) for _ in range(n)]


def results(spark, turns, segment=repair.SEGMENT):
    solved = repair.audits(turns, segment=segment)
    solved = spark.createDataFrame(solved.collect(), solved.schema)
    digests = {r["conv_id"]: r["sha256"] for r in repair.digests(turns, solved).collect()}
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], digests[r["conv_id"]]) for r in solved.collect()}, solved


@pytest.fixture(scope="module")
def shorts():
    rng = random.Random(5)
    return {k if k else None: conversation(rng, 1 + k % 4) for k in range(120)}


@pytest.mark.parametrize("segment", [repair.SEGMENT, 1, 2])
def test_cheapest_scripts_of_all(spark, shorts, segment):
    turns = spark.createDataFrame([(c, *row) for c, rows in shorts.items() for row in rows], SCHEMA)
    got, _ = results(spark, turns.repartition(3), segment)
    for c, rows in shorts.items():
        rows = in_order(rows)
        faults, gaps, illegal = facts(rows)
        cost, audit, lines = every_script(rows, faults)
        assert got[c] == (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), rows


def test_one_conversation_over_many_ranges_and_segments(spark):
    rng = random.Random(6)
    rows = [(7, k, rng.choice(["user", "assistant", "system"]), rng.choice(["Fine.", f"{k} ends", f"{k} ends!", " "])) for k in range(1500)] + [(k, 0, "user", "Yes.") for k in range(100, 140)]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(5)
    whole, solved = results(spark, turns.coalesce(1))
    parts, _ = results(spark, turns, 64)
    assert whole == parts and whole[100][5:7] == (3, "KI")
    kept = repair.repaired(turns, solved).filter("conv_id = 7").orderBy("place").collect()
    assert [r["place"] for r in kept] == list(range(len(kept))) and re.fullmatch("s?(ua)+", "".join(r["role"][0] for r in kept))
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in kept).encode()).hexdigest() == whole[7][7]
    assert "".join(r["edit"] for r in kept) == whole[7][6].replace("D", "")


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '/root/testdata/{folder}/conversations.parquet'")
    got = queries.op13_structure_repair(spark, f"/root/testdata/{folder}")
    names = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({oracle.SQL['op13_structure_repair']})").fetchall()
    assert sorted(tuple(r[x] for x in names) for r in got.collect()) == sorted(want)


def test_damage_goes_by_checksums(spark):
    rows = [(c, t, r, "A. b? c!") for c in (1, None) for t in (*range(30), None) for r in ("assistant",)]
    got = repair.damaged(spark.createDataFrame(rows, SCHEMA).withColumn("lot", F.lit(1))).collect()
    want = []
    for c, t, r, x in rows:
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want += [(c, t, "user" if lot == 4 else r, "" if lot == 1 else "A b c" if lot == 2 else x)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_no_turns_and_long_turns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.audits(empty).collect() == []
    turns = spark.createDataFrame([(1, 1, "user", "x" * 300_000 + "."), (1, 2, "assistant", "y " * 200_000 + "!")], SCHEMA).withColumns({"conv": F.lit(9), "key": F.lit(9), "kind": F.lit(9)})
    got, _ = results(spark, turns)
    assert got[1][5:7] == (0, "KK")
