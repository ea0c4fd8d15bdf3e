"""analyze -> run_masked -> write_outputs: the masked twin of a dataset from end to end."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import GAZETTEER, Gazetteer
from ..operators import policy as policies
from ..operators import review, scans, twin
from ..operators.detection import detect_columns, free_text_columns, text_spans
from ..operators.profiling import profile
from ..operators.pseudonyms import canonical_of
from ..operators.report import Check, assemble, span_counts, write_report
from ..operators.tables import ROW, Detection, ForeignKey, Profile, columns_of, written
from ..sources import sinks


@dataclass
class Analysis:
    tables: dict[str, DataFrame]
    profile: Profile
    detections: list[Detection]
    spans: DataFrame | None
    seconds: dict[str, float] = field(default_factory=dict)


@dataclass
class RunResult:
    twin: dict[str, DataFrame]
    report: dict
    marks: DataFrame | None = None
    settled: DataFrame | None = None
    #: What the detector sees in the twin (scans.detected).
    seen: DataFrame | None = None


@contextmanager
def timed(seconds: dict[str, float], name: str):
    began = time.monotonic()
    yield
    seconds[name] = seconds.get(name, 0.0) + time.monotonic() - began


def analyze(tables: dict[str, DataFrame], declared_fks: list[ForeignKey] | None = None, declared_pks: dict[str, list[str]] | None = None, names: Gazetteer = GAZETTEER) -> Analysis:
    """Profile, identifier columns and spans in free text."""
    seconds: dict[str, float] = {}
    with timed(seconds, "profile"):
        found = profile(tables, declared_fks, declared_pks)
    with timed(seconds, "detect_columns"):
        detections = detect_columns(tables, found)
    with timed(seconds, "detect_text"):
        spans = text_spans(tables, free_text_columns(detections))
        spans = None if spans is None else written(spans, "spans")
    return Analysis(tables, found, detections, spans, seconds)


def _spans_for(a: Analysis, detections: list[Detection]) -> DataFrame | None:
    """Known spans, and those of columns that a person has just called free text; columns that a person says hold
    none keep theirs, for the leak scan."""
    fresh = [c for c in free_text_columns(detections) if c not in free_text_columns(a.detections)]
    more = text_spans(a.tables, fresh) if fresh else None
    parts = [x for x in (a.spans, more) if x is not None]
    return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def run_masked(a: Analysis, policy: policies.Policy, key: bytes, overrides: dict[str, dict] | None = None, decisions: dict | None = None, names: Gazetteer = GAZETTEER) -> RunResult:
    """The masked twin with its checks.  overrides: "table.column" -> tag, kind, action; decisions: see review."""
    seconds, tables = dict(a.seconds), a.tables
    detections = policies.apply_overrides(a.detections, overrides or {})
    plan = policies.resolve(policy, a.profile, a.detections, overrides)
    least = policy.thresholds["min_span_confidence"]
    with timed(seconds, "review"):
        spans, settled, chosen, waiting = _spans_for(a, detections), None, None, None
        if spans is not None:
            settled = written(review.resolve(tables, spans, detections, decisions, least), "settled")
            chosen, waiting = review.partition_spans(spans, settled, least)
            chosen = written(chosen, "chosen")
    with timed(seconds, "twin"):
        made = twin.build(tables, plan, chosen, key, names)
    with timed(seconds, "scans"):
        # what a reviewer keeps, or has not decided, is no original that must not appear
        sure = None if spans is None else (chosen if chosen is not None else spans)
        originals = written(scans.original_values(tables, a.detections, sure), "originals")
        name_columns = [(d.table, d.column) for d in a.detections if d.kind == "PERSON_NAME"]
        seen = written(scans.detected(scans.all_cells(made.tables)), "seen")  # for both scans
        leak = scans.leak_scan(originals, made.tables, "masked", tables, name_columns, seen)
        left = None
        if settled is not None:
            left = settled.filter("final <> 'replace'").select("table", "column", ROW, canonical_of(F.col("kind"), F.col("piece")).alias("canon"))
        cleared = frozenset(k for k, o in (overrides or {}).items() if o.get("tag") not in (None, "DIRECT_ID", "FREE_TEXT"))
        residual = scans.residual_scan(made.tables, twin.generated(made.mapping), left, cleared, seen)
        copies = {t: scans.exact_copies(tables[t], made.tables[t]).count() for t in tables}
    checks = [
        Check("leak_scan", leak["verdict"], True, leak), Check("residual_identifiers", residual["verdict"], True, residual),
        Check("exact_copies", "FAIL" if any(copies.values()) else "PASS", True, {"count": sum(copies.values()), "by_table": copies}),
    ]
    totals = None if settled is None else review.totals(settled).first().asDict()
    report = assemble("masked", a.profile, detections, plan, policy, checks, span_counts(chosen), seconds, review=totals, actions=made.counts)
    return RunResult(made.tables, report, twin.marks(plan, made.changed, waiting), settled, seen)


def write_outputs(result: RunResult, folder: str) -> list[str]:
    """The report always; the tables only if nothing leaked."""
    written_files = [write_report(result.report, folder)]
    if not result.report["withheld"]:
        written_files += sinks.write_csv_folder(result.twin, folder)
    return written_files


def read_back(result: RunResult, originals: DataFrame, read_again: dict[str, DataFrame]) -> dict:
    """The scan of a twin as it was stored: rows must be as many and no original in it, or the verdict is FAIL."""
    leak = scans.leak_scan(originals, read_again, "synthetic")
    rows = {t: (result.twin[t].count(), read_again[t].count()) for t in result.twin}
    ok = not leak["hard_fail"] and all(x == y for x, y in rows.values())
    return {"verdict": "PASS" if ok else "FAIL", "rows": rows, "leak_scan": leak, "columns": {t: columns_of(df) for t, df in read_again.items()}}
