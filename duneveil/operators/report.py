"""Checks, verdict and report of a run: counts and names of columns, never values."""

from __future__ import annotations

import json
import os
import resource
from dataclasses import dataclass, field
from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .policy import Decision, Policy, inactive_rules
from .tables import Detection, Profile

STATUSES = ("PASS", "FAIL", "NOT_RUN", "INFO")
LIMITATIONS = {
    "en": ["Detection can miss an identifier in an unusual spelling.", "A masked twin keeps the values of columns that hold no identifiers."],
    "ar": ["قد يفوت الكشف معرّفًا بصيغة غير معتادة.", "تبقى قيم الأعمدة التي لا تحوي معرّفات كما هي في النسخة المقنّعة."],
}
REQUIRED = {"run_id": str, "mode": str, "verdict": str, "checks": list, "input": dict, "columns": list, "policy": dict, "withheld": bool}


@dataclass(frozen=True)
class Check:
    name: str
    status: str
    blocking: bool
    details: dict = field(default_factory=dict)


def run_id() -> str:
    return f"{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{uuid4().hex[:6]}"


def verdict(checks: list[Check]) -> str:
    """FAIL if any blocking check fails."""
    return "FAIL" if any(c.blocking and c.status == "FAIL" for c in checks) else "PASS"


def span_counts(spans: DataFrame | None) -> dict[str, int]:
    return {} if spans is None else {r["kind"]: r["n"] for r in spans.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}


def assemble(
    mode: str, profile: Profile, detections: list[Detection], decisions: list[Decision], policy: Policy, checks: list[Check], spans: dict[str, int], seconds: dict[str, float], **more
) -> dict:
    """The report: what came in, what was decided, what was checked, and whether the twin may leave."""
    by_column = {(d.table, d.column): d for d in decisions}
    tables = list(profile.primary_keys)
    rows = {t: next((c.n_rows for (table, _), c in profile.columns.items() if table == t), 0) for t in tables}
    leak = next((c.details for c in checks if c.name == "leak_scan"), {})
    out = {
        "run_id": run_id(), "mode": mode, "verdict": verdict(checks), "withheld": bool(leak.get("hard_fail")),
        "checks": [vars(c) for c in checks],
        "input": {"tables": [{"table": t, "rows": rows[t], "primary_key": profile.primary_keys[t]} for t in tables], "foreign_keys": [vars(f) for f in profile.foreign_keys]},
        "columns": [
            {"table": d.table, "column": d.column, "tag": d.tag, "kind": d.kind, "score": round(d.score, 3), "reason": d.reason, "needs_review": d.needs_review}
            | ({"action": x.action, "rule": x.rule, "remap_group": x.remap_group} if (x := by_column.get((d.table, d.column))) else {})
            for d in detections
        ],
        "policy": {"hash": policy.hash, "thresholds": policy.thresholds, "inactive_rules": inactive_rules(policy, decisions)},
        "spans": spans, "seconds": {k: round(v, 2) for k, v in seconds.items()}, "peak_rss_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024, "limitations": LIMITATIONS,
    } | more
    validate(out)
    return out


def validate(report: dict) -> None:
    """Raise ValueError where the report lacks a part or holds a wrong kind of it."""
    for name, kind in REQUIRED.items():
        if not isinstance(report.get(name), kind):
            raise ValueError(f"report: {name} is missing or no {kind.__name__}")
    for c in report["checks"]:
        if c["status"] not in STATUSES or not isinstance(c["blocking"], bool):
            raise ValueError(f"report: check {c.get('name')!r} has a wrong status")
    if report["verdict"] not in ("PASS", "FAIL"):
        raise ValueError("report: wrong verdict")


def write_report(report: dict, folder: str) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "report.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(report, file, ensure_ascii=False, indent=2, default=str)
    return path


def shareable(report: dict, stored: bool = True, pending: int = 0) -> str | None:
    """Why a twin may not be shared: twin_not_shareable or decisions_pending; None if it may."""
    if report["verdict"] != "PASS" or report["withheld"] or not stored:
        return "twin_not_shareable"
    return "decisions_pending" if pending else None


def summary_counts(report: dict) -> dict[str, int]:
    """Counts for a one-page summary."""
    columns = report["columns"]
    action = lambda *names: sum(c.get("action") in names for c in columns)
    return {
        "tables": len(report["input"]["tables"]), "rows": sum(t["rows"] for t in report["input"]["tables"]), "columns": len(columns),
        "identifier_columns": sum(c["tag"] == "DIRECT_ID" for c in columns), "replaced_columns": action("pseudonymize", "remap"), "dropped_columns": action("drop"),
        "text_columns": action("replace_spans"), "spans": sum(report["spans"].values()), "checks_passed": sum(c["status"] == "PASS" for c in report["checks"]),
        "checks_failed": sum(c["status"] == "FAIL" for c in report["checks"]),
    }


def proof_cards(report: dict) -> list[dict]:
    """A card for each blocking check: its name, status and the number that speaks for it."""
    figure = {"leak_scan": "cells_scanned", "residual_identifiers": "found", "exact_copies": "count", "holdout_split": "holdout_rows", "dcr": "median_dcr_twin_to_train", "utility_tstr": "max_auc_drop"}
    return [{"check": c["name"], "status": c["status"], "figure": c["details"].get(figure.get(c["name"], ""))} for c in report["checks"] if c["blocking"]]


def evidence(report: dict) -> list[tuple[str, str]]:
    """(claim, figure) from a report."""
    counts, checks = summary_counts(report), {c["name"]: c["details"] for c in report["checks"]}
    rows = [("identifiers replaced in text", str(counts["spans"])), ("identifier columns replaced", str(counts["replaced_columns"]))]
    if "leak_scan" in checks:
        rows.append(("originals found in the twin", str(sum(checks["leak_scan"]["leaked_by_kind"].values()))))
    if "residual_identifiers" in checks:
        rows.append(("valid identifiers not generated", str(checks["residual_identifiers"]["found"])))
    if "exact_copies" in checks:
        rows.append(("rows equal to an original", str(checks["exact_copies"]["count"])))
    return rows


def summarize_runs(reports: list[dict]) -> str:
    """A Markdown table of runs."""
    lines = ["| run | mode | verdict | rows | seconds | peak MB |", "|---|---|---|---|---|---|"]
    for r in reports:
        lines.append(f"| {r['run_id']} | {r['mode']} | {r['verdict']} | {summary_counts(r)['rows']} | {sum(r['seconds'].values()):.1f} | {r['peak_rss_mb']} |")
    return "\n".join(lines)
