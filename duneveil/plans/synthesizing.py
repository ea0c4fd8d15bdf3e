"""run_synthetic: split, view, fit, sample, fill, and the proofs of a synthetic twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fidelity, scans, synthesis
from ..operators.hierarchy import HierarchicalCopula
from ..operators.policy import Policy, resolve
from ..operators.report import Check, assemble, span_counts
from ..operators.tables import ROW, columns_of, written
from .masking import Analysis, RunResult, timed


def fit(a: Analysis, method: str = "stratified_copula", seed: int = 0, share: float = synthesis.HOLDOUT) -> dict:
    """Split by entity, flatten train and holdout, choose columns, fit on train alone."""
    train, hold, info = synthesis.split_holdout(a.tables, a.profile, share, seed)
    train = {t: written(df, f"train-{k}") for k, (t, df) in enumerate(train.items())}
    hold = {t: written(df, f"hold-{k}") for k, (t, df) in enumerate(hold.items())}
    view = synthesis.build_view(train, a.profile, info["train_rows"])
    kinds, left = synthesis.view_plan(view, a.profile, a.detections)
    unseen = synthesis.build_view(hold, a.profile, info["train_rows"])
    model = synthesis.make_synthesizer(method)
    typed = written(synthesis.typed_view(view.df, kinds), "typed-train")
    model.fit(typed, kinds)
    return {"view": view, "kinds": kinds, "left_out": left, "info": info, "model": model, "train": typed, "holdout": written(synthesis.typed_view(unseen.df, kinds), "typed-holdout")}


def day_kinds(kinds: dict[str, str]) -> dict[str, str]:
    """Day numbers are numbers in a typed view."""
    return {c: "categorical" if k == "categorical" else "numerical" for c, k in kinds.items()}


def run_synthetic(a: Analysis, policy: Policy, key: bytes, method: str = "stratified_copula", target: str | None = None, seed: int = 0, rows: int | None = None) -> RunResult:
    """A synthetic twin of the flat view.  Blocking: holdout_split, leak_scan, exact_copies, dcr, utility_tstr."""
    seconds = dict(a.seconds)
    with timed(seconds, "fit"):
        f = fit(a, method, seed)
    with timed(seconds, "sample"):
        sample = written(f["model"].sample(rows, seed), "sample")
        originals = written(scans.original_values(a.tables, a.detections, a.spans), "originals")
        filled = written(synthesis.fill(f["view"], sample, a.profile, a.detections, originals, key), "synthetic")
    with timed(seconds, "proofs"):
        kinds = day_kinds(f["kinds"])
        made = sample.drop(ROW)
        name = f["view"].base
        likeness = fidelity.fidelity(f["train"], made, kinds)
        used = fidelity.utility(f["train"], made, f["holdout"], kinds, target) if target else {"status": "NOT_RUN", "reason": "no target"}
        distance = fidelity.distance_to_closest(f["train"], made, f["holdout"], kinds, seed)
        copies = scans.exact_copies(f["train"], made, list(kinds)).count()
        twin = {name: filled}
        names = [(name, c) for c, at in f["view"].origin.items() if any((d.table, d.column) == at and d.kind == "PERSON_NAME" for d in a.detections)]
        leak = scans.leak_scan(originals, twin, "synthetic")
        leak["names"] = {"columns": [f"{t}.{c}" for t, c in names]}
    info = f["info"]
    drop = used.get("max_auc_drop")
    checks = [
        Check("holdout_split", "PASS" if info["holdout_rows"][info["unit_table"]] else "FAIL", True, {"holdout_rows": sum(info["holdout_rows"].values())} | info),
        Check("leak_scan", leak["verdict"], True, leak), Check("exact_copies", "FAIL" if copies else "PASS", True, {"count": copies}),
        Check("dcr", "PASS" if distance["passed"] else "FAIL", True, distance),
        Check("utility_tstr", "NOT_RUN" if drop is None else "PASS" if drop <= policy.thresholds["max_utility_drop"] else "FAIL", True, used),
        Check("fidelity", "INFO", False, likeness), Check("quality_score", "INFO", False, fidelity.quality(f["train"], made, kinds)),
    ]
    report = assemble("synthetic", a.profile, a.detections, resolve(policy, a.profile, a.detections), policy, checks, span_counts(a.spans), seconds, excluded=f["left_out"], synthesizer=getattr(f["model"], "details", {}))
    return RunResult(twin, report)


def multi_table_kinds(a: Analysis) -> tuple[dict[str, dict[str, str]], dict[str, dict[str, str]]]:
    """(kinds, what is left out and why) of the columns of each table."""
    kinds, left = {}, {}
    for t, df in a.tables.items():
        kinds[t], left[t] = synthesis.view_plan(synthesis.View(df, {c: (t, c) for c in columns_of(df)}, t), a.profile, a.detections)
    return kinds, left


def run_multi_table(a: Analysis, policy: Policy, key: bytes, seed: int = 0, scale: float = 1.0) -> RunResult:
    """A synthetic twin of all tables with their keys.  Blocking: holdout_split, leak_scan, exact_copies, referential_integrity.

    Identifiers are made up anew for each table, notes come from templates, and columns that can't be modelled are null.
    """
    seconds = dict(a.seconds)
    kinds, left = multi_table_kinds(a)
    with timed(seconds, "fit"):
        train, _, info = synthesis.split_holdout(a.tables, a.profile, synthesis.HOLDOUT, seed)
        train = {t: written(df, f"train-{k}") for k, (t, df) in enumerate(train.items())}
        model = HierarchicalCopula(a.profile.primary_keys, a.profile.foreign_keys)
        model.fit(train, kinds)
    with timed(seconds, "sample"):
        drawn = model.sample(scale / (1 - synthesis.HOLDOUT), seed)
        originals = written(scans.original_values(a.tables, a.detections, a.spans), "originals")
        twin = {}
        for k, (t, df) in enumerate(drawn.items()):
            view = synthesis.View(df, {c: (t, c) for c in columns_of(a.tables[t])}, t)
            twin[t] = written(synthesis.fill(view, df, a.profile, a.detections, originals, key), f"filled-{k}")
    with timed(seconds, "proofs"):
        likeness = {t: fidelity.fidelity(train[t], twin[t], kinds[t]) for t in twin if kinds[t]}
        leak = scans.leak_scan(originals, twin, "synthetic")
        # a row of few columns is found again by chance: copies count where a table has a number
        told = {t: [c for c in kinds[t]] for t in twin if "numerical" in kinds[t].values()}
        copies = {t: scans.exact_copies(train[t], twin[t], c).count() for t, c in told.items()}
        lost = {f"{f.child_table}.{f.child_column}": scans.orphans(twin[f.child_table], f.child_column, twin[f.parent_table], f.parent_column).count() for f in a.profile.foreign_keys if f.parent_table in twin}
    checks = [
        Check("holdout_split", "PASS" if info["holdout_rows"][info["unit_table"]] else "FAIL", True, {"holdout_rows": sum(info["holdout_rows"].values())} | info),
        Check("leak_scan", leak["verdict"], True, leak), Check("exact_copies", "FAIL" if any(copies.values()) else "PASS", True, {"count": sum(copies.values()), "by_table": copies}),
        Check("referential_integrity", "FAIL" if any(lost.values()) else "PASS", True, {"orphans": lost}), Check("fidelity", "INFO", False, likeness),
    ]
    excluded = {f"{t}.{c}": why for t, some in left.items() for c, why in some.items()}
    report = assemble("synthetic", a.profile, a.detections, resolve(policy, a.profile, a.detections), policy, checks, span_counts(a.spans), seconds, excluded=excluded, synthesizer={"method": model.name})
    return RunResult(twin, report)


def dcr_robustness(a: Analysis, seeds: tuple[int, ...] = (0, 1, 2, 3, 4), method: str = "stratified_copula") -> dict:
    """The distance test over several splits (information only)."""
    results = []
    for seed in seeds:
        f = fit(a, method, seed)
        made = written(f["model"].sample(None, seed).drop(ROW), "robust")
        results.append(fidelity.distance_to_closest(f["train"], made, f["holdout"], day_kinds(f["kinds"]), seed))
    return fidelity.robustness(results)


def name_overlap(a: Analysis, twin: DataFrame, columns: list[str]) -> float:
    """Share of the twin's names that the original has."""
    real = [(d.table, d.column) for d in a.detections if d.kind == "PERSON_NAME"]
    old = None
    for t, c in real:
        part = a.tables[t].select(F.col(f"`{c}`").alias("n"))
        old = part if old is None else old.union(part)
    new = twin.select(F.col(f"`{columns[0]}`").alias("n")).distinct()
    n = new.count()
    return round(new.join(old.distinct(), "n", "left_semi").count() / n, 4) if n and old is not None else 0.0
