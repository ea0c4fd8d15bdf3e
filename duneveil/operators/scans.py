"""Proofs that a twin is safe: leaks, residual identifiers, kept names, exact copies; and scores of detection.

All scans run over (table, column, ROW, value) cells.  Only cells that can hold a number or a mail address reach
the span expressions.  Known originals are met by shuffle joins on the values, so they may be as many as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import EMAIL, IBAN, KINDS, MOBILE, PERSON_NAME, SAUDI_ID, is_valid
from ..functions.spans import exploded, windows, with_spans
from ..functions.text import normalize, normalize_name, strip
from .pseudonyms import canonical_of
from .tables import ROW, Detection, cells, columns_of

HARD_KINDS = (SAUDI_ID, MOBILE, IBAN, EMAIL)
MAX_LOCATIONS = 25
#: Shorter cells, and those with fewer digits and no @, can't hold a valid identifier.
MIN_LENGTH, MIN_DIGITS = 6, 9
#: No detector finds a number of fewer digits, wherever they stand.
SOME_IDENTIFIER = rf"@|(?:\p{{Nd}}\P{{Nd}}*+){{{MIN_DIGITS}}}"
#: Longer cells are no single pseudonym.
MAX_WHOLE = 512


def all_cells(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, ROW, value) of all tables, without nulls and empty cells."""
    parts = [cells(df).select(F.lit(name).alias("table"), "column", ROW, "value").filter("value <> ''") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def original_values(tables: dict[str, DataFrame], detections: list[Detection], spans: DataFrame | None) -> DataFrame:
    """Distinct (kind, canon) of valid identifiers in identifier columns and of spans, for the four hard kinds."""
    parts = []
    for d in detections:
        if d.tag == "DIRECT_ID" and d.kind in HARD_KINDS:
            value = F.col(f"`{d.column}`")
            raw = tables[d.table].select(value.alias("raw")).filter(is_valid(d.kind, F.col("raw")))
            parts.append(raw.select(F.lit(d.kind).alias("kind"), canonical_of(F.lit(d.kind), F.col("raw")).alias("canon")))
    if spans is not None:
        hard = spans.filter(F.col("kind").isin(*HARD_KINDS))
        parts.append(hard.select("kind", canonical_of(F.col("kind"), F.col("piece")).alias("canon")))
    if not parts:
        any_table = next(iter(tables.values()))
        return any_table.sparkSession.createDataFrame([], "kind string, canon string")
    return reduce(DataFrame.unionByName, parts).filter("canon IS NOT NULL").distinct()


def detected(some: DataFrame) -> DataFrame:
    """(table, column, ROW, kind, piece, canon, whole, wide): what the detector, without names, finds in cells; whole: a short
    cell's text without blanks around it; wide: could the cell hold a valid identifier?"""
    found = with_spans(some.filter(F.col("value").rlike(SOME_IDENTIFIER)), "value", "spans", names=False)
    found = exploded(found, "spans")
    piece = F.substring("value", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    digits = F.length(F.regexp_replace("value", r"[^\p{Nd}]", ""))
    wide = (F.length("value") >= MIN_LENGTH) & (F.col("value").contains("@") | (digits >= MIN_DIGITS))
    whole = F.when(F.length("value") <= MAX_WHOLE, strip(F.col("value")))
    found = found.select("table", "column", ROW, F.col("s.kind").alias("kind"), piece.alias("piece"), whole.alias("whole"), wide.alias("wide"))
    return found.withColumn("canon", canonical_of(F.col("kind"), F.col("piece")))


def exhaustive(some: DataFrame) -> DataFrame:
    """(table, column, ROW, kind, canon): every window of every run of digits, and every mail address."""
    norm = some.filter(F.col("value").rlike(SOME_IDENTIFIER)).withColumn("norm", normalize(F.col("value"))).filter(F.col("norm").rlike("[0-9]{10}|@"))
    return exploded(norm.withColumn("windows", windows(F.col("norm"))), "windows", "w").select("table", "column", ROW, "w.kind", "w.canon")


def leaks(twin: dict[str, DataFrame], originals: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(table, column, ROW, kind, canon, method): each original in a cell once; what the detector sees is its hit.

    seen: detected() of the twin's cells, where it has been written already.
    """
    some = all_cells(twin)
    seen = detected(some) if seen is None else seen
    by = lambda df, method: df.select("table", "column", ROW, "kind", "canon", F.lit(method).alias("method"))
    found = by(seen.filter(F.col("kind").isin(*HARD_KINDS)), "detector").unionByName(by(exhaustive(some), "exhaustive"))
    hits = found.join(originals, ["canon", "kind"], "left_semi")  # the value first: rows are sorted by its first bytes
    return hits.groupBy("table", "column", ROW, "kind", "canon").agg(F.min("method").alias("method"))


def kept_names(original: dict[str, DataFrame], twin: dict[str, DataFrame], name_columns: list[tuple[str, str]]) -> int:
    """Rows of a masked twin that keep their own full name."""
    kept = 0
    for table, column in name_columns:
        if column in twin[table].columns:
            old = original[table].select(ROW, normalize_name(F.col(f"`{column}`")).alias("old")).filter("old <> ''")
            new = twin[table].select(ROW, normalize_name(F.col(f"`{column}`")).alias("new"))
            kept += old.join(new, ROW).filter("old = new").count()
    return kept


def name_overlap(original: dict[str, DataFrame], twin: dict[str, DataFrame], name_columns: list[tuple[str, str]]) -> float:
    """Share of a synthetic twin's distinct full names that the original has (information only)."""
    names = lambda tables: reduce(DataFrame.union, [tables[t].select(normalize_name(F.col(f"`{c}`")).alias("n")) for t, c in name_columns if c in tables[t].columns]).filter("n IS NOT NULL").distinct()
    if not any(c in twin[t].columns for t, c in name_columns):
        return 0.0
    new = names(twin)
    n = new.count()
    return round(new.join(names(original), "n", "left_semi").count() / n, 4) if n else 0.0


def leak_scan(originals: DataFrame, twin: dict[str, DataFrame], mode: str = "masked", original: dict[str, DataFrame] | None = None, name_columns: list[tuple[str, str]] = (), seen: DataFrame | None = None) -> dict:
    """Counts and places, never values.  Any original in the twin, or a masked row that keeps its name, fails it."""
    hits = leaks(twin, originals, seen).cache()
    by = {(r["kind"], r["method"]): r["n"] for r in hits.groupBy("kind", "method").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = [r.asDict() for r in hits.orderBy("table", "column", ROW, "kind").select("table", "column", F.col(ROW).alias("row"), "kind", "method").limit(MAX_LOCATIONS).collect()]
    hits.unpersist()
    names: dict = {"columns": [f"{t}.{c}" for t, c in name_columns]}
    if original is not None and mode == "masked":
        names["rows_keeping_original_full_name"] = kept_names(original, twin, list(name_columns))
    elif original is not None and name_columns:
        names["full_name_overlap_rate"] = name_overlap(original, twin, list(name_columns))
    failed = bool(by) or names.get("rows_keeping_original_full_name", 0) > 0
    checked = {r["kind"]: r["n"] for r in originals.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {
        "hard_fail": failed, "verdict": "FAIL" if failed else "PASS", "cells_scanned": all_cells(twin).count(),
        "original_values_checked": {k: checked.get(k, 0) for k in HARD_KINDS}, "leaked_by_kind": {k: sum(n for (kind, _), n in by.items() if kind == k) for k in HARD_KINDS},
        "leaks_by_method": {m: sum(n for (_, method), n in by.items() if method == m) for m in ("detector", "exhaustive")}, "locations": places, "names": names,
    }


def residuals(twin: dict[str, DataFrame], generated: DataFrame, allowed: DataFrame | None = None, cleared: frozenset[str] = frozenset(), seen: DataFrame | None = None) -> DataFrame:
    """(table, column, ROW, kind, canon): valid identifiers in the twin that were not generated.

    generated: (value) canonical pseudonyms.  allowed: (table, column, ROW, canon) left in a cell by a reviewer.
    cleared: "table.column" confirmed to hold no identifiers.  seen: detected() of the twin's cells, where it has been written.
    """
    found = (detected(all_cells(twin)) if seen is None else seen).filter(F.col("wide") & F.col("kind").isin(*HARD_KINDS) & F.col("canon").isNotNull())
    if cleared:
        found = found.filter(~F.concat_ws(".", "table", "column").isin(*sorted(cleared)))
    known = generated.select(F.col("value").alias("known")).distinct()
    found = found.filter((F.col("kind") != IBAN) | is_valid(IBAN, F.col("canon")))
    found = found.join(known, F.col("canon") == F.col("known"), "left_anti")
    found = found.join(known, F.col("whole") == F.col("known"), "left_anti").drop("piece", "whole", "wide")
    if allowed is not None:
        found = found.join(allowed, ["canon", ROW, "table", "column"], "left_anti").select("table", "column", ROW, "kind", "canon")
    return found


def residual_scan(twin: dict[str, DataFrame], generated: DataFrame, allowed: DataFrame | None = None, cleared: frozenset[str] = frozenset(), seen: DataFrame | None = None) -> dict:
    found = residuals(twin, generated, allowed, cleared, seen).cache()
    by = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = [r.asDict() for r in found.orderBy("table", "column", ROW).select("table", "column", F.col(ROW).alias("row"), "kind").limit(2 * MAX_LOCATIONS).collect()]
    found.unpersist()
    return {"verdict": "FAIL" if by else "PASS", "found": sum(by.values()), "by_kind": {k: by.get(k, 0) for k in HARD_KINDS}, "locations": places}


def exact_copies(real: DataFrame, twin: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Twin rows that equal some real row over columns (those that both have, where none are given); nulls are equal."""
    names = columns or [c for c in columns_of(twin) if c in real.columns]
    if not names:
        return twin.limit(0)
    texts = [F.col(f"`{c}`").cast("string") for c in names]
    key = F.to_json(F.struct(*(x.alias(f"c{k}") for k, x in enumerate(texts))), {"ignoreNullFields": "false"})
    # few rows have the hash of a row of the other side: only these are compared in full
    hashed = lambda df, name: df.withColumn(name, F.xxhash64(*texts))
    some = hashed(twin, "_own").join(hashed(real, "_real").select("_real").distinct(), F.col("_own") == F.col("_real"), "left_semi")
    rows = hashed(real, "_real").join(some.select("_own").distinct(), F.col("_own") == F.col("_real"), "left_semi").select(key.alias("_copied")).distinct()
    return some.withColumn("_row", key).join(rows, F.col("_row") == F.col("_copied"), "left_semi").drop("_row", "_own")


def orphans(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows of the child with a reference that no parent has; a null refers to nothing."""
    keys = parent.select(F.col(f"`{parent_column}`").alias("_key")).distinct()
    return child.filter(F.col(f"`{child_column}`").isNotNull()).join(keys, F.col(f"`{child_column}`") == F.col("_key"), "left_anti")


# ---------------------------------------------------------------- scores of detection


def score_detection(predicted: DataFrame, golden: DataFrame, lookalikes: DataFrame | None = None) -> DataFrame:
    """(kind, golden, predicted, found, exact, right, hard_negatives_hit) by kind and for OVERALL.

    All hold (table, column, ROW, start, end, kind).  A golden span is found if a predicted one of its kind overlaps
    it, a predicted one is right if it overlaps a golden one of its kind; a look-alike is hit by any overlap of its kind.
    """
    cell = ["table", "column", ROW, "kind"]

    def joined(a: DataFrame, b: DataFrame, exact: bool = False) -> DataFrame:
        right = b.select(*(F.col(c).alias(f"_{c}") for c in (*cell, "start", "end")))
        on = reduce(lambda x, y: x & y, (F.col(c) == F.col(f"_{c}") for c in cell))
        on &= ((F.col("start") == F.col("_start")) & (F.col("end") == F.col("_end"))) if exact else ((F.col("start") < F.col("_end")) & (F.col("_start") < F.col("end")))
        return a.join(right, on, "left_semi")

    parts = {
        "golden": golden, "predicted": predicted, "found": joined(golden, predicted), "exact": joined(golden, predicted, True), "right": joined(predicted, golden),
        "hard_negatives_hit": golden.limit(0) if lookalikes is None else joined(lookalikes, predicted),
    }
    rows = reduce(DataFrame.unionByName, [df.select("kind", F.lit(name).alias("what")) for name, df in parts.items()])
    counts = rows.groupBy("kind").agg(*(F.count_if(F.col("what") == x).alias(x) for x in parts))
    overall = counts.agg(*(F.sum(x).alias(x) for x in parts)).withColumn("kind", F.lit("OVERALL")).filter("golden IS NOT NULL")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4))
    return counts.unionByName(overall).withColumns({"recall": ratio("found", "golden"), "precision": ratio("right", "predicted")})


def fake_validity(twin: dict[str, DataFrame], detections: list[Detection]) -> DataFrame:
    """(column, kind, n, valid): non-null values of the twin's identifier columns and how many are valid."""
    parts = []
    for d in detections:
        if d.tag == "DIRECT_ID" and d.kind in KINDS and d.column in twin[d.table].columns:
            value = twin[d.table].select(F.col(f"`{d.column}`").alias("v")).filter("v IS NOT NULL")
            valid = F.col("v").rlike(r"\S") if d.kind == PERSON_NAME else is_valid(d.kind, F.col("v"))
            parts.append(value.agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("valid")).select(F.lit(f"{d.table}.{d.column}").alias("column"), F.lit(d.kind).alias("kind"), "n", "valid"))
    return reduce(DataFrame.unionByName, parts)
