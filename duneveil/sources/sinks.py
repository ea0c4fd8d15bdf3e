"""Where twins go: CSV folders, guarded exports, table sets with their marks; names and types of database targets."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profiling import DATE_SHAPE, is_number
from ..operators.tables import ROW, ForeignKey, columns_of
from .workbook import write_workbook

# What starts a formula; plain numbers that may start with a sign; schemas that are never written to.
FORMULA_START = r"(?s)^[=+\-@\t\r].*"
PLAIN_NUMBER = r"^[+-]?([0-9]+([.,][0-9]+)?|[0-9]{1,3}(,[0-9]{3})+([.][0-9]+)?)$"
SYSTEM_SCHEMAS = ("information_schema", "mysql", "performance_schema", "sys")


def write_csv_folder(tables: dict[str, DataFrame], folder: str, single: bool = False) -> list[str]:
    """folder/NAME.csv, a folder of UTF-8 part files in the order of rows (single: one part, for small tables)."""
    out = []
    for name, df in tables.items():
        path = f"{folder}/{name}.csv"
        rows = df.coalesce(1).sortWithinPartitions(ROW) if single and ROW in df.columns else df.repartitionByRange(ROW).sortWithinPartitions(ROW) if ROW in df.columns else df
        rows.drop(ROW).write.mode("overwrite").options(header=True, encoding="UTF-8", lineSep="\n", escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
        out.append(path)
    return out


def safe_cell(value: Column) -> Column:
    """A text that a spreadsheet would run gets an apostrophe in front; numbers stay; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(FORMULA_START) & ~text.rlike(PLAIN_NUMBER), F.concat(F.lit("'"), text)).otherwise(text)


def safe_name(name: str) -> str:
    return f"'{name}" if re.match(FORMULA_START, name) and not re.match(PLAIN_NUMBER, name) else name


def safe_table(df: DataFrame) -> DataFrame:
    return df.select(*([ROW] if ROW in df.columns else []), *(safe_cell(F.col(f"`{c}`")).alias(safe_name(c)) for c in columns_of(df)))


def export_csv(tables: dict[str, DataFrame], folder: str) -> list[str]:
    return write_csv_folder({n: safe_table(df) for n, df in tables.items()}, folder)


def export_workbook(tables: dict[str, DataFrame], path: str) -> str:
    """One workbook of guarded text cells; rows pass the driver one partition at a time, as the format is one file."""
    def rows(df: DataFrame) -> Iterable[list[str]]:
        ordered = df.sort(ROW).drop(ROW) if ROW in df.columns else df
        return (list(r) for r in ordered.toLocalIterator())

    safe = {n: safe_table(df) for n, df in tables.items()}
    with open(path, "wb") as file:
        file.write(write_workbook({n: (columns_of(df), rows(df)) for n, df in safe.items()}))
    return path


def write_table_set(tables: dict[str, DataFrame], folder: str, marks: DataFrame | None = None, meta: dict | None = None) -> None:
    """A Parquet folder for each table, the marks, and the tables' order beside them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    if marks is not None:
        marks.write.mode("overwrite").parquet(f"{folder}/_marks")
    spark = next(iter(tables.values())).sparkSession
    record = json.dumps({"order": list(tables), "marks": marks is not None} | (meta or {}), ensure_ascii=False)
    spark.createDataFrame([(record,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_meta")


def read_table_set(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame | None, dict]:
    meta = json.loads(spark.read.text(f"{folder}/_meta").first()["value"])
    tables = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in meta["order"]}
    return tables, spark.read.parquet(f"{folder}/_marks") if meta["marks"] else None, meta


# ---------------------------------------------------------------- databases


def _plain_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?", name):
        raise ValueError(f"bad name: {name!r}")
    return name


def guarded_target(source: str, target: str) -> str:
    """target, if it may be written: not the source in any case of letters, no system schema, a plain name."""
    if _plain_name(target).casefold() == source.casefold():
        raise ValueError("the target is the source")
    if target.casefold() in SYSTEM_SCHEMAS:
        raise ValueError("the target is a system schema")
    return target


def parents_first(tables: list[str], keys: list[ForeignKey]) -> list[str]:
    """Tables so that each comes behind those that it refers to; a circle is broken where it is met."""
    out: list[str] = []
    waiting = list(tables)
    while waiting:
        ready = [t for t in waiting if not any(k.child_table == t and k.parent_table in waiting and k.parent_table != t for k in keys)] or waiting[:1]
        out += ready
        waiting = [t for t in waiting if t not in ready]
    return out


def column_types(df: DataFrame, source_types: dict[str, str] | None = None) -> dict[str, str]:
    """A database type for each column in one pass: the source's if given, else BIGINT, DOUBLE, DATE, VARCHAR or TEXT."""
    names = columns_of(df)
    facts = []
    for k, c in enumerate(names):
        v = F.col(f"`{c}`")
        facts += [F.bool_and(v.rlike(r"^-?(0|[1-9][0-9]{0,17})$")).alias(f"int{k}"), F.bool_and(is_number(v)).alias(f"num{k}"), F.bool_and(v.rlike(DATE_SHAPE) & (F.length(v) <= 10)).alias(f"date{k}"), F.max(F.length(v)).alias(f"len{k}")]
    r = df.agg(*facts).first() if names else {}

    def kind(k: int) -> str:
        if r[f"len{k}"] is None:
            return "VARCHAR(255)"
        return "BIGINT" if r[f"int{k}"] else "DOUBLE" if r[f"num{k}"] else "DATE" if r[f"date{k}"] else "VARCHAR(255)" if r[f"len{k}"] <= 255 else "TEXT"

    return {c: (source_types or {}).get(c) or kind(k) for k, c in enumerate(names)}
