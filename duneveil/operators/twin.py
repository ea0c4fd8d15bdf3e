"""The masked twin: every decision carried out, the same pseudonym for the same value in all tables and notes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import EMAIL, MOBILE, PERSON_NAME
from ..functions.names import GAZETTEER, Gazetteer
from ..functions.spans import replace_spans
from .policy import Decision
from .pseudonyms import NAME_PARTS, assign, collect_values, faked
from .tables import ROW, columns_of, dealt, written


@dataclass
class Twin:
    tables: dict[str, DataFrame]
    #: (kind, canon, fake): never written out with the twin.
    mapping: DataFrame
    #: Places only: (table, column, ROW) of the cells in which spans were replaced.
    changed: DataFrame | None
    counts: dict[str, int]


def _kind(d: Decision) -> str | None:
    """Under which kind a column's values get pseudonyms."""
    if d.action == "remap":
        return d.remap_group or f"PK:{d.table}.{d.column}"
    return (d.kind or PERSON_NAME) if d.action == "pseudonymize" else None


def mapping_for(tables: dict[str, DataFrame], decisions: list[Decision], spans: DataFrame | None, key: bytes, names: Gazetteer = GAZETTEER) -> DataFrame:
    """(kind, canon, fake) of every value that any decision replaces."""
    columns = [(tables[d.table], d.column, kind) for d in decisions if (kind := _kind(d))]
    values = collect_values(columns, spans)
    first = next((d.params.get("keep_first_digit", False) for d in decisions if d.kind == "SAUDI_ID" and d.action == "pseudonymize"), True)
    return written(assign(values, key, bool(first), names).select("kind", "canon", "fake"), "mapping")


def swaps_for(tables: dict[str, DataFrame], decisions: list[Decision], spans: DataFrame | None, mapping: DataFrame) -> DataFrame:
    """(kind, raw, value): what stands for each distinct value of columns and spans, in its own layout."""
    parts = [tables[d.table].select(F.lit(kind).alias("kind"), F.col(f"`{d.column}`").alias("raw")) for d in decisions if (kind := _kind(d))]
    parts += [spans.select("kind", F.col("piece").alias("raw"))] if spans is not None else []
    if not parts:
        return mapping.select("kind", F.col("canon").alias("raw"), F.col("fake").alias("value")).limit(0)
    raws = written(dealt(reduce(DataFrame.unionByName, parts).filter("raw IS NOT NULL").distinct()), "raws")
    return written(faked(raws, mapping), "swaps")


def swap_cells(df: DataFrame, table: str, kinds: dict[str, str], texts: list[str], spans: DataFrame | None, swaps: DataFrame) -> DataFrame:
    """df with the values of columns (column -> kind) and the spans of text columns replaced, each in its own layout.

    All cells to be replaced become rows, meet what stands for them in one join, and come back to their rows in another, so that
    the table itself is shuffled once, by its row numbers, however many columns are replaced.
    """
    parts = []
    if kinds:
        of = [F.struct(F.lit(c).alias("c"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(kind).alias("kind"), F.col(f"`{c}`").alias("raw")) for c, kind in kinds.items()]
        parts.append(df.select(ROW, F.explode(F.array(*of)).alias("x")).select(ROW, "x.*").filter("raw IS NOT NULL"))
    if spans is not None and texts:
        own = spans.filter((F.col("table") == table) & F.col("column").isin(*texts))
        parts.append(own.select(ROW, F.col("column").alias("c"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "kind", F.col("piece").alias("raw")))
    if not parts:
        return df
    put = reduce(DataFrame.unionByName, parts).join(swaps, ["raw", "kind"])
    put = put.groupBy(F.col(ROW).alias("_row")).agg(F.array_sort(F.collect_list(F.struct("c", "start", "end", "value"))).alias("_puts"))
    out = df.join(put, F.col(ROW) == F.col("_row"), "left")

    def new(c: str) -> Column:
        value, mine = F.col(f"`{c}`"), F.filter("_puts", lambda p: p["c"] == c)
        if c in kinds:
            return F.get(mine, F.lit(0))["value"]
        held = F.transform(mine, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["value"].alias("value")))
        return F.when(F.coalesce(F.size(mine), F.lit(0)) < 1, value).otherwise(replace_spans(value, held))

    return out.select(*((new(c) if c in kinds or c in texts else F.col(f"`{c}`")).alias(c) for c in df.columns))


def build(tables: dict[str, DataFrame], decisions: list[Decision], spans: DataFrame | None, key: bytes, names: Gazetteer = GAZETTEER) -> Twin:
    """Carry out keep, drop, pseudonymize, remap and replace_spans.  spans: those chosen for replacement."""
    replaced = [(d.table, d.column) for d in decisions if d.action == "replace_spans"]
    if spans is not None:
        wanted = F.struct("table", "column").isin(*(F.struct(F.lit(t).alias("table"), F.lit(c).alias("column")) for t, c in replaced)) if replaced else F.lit(False)
        spans = spans.filter(wanted)
    mapping = mapping_for(tables, decisions, spans, key, names)
    swaps = swaps_for(tables, decisions, spans, mapping)
    out, counts = {}, dict.fromkeys(("keep", "drop", "pseudonymize", "remap", "replace_spans"), 0)
    for table, df in tables.items():
        own = [d for d in decisions if d.table == table]
        for d in own:
            counts[d.action] += 1
        df = df.drop(*(d.column for d in own if d.action == "drop"))
        kinds = {d.column: kind for d in own if (kind := _kind(d))}
        df = swap_cells(df, table, kinds, [d.column for d in own if d.action == "replace_spans"], spans, swaps)
        out[table] = written(df, f"twin-{len(out)}")
    changed = None if spans is None else spans.select("table", "column", ROW).distinct()
    return Twin(out, mapping, changed, counts)


def generated(mapping: DataFrame) -> DataFrame:
    """(value): every pseudonym in canonical form; what the residual scan lets pass."""
    fakes = mapping.filter(~F.col("kind").isin(*NAME_PARTS))
    mail = F.when(F.col("kind") == EMAIL, F.lower("fake")).otherwise(F.col("fake"))
    with_zero = fakes.filter(F.col("kind") == MOBILE).select(F.concat(F.lit("0"), "fake").alias("value"))
    return fakes.select(mail.alias("value")).union(with_zero).distinct()


def mask_texts(texts: DataFrame, spans: DataFrame, key: bytes, names: Gazetteer = GAZETTEER) -> DataFrame:
    """A preview: texts (ROW, value) with their spans (ROW, start, end, kind, piece, table, column) replaced."""
    mapping = written(assign(collect_values([], spans), key, True, names).select("kind", "canon", "fake"), "preview")
    first = spans.select("table", "column").first()
    return texts if first is None else swap_cells(texts, first["table"], {}, ["value"], spans.withColumn("column", F.lit("value")), swaps_for({}, [], spans, mapping))


def marks(decisions: list[Decision], changed: DataFrame | None, waiting: DataFrame | None) -> DataFrame | None:
    """(table, column, ROW, mark): cells with replaced spans, and those with spans that wait, which stand above."""
    parts = [df.select("table", "column", ROW, F.lit(m).alias("mark")) for df, m in ((changed, "replaced"), (waiting, "review")) if df is not None]
    if not parts:
        return None
    return reduce(DataFrame.unionByName, parts).groupBy("table", "column", ROW).agg(F.max("mark").alias("mark"))


def replaced_columns(decisions: list[Decision]) -> dict[str, list[str]]:
    """Columns whose every value is a pseudonym, by table."""
    out: dict[str, list[str]] = {}
    for d in decisions:
        if _kind(d):
            out.setdefault(d.table, []).append(d.column)
    return out


def compare_rows(original: DataFrame, twin: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(ROW, column, original, twin, changed): both sides of the cells of these columns."""
    names = [c for c in (columns or columns_of(original)) if c in twin.columns]
    side = lambda df, name: df.unpivot(ROW, names, "column", name)
    both = side(original.select(ROW, *names), "original").join(side(twin.select(ROW, *names), "twin"), [ROW, "column"])
    return both.withColumn("changed", ~F.col("original").eqNullSafe(F.col("twin")))
