"""Looking at twins and originals: search, sort, pages, marks, entities, notes worth showing, totals, planted leaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profiling import is_number
from .tables import ROW, Detection, ForeignKey, Profile, cells, columns_of

MIN_PAGE, MAX_PAGE, TOP_NOTES, SNIPPET = 10, 100, 12, 28
MISSED, FALSE_ALARM, KIND = 1, 3, 2


# ---------------------------------------------------------------- pages


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows with a cell that holds a text, whatever the case; an empty text finds all."""
    wanted = text.strip().lower()
    if not wanted:
        return df
    return df.filter(reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(f"`{c}`").cast("string")), F.lit(wanted)), F.lit(False)) for c in columns_of(df))))


def number_of(value: Column) -> Column:
    plain = F.replace(value.cast("string"), F.lit(","), F.lit(""))
    return F.when(is_number(plain), F.trim(plain).try_cast("double"))


def sorts_as_number(df: DataFrame, column: str, share: float = 0.9) -> bool:
    """Do more than this share of the cells read as numbers?  Nulls don't."""
    return (df.agg(F.avg(number_of(F.col(f"`{column}`")).isNotNull().cast("int")).alias("x")).first()["x"] or 0.0) > share


def sort_rows(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Rows by a column, as numbers if it mostly holds those; ties by row number, what is no number last."""
    value = number_of(F.col(f"`{column}`")) if sorts_as_number(df, column) else F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
    return df.orderBy(value.desc_nulls_last() if descending else value.asc_nulls_last(), ROW)


def page(df: DataFrame, number: int = 1, size: int = 50, text: str = "", sort: str | None = None, descending: bool = False) -> tuple[DataFrame, dict]:
    """(one page of rows, {total, page, pages, size}); sizes and page numbers are brought into range."""
    found = search(df, text)
    size, total = min(max(size, MIN_PAGE), MAX_PAGE), found.count()
    pages = max(1, -(-total // size))
    number = min(max(number, 1), pages)
    ordered = sort_rows(found, sort, descending) if sort in columns_of(df) else found.orderBy(ROW)
    return ordered.offset((number - 1) * size).limit(size), {"total": total, "page": number, "pages": pages, "size": size}


def cell_marks(shown: DataFrame, table: str, marks: DataFrame | None, replaced: list[str]) -> DataFrame:
    """(ROW, column, mark) of a page's cells: review above replaced above none."""
    out = cells(shown).select(ROW, "column").withColumn("whole", F.col("column").isin(replaced) if replaced else F.lit(False))
    if marks is None:
        return out.select(ROW, "column", F.when(F.col("whole"), "replaced").otherwise("none").alias("mark"))
    own = marks.filter(F.col("table") == table).select(F.col("column").alias("_c"), F.col(ROW).alias("_r"), F.col("mark").alias("_m"))
    out = out.join(own, (F.col("column") == F.col("_c")) & (F.col(ROW) == F.col("_r")), "left")
    mark = F.when(F.col("_m") == "review", "review").when(F.col("whole") | (F.col("_m") == "replaced"), "replaced").otherwise("none")
    return out.select(ROW, "column", mark.alias("mark"))


# ---------------------------------------------------------------- entities


def entity_key(profile: Profile) -> tuple[str, str] | None:
    """(table, key) of the parent that most foreign keys point at, the first of equals."""
    parents = [(f.parent_table, f.parent_column) for f in profile.foreign_keys]
    return max(dict.fromkeys(parents), key=parents.count) if parents else next(((t, k) for t, k in profile.primary_keys.items() if k), None)


def entity_rows(tables: dict[str, DataFrame], profile: Profile, value: str) -> dict[str, DataFrame]:
    """The rows of one entity: its own and those that refer to it."""
    key = entity_key(profile)
    if key is None:
        return {}
    out = {key[0]: tables[key[0]].filter(F.col(f"`{key[1]}`") == value)}
    for f in profile.foreign_keys:
        if (f.parent_table, f.parent_column) == key:
            out[f.child_table] = tables[f.child_table].filter(F.col(f"`{f.child_column}`") == value)
    return out


def entity_labels(tables: dict[str, DataFrame], profile: Profile, detections: list[Detection], n: int = 50) -> DataFrame:
    """(value, label) of the first n entities: the key, with the name where a column holds one."""
    table, key = entity_key(profile)
    name = next((d.column for d in detections if d.table == table and d.kind == "PERSON_NAME"), None)
    value = F.col(f"`{key}`")
    label = F.concat_ws(" - ", value, F.col(f"`{name}`")) if name else value
    return tables[table].orderBy(ROW).limit(n).select(value.alias("value"), label.alias("label"))


# ---------------------------------------------------------------- notes


def _covered(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Spans of a that (semi) overlap, or (anti) don't, a span of b in their cell."""
    other = b.select(*(F.col(c).alias(f"_{c}") for c in ("table", "column", ROW, "start", "end")))
    on = (F.col("table") == F.col("_table")) & (F.col("column") == F.col("_column")) & (F.col(ROW) == F.col(f"_{ROW}"))
    return a.join(other, on & (F.col("start") < F.col("_end")) & (F.col("_start") < F.col("end")), f"left_{how}")


def note_scores(spans: DataFrame, baseline: DataFrame) -> DataFrame:
    """(table, column, ROW, missed, false_alarms, kinds, score): what a naive tool misses and wrongly flags in a note."""
    cell = ["table", "column", ROW]
    count = lambda df, name: df.groupBy(*cell).agg(F.count(F.lit(1)).alias(name))
    out = spans.groupBy(*cell).agg(F.countDistinct("kind").alias("kinds"))
    out = out.join(count(_covered(spans, baseline, "anti"), "missed"), cell, "left").join(count(_covered(baseline, spans, "anti"), "false_alarms"), cell, "left")
    out = out.fillna(0, ["missed", "false_alarms"])
    return out.withColumn("score", MISSED * F.col("missed") + FALSE_ALARM * F.col("false_alarms") + KIND * F.col("kinds"))


def top_notes(scores: DataFrame, n: int = TOP_NOTES) -> DataFrame:
    """The n notes worth showing, the first rows of equals (a report with a limit)."""
    return scores.orderBy(F.col("score").desc(), "table", "column", ROW).limit(n)


def note_marks(spans: DataFrame, baseline: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """(table, column, ROW, start, end, kind, mark): hit, review or rejected spans, and a naive tool's false alarms."""
    place = ["table", "column", ROW, "start", "end", "kind"]
    if settled is None:
        hits = spans.select(*place, F.lit("hit").alias("mark"))
    else:
        state = settled.select("table", "column", ROW, "start", "final")
        joined = spans.join(state, ["table", "column", ROW, "start"], "left")
        mark = F.when(F.col("final") == "pending", "review").when(F.col("final") == "keep", "rejected").otherwise("hit")
        hits = joined.select(*place, mark.alias("mark"))
    return hits.unionByName(_covered(baseline, spans, "anti").select(*place, F.lit("false_alarm").alias("mark")))


def default_entity(tables: dict[str, DataFrame], profile: Profile, scores: DataFrame) -> str | None:
    """The entity whose notes score highest; the first by key of equals."""
    key = entity_key(profile)
    best = None
    for f in (f for f in profile.foreign_keys if (f.parent_table, f.parent_column) == key):
        own = scores.filter(F.col("table") == f.child_table).join(tables[f.child_table].select(ROW, F.col(f"`{f.child_column}`").alias("owner")), ROW)
        row = own.filter("owner IS NOT NULL").groupBy("owner").agg(F.sum("score").alias("score")).orderBy(F.col("score").desc(), "owner").first()
        if row and (best is None or row["score"] > best[0]):
            best = (row["score"], row["owner"])
    return best[1] if best else None


def snippet(text: Column, start: Column, end: Column, reach: int = SNIPPET) -> Column:
    """A span with what stands around it; dots where the text goes on."""
    low, high = F.greatest(start - reach, F.lit(0)), F.least(end + reach, F.length(text))
    return F.concat(F.when(low > 0, "…").otherwise(""), F.substring(text, low + 1, high - low), F.when(high < F.length(text), "…").otherwise(""))


# ---------------------------------------------------------------- totals


def twin_totals(tables: dict[str, DataFrame], profile: Profile) -> DataFrame:
    """(table, column, rows, total): each table's rows, and the sums of its numeric columns that are no keys."""
    keys = {(f.child_table, f.child_column) for f in profile.foreign_keys} | set(profile.primary_keys.items())
    parts = []
    for t, df in tables.items():
        numeric = [c for c in columns_of(df) if (t, c) not in keys and (t, c) in profile.columns and profile.columns[t, c].dtype == "numeric"]
        sums = cells(df, numeric).groupBy("column").agg(F.sum(number_of(F.col("value"))).alias("total")) if numeric else None
        rows = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table"), F.lit("").alias("column"), "rows", F.lit(None).cast("double").alias("total"))
        parts.append(rows)
        if sums is not None:
            parts.append(sums.select(F.lit(t).alias("table"), "column", F.lit(None).cast("long").alias("rows"), "total"))
    return reduce(DataFrame.unionByName, parts)


def referential_integrity(tables: dict[str, DataFrame], keys: list[ForeignKey]) -> DataFrame:
    """(child, parent, rows, orphans) for each foreign key."""
    from .scans import orphans

    parts = []
    for f in keys:
        n = tables[f.child_table].agg(F.count(f"`{f.child_column}`").alias("rows"))
        lost = orphans(tables[f.child_table], f.child_column, tables[f.parent_table], f.parent_column).agg(F.count(F.lit(1)).alias("orphans"))
        both = n.withColumn("k", F.lit(1)).join(lost.withColumn("k", F.lit(1)), "k")
        parts.append(both.select(F.lit(f"{f.child_table}.{f.child_column}").alias("child"), F.lit(f"{f.parent_table}.{f.parent_column}").alias("parent"), "rows", "orphans"))
    return reduce(DataFrame.unionByName, parts)


def detection_summary(detections: list[Detection], spans: DataFrame | None, baseline: DataFrame | None) -> dict:
    """Counts for a page on what was found, and what a naive tool would have found."""
    n = lambda df: {} if df is None else {r["kind"]: r["n"] for r in df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    columns: dict[str, dict[str, str]] = {}
    for d in detections:
        columns.setdefault(d.table, {})[d.column] = d.kind or d.tag
    return {"columns": columns, "identifier_columns": sum(d.tag == "DIRECT_ID" for d in detections), "needs_review": sum(d.needs_review for d in detections), "spans": n(spans), "baseline": n(baseline)}


def found_by_kind(tables: dict[str, DataFrame], detections: list[Detection], spans: DataFrame | None) -> DataFrame:
    """(kind, n): valid values in identifier columns and spans."""
    from ..functions.identifiers import is_valid

    parts = [tables[d.table].filter(is_valid(d.kind, F.col(f"`{d.column}`"))).select(F.lit(d.kind).alias("kind")) for d in detections if d.tag == "DIRECT_ID" and d.kind]
    parts += [spans.select("kind")] if spans is not None else []
    return reduce(DataFrame.unionByName, parts).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def overrides_from_edits(detections: list[Detection], edits: dict[tuple[str, str], dict]) -> dict[str, dict]:
    """What a person changed in a table of detections, as overrides: only fields that differ."""
    out = {}
    for d in detections:
        wanted = edits.get((d.table, d.column), {})
        changed = {k: v for k, v in wanted.items() if k == "action" or v != getattr(d, k)}
        if changed:
            out[f"{d.table}.{d.column}"] = changed
    return out


# ---------------------------------------------------------------- planted leaks


def disguise(value: Column, how: str = "spaced") -> Column:
    """A value as it might slip through: in Eastern digits with blanks, or glued to letters and digits."""
    if how == "glued":
        return F.concat(F.lit("x"), value, F.lit("9"))
    eastern = F.translate(value, "0123456789", "٠١٢٣٤٥٦٧٨٩")
    return F.regexp_replace(eastern, r"(\p{Nd}{3})(?=\p{Nd})", "$1 ")


def plant_leak(twin: DataFrame, column: str, row: int, value: str, how: str = "spaced") -> DataFrame:
    """The twin with one original at the end of one cell, to show that the scans see it."""
    cell = F.col(f"`{column}`")
    return twin.withColumn(column, F.when(F.col(ROW) == row, F.concat_ws(" ", cell, disguise(F.lit(value), how))).otherwise(cell))


# ---------------------------------------------------------------- retention


def expired(twins: DataFrame, shares: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """Twins (twin_id, created) older than so many days that no active share (twin_id, active) holds."""
    held = shares.filter("active").select(F.col("twin_id").alias("held")).distinct()
    return twins.filter(F.col("created") < now - F.make_interval(days=F.lit(days))).join(held, F.col("twin_id") == F.col("held"), "left_anti")


def organisation_stats(datasets: DataFrame, org: str, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(one row of counts and bytes, the n latest) of one organisation's datasets (org, dataset_id, size, created)."""
    own = datasets.filter(F.col("org") == org)
    return own.agg(F.count(F.lit(1)).alias("datasets"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")), own.orderBy(F.col("created").desc(), "dataset_id").limit(n)
