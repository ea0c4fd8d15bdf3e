"""Cleaning rules, each optional, in a fixed order; what they would change; suggestions and reports."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import IBAN, MOBILE, SAUDI_ID, canonical, is_valid
from ..functions.names import GAZETTEER
from ..functions.text import BLANKS, INVISIBLE, arabic_forms, ascii_digits, strip
from .profiling import is_number, null_like
from .tables import ROW, cells, columns_of, exact_percentiles, numbered

RULES = ("trim", "nulls", "numbers", "dates", "arabic", "phones", "merges", "dedupe")
# How numbers and dates may be written.
GROUPED_NUMBER = r"^[+-]?([0-9]+|[0-9]{1,3}([,٬][0-9]{3})+)([.٫][0-9]+)?$"
DATE = r"^([0-9]{1,4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,4})$"
ORDERS = {"ymd": (1, 2, 3), "dmy": (3, 2, 1), "mdy": (3, 1, 2)}


@dataclass(frozen=True)
class CleanOptions:
    trim: bool = True
    nulls: bool = True
    numbers: bool = True
    dates: bool = True
    dedupe: bool = True
    arabic: bool = False
    phones: bool = False
    merges: tuple[str, ...] = field(default=())

    @classmethod
    def from_dict(cls, d: dict | None) -> CleanOptions:
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if k == "merges" else v for k, v in (d or {}).items() if k in known})

    @classmethod
    def off(cls) -> CleanOptions:
        return cls(trim=False, nulls=False, numbers=False, dates=False, dedupe=False)

    @classmethod
    def only(cls, rule: str) -> CleanOptions:
        return cls(**{f.name: f.name == rule for f in fields(cls) if f.name != "merges"})


# ---------------------------------------------------------------- values


def trim_value(v: Column) -> Column:
    """Without invisible characters, blanks of any script single, none at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(v, f"[{INVISIBLE}]", ""), rf"[\t\x20\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]+", " "))


def null_value(v: Column) -> Column:
    return F.when(~null_like(v), v)


def number_value(v: Column) -> Column:
    return F.regexp_replace(F.translate(F.regexp_replace(ascii_digits(v), "[,٬]", ""), "٫", "."), r"^\+", "")


def _date_parts(v: Column) -> list[Column]:
    d = ascii_digits(v)
    return [F.regexp_extract(d, DATE, k) for k in (1, 2, 3)]


def iso(v: Column, order: str) -> Column:
    """The date as yyyy-mm-dd if it is one in this order, else null."""
    parts = _date_parts(v)
    y, m, d = (parts[k - 1] for k in ORDERS[order])
    text = F.concat(F.lpad(y, 4, "0"), F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))
    fits = (F.length(m) <= 2) & (F.length(d) <= 2) & y.try_cast("int").between(1000, 2999)
    return F.when(fits & text.try_cast("date").isNotNull(), text)


def date_value(v: Column, order: str) -> Column:
    return F.coalesce(iso(v, order), v)


def phone_value(v: Column) -> Column:
    return F.when(is_valid(MOBILE, v), F.concat(F.lit("0"), canonical(MOBILE, v))).otherwise(v)


# ---------------------------------------------------------------- columns


def column_facts(df: DataFrame) -> DataFrame:
    """(column, n, ...) what the rules ask of whole columns, in one pass over the cells."""
    v = F.col("value")
    rows = cells(df).filter(v.isNotNull())
    share = lambda x: F.coalesce(F.avg(x.cast("int")), F.lit(0.0))
    shape = ascii_digits(v).rlike(DATE)
    return rows.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_unique"), F.avg(F.length(v)).alias("mean_len"),
        share(ascii_digits(v).rlike(GROUPED_NUMBER)).alias("grouped"), F.max(ascii_digits(v).rlike("^0[0-9]")).alias("leading_zero"),
        *(share(is_valid(k, v)).alias(k.lower()) for k in (SAUDI_ID, MOBILE, IBAN)), share(GAZETTEER.is_known_name(v)).alias("names"),
        share(shape).alias("dated"), *(F.min(F.when(shape, iso(v, o).isNotNull())).alias(o) for o in ORDERS),
    )


def is_numeric(f: dict) -> bool:
    return f["n"] > 0 and f["grouped"] >= 0.98 and not f["leading_zero"] and max(f["saudi_id"], f["mobile"], f["iban"]) <= 0.5


def date_order(f: dict) -> str | None:
    """ymd, dmy or mdy if only one order fits all dates; ambiguous if several do; None if it is no date column."""
    fits = [o for o in ORDERS if f["n"] and f["dated"] >= 0.95 and f[o]]
    return None if not fits else fits[0] if len(fits) == 1 else "ambiguous"


def is_categorical(f: dict, n_rows: int) -> bool:
    return 0 < f["n_unique"] <= max(20, int(0.05 * n_rows)) and f["mean_len"] < 40 and f["names"] < 0.5


def facts_of(df: DataFrame) -> tuple[dict[str, dict], int]:
    return {r["column"]: r.asDict() for r in column_facts(df).collect()}, df.count()


# ---------------------------------------------------------------- suggestions and reports


def category_suggestions(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, group_key, target, variant, n): spellings that differ by blanks, case or letter forms only.

    The target is the most frequent spelling, the first by code point among equals.
    """
    rows = cells(df, columns).filter(F.col("value").isNotNull()).select("column", trim_value(F.col("value")).alias("variant"))
    counts = rows.groupBy("column", "variant").agg(F.count(F.lit(1)).alias("n")).withColumn("group_key", F.replace(F.lower(arabic_forms(F.col("variant"))), F.lit(" "), F.lit("")))
    best = counts.groupBy("column", "group_key").agg(F.min(F.struct(-F.col("n"), "variant")).alias("best"), F.count(F.lit(1)).alias("spellings"))
    best = best.filter("spellings > 1").select(F.col("column").alias("c"), F.col("group_key").alias("g"), F.col("best.variant").alias("target"))
    return counts.join(best, (F.col("column") == F.col("c")) & (F.col("group_key") == F.col("g"))).filter("variant <> target").select("column", "group_key", "target", "variant", "n")


def numbered_suggestions(table: str, suggestions: DataFrame) -> DataFrame:
    """suggestions with the keys by which they are approved: table.column#0, #1 ... by the size of the target's group."""
    totals = suggestions.groupBy("column", "group_key", "target").agg(F.sum("n").alias("rows"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.col("rows").desc(), "target")) - 1
    return totals.withColumn("key", F.concat(F.lit(f"{table}."), F.col("column"), F.lit("#"), place)).join(suggestions.drop("target"), ["column", "group_key"])


def report_only(df: DataFrame) -> DataFrame:
    """(column, missing, missing_share, extreme_outliers, mixed_types): what is worth a look and is not changed."""
    v = F.col("value")
    rows = cells(df).withColumn("number", F.when(is_number(ascii_digits(v)), F.trim(ascii_digits(v)).try_cast("double")))
    stats = rows.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("missing"), F.count("number").alias("numbers")
    )
    quartiles = exact_percentiles(rows.select(F.col("column").alias("g"), F.col("number").alias("v")), [0.25, 0.75])
    told = df.sparkSession.createDataFrame([(c, q[0.25], q[0.75]) for c, q in quartiles.items()], "c string, q1 double, q3 double")
    stats = stats.join(F.broadcast(told), F.col("column") == F.col("c"), "left").drop("c")  # a row for each column
    facts = column_facts(df).withColumnRenamed("column", "c")
    stats = stats.join(facts.drop("n"), F.col("column") == F.col("c"), "left").drop("c")
    share = F.coalesce(F.col("numbers") / F.nullif(F.col("n") - F.col("missing"), F.lit(0)), F.lit(0.0))
    numeric = (F.col("grouped") >= 0.98) & ~F.col("leading_zero") & (F.greatest("saudi_id", "mobile", "iban") <= 0.5)
    stats = stats.withColumns({"share": share, "iqr": F.col("q3") - F.col("q1")})
    asks = (F.col("share") >= 0.98) & (F.col("numbers") >= 20) & numeric & (F.col("iqr") > 0)
    wide = stats.select(F.col("column").alias("c"), (F.col("q1") - 3 * F.col("iqr")).alias("low"), (F.col("q3") + 3 * F.col("iqr")).alias("high"), asks.alias("asks"))
    far = rows.join(F.broadcast(wide), F.col("column") == F.col("c"))  # a row for each column
    far = far.filter(F.col("asks") & ((F.col("number") < F.col("low")) | (F.col("number") > F.col("high")))).groupBy(F.col("column").alias("c")).agg(F.count(F.lit(1)).alias("far"))
    out = stats.join(far, F.col("column") == F.col("c"), "left")
    return out.select(
        "column", "missing", F.round(F.col("missing") / F.col("n"), 3).alias("missing_share"), F.coalesce("far", F.lit(0)).alias("extreme_outliers"),
        ((F.col("share") >= 0.2) & (F.col("share") < 0.95)).alias("mixed_types"),
    )


# ---------------------------------------------------------------- rules


def dedupe_rows(df: DataFrame) -> DataFrame:
    """The first of equal rows, renumbered."""
    names = columns_of(df)
    first = df.groupBy(*(F.col(f"`{c}`") for c in names)).agg(F.min(ROW).alias(ROW))
    return numbered(first.repartitionByRange(ROW).sortWithinPartitions(ROW).drop(ROW))


def apply_rule(table: str, df: DataFrame, rule: str, options: CleanOptions = CleanOptions(), ambiguous: list[str] | None = None) -> DataFrame:
    """df after one rule other than dedupe."""
    names = columns_of(df)
    value = lambda c: F.col(f"`{c}`")
    if rule in ("trim", "nulls"):
        return df.withColumns({c: (trim_value if rule == "trim" else null_value)(value(c)) for c in names})
    facts, n_rows = facts_of(df)
    facts = {c: f for c, f in facts.items() if f["n"]}
    if rule == "numbers":
        return df.withColumns({c: number_value(value(c)) for c, f in facts.items() if is_numeric(f)})
    if rule == "dates":
        orders = {c: date_order(f) for c, f in facts.items()}
        if ambiguous is not None:
            ambiguous += [f"{table}.{c}" for c, o in orders.items() if o == "ambiguous"]
        return df.withColumns({c: date_value(value(c), o) for c, o in orders.items() if o in ORDERS})
    if rule == "arabic":
        return df.withColumns({c: arabic_forms(value(c)) for c, f in facts.items() if is_categorical(f, n_rows)})
    if rule == "phones":
        return df.withColumns({c: phone_value(value(c)) for c, f in facts.items() if f["mobile"] >= 0.8})
    if rule == "merges":
        chosen = numbered_suggestions(table, category_suggestions(df, [c for c, f in facts.items() if is_categorical(f, n_rows)])).filter(F.col("key").isin(list(options.merges)))
        for c in names:
            mapping = chosen.filter(F.col("column") == c).select(F.col("variant").alias("_from"), F.col("target").alias("_to"))
            if any(k.startswith(f"{table}.{c}#") for k in options.merges):
                df = df.join(mapping, trim_value(value(c)) == F.col("_from"), "left").withColumn(c, F.coalesce("_to", value(c))).drop("_from", "_to")
        return df
    raise ValueError(rule)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, changed): cells that differ, null-aware; rows are matched by number."""
    names = [c for c in columns_of(before) if c in after.columns]
    both = before.join(after.select(ROW, *(F.col(f"`{c}`").alias(f"new {c}") for c in names)), ROW)
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), (~F.col(f"`{c}`").eqNullSafe(F.col(f"`new {c}`"))).alias("differs")) for c in names)))
    return both.select(pairs.alias("x")).groupBy("x.column").agg(F.count_if("x.differs").alias("changed"))


def clean(tables: dict[str, DataFrame], options: CleanOptions = CleanOptions()) -> tuple[dict[str, DataFrame], dict]:
    """(cleaned tables, report of counts without values)."""
    applied: dict[str, dict] = {}
    ambiguous: list[str] = []
    for rule in RULES:
        if not getattr(options, rule):
            continue
        record, out = {}, {}
        for table, df in tables.items():
            if rule == "dedupe":
                out[table] = dedupe_rows(df)
                record[table] = df.count() - out[table].count()
            else:
                out[table] = apply_rule(table, df, rule, options, ambiguous)
                record |= {f"{table}.{r['column']}": r["changed"] for r in changes(df, out[table]).collect() if r["changed"]}
        tables, applied[rule] = out, {"total": sum(record.values()), "by_column": record}
    options_used = {k: v for k, v in asdict(options).items() if k != "merges"} | {"merges": len(options.merges)}
    return tables, {"options": options_used, "applied": applied, "ambiguous_dates": sorted(set(ambiguous))}


def potential(tables: dict[str, DataFrame]) -> dict[str, int]:
    """What each rule alone would change."""
    return {rule: clean(tables, CleanOptions.only(rule))[1]["applied"][rule]["total"] for rule in RULES if rule != "merges"}


def examples(table: str, df: DataFrame, rule: str, n: int = 5) -> DataFrame:
    """(column, before, after): up to n changed cells of one rule, first rows first."""
    after = cells(apply_rule(table, df, rule)).withColumnRenamed("value", "after")
    both = cells(df).withColumnRenamed("value", "before").join(after, [ROW, "column"]).filter(~F.col("before").eqNullSafe(F.col("after")))
    return both.orderBy("column", ROW).limit(n).select("column", "before", "after")
