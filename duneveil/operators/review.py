"""Review of uncertain spans: groups by the words before them, statistics, cross-checks, human decisions.

An uncertain span is one whose confidence is under REVIEW_BELOW.  Spans of one column, kind and preceding phrase
are one group.  Whether the ID-shaped numbers after a phrase are identity numbers is judged by how many of all of
them pass the check digit: about CHANCE of random numbers do.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import IBAN, SAUDI_ID, is_saudi_id
from ..functions.spans import REVIEW_BELOW, dropped, matches, place
from ..functions.text import normalize, normalize_name
from .tables import ROW, Detection, cells, written

# Share of random numbers that pass, smallest group, significance, least share of identity numbers.
CHANCE, MIN_GROUP, ALPHA_CHANCE, ID_LOWER_BOUND, CONFIDENCE = 0.10, 10, 0.01, 0.80, 0.05
WORD_BEFORE = r"[A-Za-z\x{0600}-\x{06FF}]+"
ENDS_WITH_WORD = r"[A-Za-z\x{0600}-\x{06FF}][ :#/()،,.\-]*$"
ID_SHAPE = r"(?<![0-9])[12][0-9]{9}(?![0-9])"
REACH = 40
#: The row first: what is joined is sorted by the first of its keys.
CELL = (ROW, "table", "column")


# ---------------------------------------------------------------- statistics


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 10_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + t / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return front * out


def chance_tail(n: int, k: int, p: float = CHANCE) -> float:
    """The probability of k or more of n."""
    return 1.0 if k <= 0 else beta_share(p, k, n - k + 1)


def lower_bound(n: int, k: int, level: float = CONFIDENCE) -> float:
    """The exact one-sided lower bound of a share, k of n."""
    low, high = 0.0, 1.0
    if k <= 0:
        return 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if beta_share(middle, k, n - k + 1) < level else (low, middle)
    return low


def judge(n: int, k: int) -> tuple[str | None, str, str]:
    """(automatic decision or None, suggestion, why) for n ID-shaped numbers of which k pass."""
    lean = "replace" if n and k / n >= 0.5 else "keep"
    if n < MIN_GROUP:
        return None, lean, "too_few"
    if chance_tail(n, k) >= ALPHA_CHANCE:
        return "keep", "keep", "chance"
    if lower_bound(n, k) >= ID_LOWER_BOUND:
        return "replace", "replace", "ids"
    return None, lean, "mixed"


def verdicts(n: Column, k: Column) -> Column:
    """judge() of two columns."""

    @F.pandas_udf("auto string, suggestion string, code string")
    def each(n: pd.Series, k: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(int(a), int(b)) for a, b in zip(n, k, strict=True)], columns=["auto", "suggestion", "code"])

    return each(n, k)


# ---------------------------------------------------------------- groups


def phrase_before(text: Column, start: Column) -> Column:
    """The one or two words right before a place in normal form; empty if something else stands between."""
    before = F.substring(text, F.greatest(start - REACH, F.lit(0)) + 1, F.least(start, F.lit(REACH)))
    words = F.regexp_extract_all(before, F.lit(WORD_BEFORE), F.lit(0))
    last = F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2))
    return F.when(before.rlike(ENDS_WITH_WORD), normalize_name(F.array_join(last, " "))).otherwise("")


def digits_only(text: Column) -> Column:
    return F.when(text.rlike("[^0-9]"), F.regexp_replace(normalize(text), "[^0-9]+", "")).otherwise(text)


def _texts(tables: dict[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """(table, column, ROW, value) of some columns."""
    out = None
    for table, column in columns:
        part = tables[table].select(F.lit(table).alias("table"), F.lit(column).alias("column"), ROW, F.col(f"`{column}`").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def population(tables: dict[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """(table, column, phrase, population, passed): all ID-shaped numbers of the columns by the phrase before them."""
    texts = _texts(tables, columns).filter(F.col("value").rlike(r"\p{Nd}"))
    found = texts.withColumn("norm", normalize(F.col("value"))).withColumn("dropped", dropped(F.col("value"), F.col("norm")))
    found = found.select("table", "column", "value", "dropped", F.explode_outer(matches(F.col("norm"), ID_SHAPE)).alias("m")).filter("m IS NOT NULL")
    phrase = phrase_before(F.col("value"), place(F.col("dropped"), F.col("m.start")))
    return found.groupBy("table", "column", phrase.alias("phrase")).agg(
        F.count(F.lit(1)).alias("population"), F.count_if(is_saudi_id(F.col("m.text"))).alias("passed")
    )


def uncertain(tables: dict[str, DataFrame], spans: DataFrame, columns: list[tuple[str, str]], least: float = 0.0) -> DataFrame:
    """Spans under REVIEW_BELOW (and not under least) with their phrase, group key and digits."""
    low = spans.filter((F.col("conf") < REVIEW_BELOW) & (F.col("conf") >= least))
    low = low.join(_texts(tables, columns), list(CELL))
    low = low.withColumn("phrase", phrase_before(F.col("value"), F.col("start"))).drop("value")
    return low.withColumn("key", F.concat_ws("|", "table", "column", "kind", "phrase")).withColumn("digits", digits_only(F.col("piece")))


def groups(tables: dict[str, DataFrame], low: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """(key, table, column, kind, phrase, count, population, passed, auto, suggestion, code), the largest first.

    Identity numbers are judged by their population; what has the shape of an IBAN is replaced; other kinds wait.
    """
    counts = low.groupBy("key", "table", "column", "kind", "phrase").agg(F.count(F.lit(1)).alias("count"))
    judged = population(tables, columns).withColumnsRenamed({"table": "t", "column": "c", "phrase": "p"})
    same = (F.col("table") == F.col("t")) & (F.col("column") == F.col("c")) & (F.col("phrase") == F.col("p")) & (F.col("kind") == SAUDI_ID)
    out = counts.join(judged, same, "left").drop("t", "c", "p").fillna(0, ["population", "passed"])
    out = out.withColumn("j", verdicts(F.col("population"), F.col("passed")))
    of = lambda name, iban, other: F.when(F.col("kind") == SAUDI_ID, F.col(f"j.{name}")).when(F.col("kind") == IBAN, F.lit(iban)).otherwise(F.lit(other).cast("string"))
    out = out.withColumns({"auto": of("auto", "replace", None), "suggestion": of("suggestion", "replace", "replace"), "code": of("code", "iban_shape", "unknown")})
    return out.drop("j").orderBy(F.col("count").desc(), "key")


def cross_check(tables: dict[str, DataFrame], detections: list[Detection], wanted: DataFrame) -> DataFrame:
    """(digits, is_id, label) for those of wanted (digits) that a column holds: identity columns first, then the
    others that hold no identifier, in the order of the detections."""
    places = [(k, d) for k, d in enumerate(detections) if d.tag != "FREE_TEXT" and (d.tag != "DIRECT_ID" or d.kind == SAUDI_ID)]
    out, least = None, wanted.agg(F.min(F.length("digits"))).first()[0] or 1
    some_digits = rf"(?:\p{{Nd}}\P{{Nd}}*+){{{max(least, 1)}}}"  # a cell with fewer holds none of them
    for table in dict.fromkeys(d.table for _, d in places):
        own = [(k, d) for k, d in places if d.table == table]
        order = F.create_map(*(x for k, d in own for x in (F.lit(d.column), F.struct(F.lit(d.tag != "DIRECT_ID").alias("other"), F.lit(k).alias("place"), F.lit(f"{table}.{d.column}").alias("label")))))
        values = cells(tables[table], [d.column for _, d in own]).filter(F.col("value").rlike(some_digits))
        part = values.select(digits_only(F.col("value")).alias("digits"), order[F.col("column")].alias("at")).filter("digits <> ''")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return wanted.select("digits", F.lit(True).alias("is_id"), F.lit("").alias("label")).limit(0)
    hits = out.join(wanted.distinct(), "digits", "left_semi").groupBy("digits").agg(F.min("at").alias("at"))
    return hits.select("digits", (~F.col("at.other")).alias("is_id"), F.col("at.label").alias("label"))


def _decisions(low: DataFrame, decisions: dict | None) -> tuple[DataFrame, DataFrame]:
    """What people decided, by group and by value; as many rows as they made decisions."""
    decisions, spark = decisions or {}, low.sparkSession
    by_group = [(k, v) for k, v in (decisions.get("groups") or {}).items()]
    by_value = [(k, at, v) for k, values in (decisions.get("values") or {}).items() for at, v in values.items()]
    return spark.createDataFrame(by_group, "key string, by_group string"), spark.createDataFrame(by_value, "key string, at string, by_value string")


def resolve(tables: dict[str, DataFrame], spans: DataFrame, detections: list[Detection], decisions: dict | None = None, least: float = 0.0) -> DataFrame:
    """Each uncertain span with auto, code, label, admin, final and by.

    A person's decision on a value stands above one on its group, that above the automatic one; else it is pending.
    A value that an identity column holds is replaced, one that only another column holds is kept.
    decisions: {"groups": {key: "keep" | "replace"}, "values": {key: {"row:start": "keep" | "replace"}}}.
    """
    columns = [(r["table"], r["column"]) for r in spans.select("table", "column").distinct().collect()]  # a row for each text column
    columns = sorted(columns) or [(d.table, d.column) for d in detections][:1]
    low = written(uncertain(tables, spans, columns, least), "uncertain")  # it is read for its groups, its digits and itself
    return settle(with_auto(tables, low, detections, columns), decisions)


def with_auto(tables: dict[str, DataFrame], low: DataFrame, detections: list[Detection], columns: list[tuple[str, str]]) -> DataFrame:
    judged = groups(tables, low, columns).select("key", F.col("auto").alias("group_auto"), "suggestion", F.col("code").alias("group_code"), "population", "passed")
    held = cross_check(tables, detections, low.select("digits"))
    out = low.join(judged, "key").join(held, "digits", "left")
    seen = F.col("is_id").isNotNull()
    auto = F.when(seen, F.when(F.col("is_id"), "replace").otherwise("keep")).otherwise(F.col("group_auto"))
    code = F.when(seen, F.when(F.col("is_id"), "matches_id_column").otherwise("matches_reference_column")).otherwise(F.col("group_code"))
    return out.withColumns({"auto": auto, "code": code}).drop("group_auto", "group_code", "is_id", "digits")


def settle(automatic: DataFrame, decisions: dict | None) -> DataFrame:
    """Apply people's decisions to spans that carry `auto`; needs no text, so it also refreshes stored ones."""
    by_group, by_value = _decisions(automatic, decisions)
    at = F.concat_ws(":", F.col(ROW).cast("string"), F.col("start").cast("string"))
    out = automatic.drop("admin", "final", "by").withColumn("at", at)
    # a person makes few decisions: the spans, of which a group may hold very many, stay where they are
    out = out.join(F.broadcast(by_group), "key", "left").join(F.broadcast(by_value), ["key", "at"], "left")
    out = out.withColumn("admin", F.coalesce("by_value", "by_group"))
    final = F.coalesce("admin", "auto", F.lit("pending"))
    by = F.when(F.col("admin").isNotNull(), "admin").when(F.col("auto").isNotNull(), "auto").otherwise("pending")
    return out.withColumns({"final": final, "by": by}).drop("at", "by_group", "by_value")


def totals(settled: DataFrame) -> DataFrame:
    """One row: auto, admin, pending, replace, keep."""
    by = [F.count_if(F.col("by") == x).alias(x) for x in ("auto", "admin", "pending")]
    return settled.agg(*by, *(F.count_if(F.col("final") == x).alias(x) for x in ("replace", "keep")))


def group_summary(settled: DataFrame) -> DataFrame:
    """A row for each group without any value: counts, suggestion, and what its spans come to ("mixed" if they differ)."""
    finals = F.collect_set("final")
    return settled.groupBy("key", "table", "column", "kind", "phrase").agg(
        F.count(F.lit(1)).alias("count"), F.max("population").alias("population"), F.max("passed").alias("passed"), F.max("suggestion").alias("suggestion"),
        F.when(F.size(finals) == 1, finals[0]).otherwise("mixed").alias("final"), F.count_if(F.col("final") == "pending").alias("pending"),
    )


def decide_group(decisions: dict, key: str, choice: str | None) -> dict:
    """decisions with one on a group, which clears those on its values; None takes it back."""
    groups_, values = dict(decisions.get("groups") or {}), {k: v for k, v in (decisions.get("values") or {}).items() if k != key}
    groups_.pop(key, None)
    return {"groups": groups_ | ({key: choice} if choice else {}), "values": values}


def accept_suggestions(decisions: dict, pending: list[tuple[str, str]]) -> dict:
    """decisions with the suggestion of each (key, suggestion) that waits."""
    for key, suggestion in pending:
        decisions = decide_group(decisions, key, suggestion)
    return decisions


def carried_over(decisions: dict) -> dict:
    """What stays of decisions when a table is cleaned anew: those on groups, as places move."""
    return {"groups": dict(decisions.get("groups") or {}), "values": {}}


def partition_spans(spans: DataFrame, settled: DataFrame, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """(spans to replace, spans that wait): the sure ones and those that were decided so; least sure ones are left."""
    sure = spans.filter(F.col("conf") >= max(min_confidence, REVIEW_BELOW))
    place = [*CELL, "start"]
    chosen = spans.join(settled.filter("final = 'replace'").select(*place), place, "left_semi")
    waiting = spans.join(settled.filter("final = 'pending'").select(*place), place, "left_semi")
    return sure.unionByName(chosen), waiting
