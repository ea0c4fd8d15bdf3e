"""Golden notes: texts generated from the test tables by rule, of which every planted identifier and look-alike is known, and how
detectors fare on them.

A template is a row of words and slots; a slot's place is the sum of the lengths before it, so that spans are golden by
construction.  Which template a row gets is drawn from WEIGHTS by inverse transform of a number that its key gives, so that
reruns agree on any partitioning.  The text of the statements runs in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scans
from ..operators.detection import text_spans
from ..operators.tables import ROW, written
from . import fixtures

#: Slots: what is planted, as which kind, and by which rule of the people it is no valid one (see fixtures.PEOPLE).
SLOTS = {
    "name": ("full_name", "PERSON_NAME", "false"), "id": ("national_id", "SAUDI_ID", "person_id % 10 = 0"), "mobile": ("mobile", "MOBILE", "person_id % 10 = 1"),
    "iban": ("iban", "IBAN", "person_id % 10 = 2"), "mail": ("trim(email)", "EMAIL", "person_id % 10 = 3"), "invoice": ("invoice", "SAUDI_ID", "true"),
}
# The templates of this library's golden notes; a name in braces is a slot.
TEMPLATES = (
    ("تواصل العميل ", "{name}", " على الرقم ", "{mobile}", " بخصوص المطالبة"),
    ("رقم الهوية ", "{id}", " مسجل لدى الفرع"),
    ("تحويل إلى حساب ", "{iban}", " وإشعار على ", "{mail}"),
    ("فاتورة رقم ", "{invoice}", " قيد المراجعة والمتابعة من القسم"),
    ("رقم الهوية ", "{id}", " ورقم الجوال ", "{mobile}"),
)
#: Of 100 rows so many get each template.
WEIGHTS = (30, 20, 20, 15, 15)

_BODY = "concat('1', lpad(CAST(p.person_id AS VARCHAR(20)), 8, '0'))"
#: Ten digits like an identity number's, with a check digit that is off by one.
_INVOICE = f"concat({_BODY}, CAST(({fixtures._luhn(_BODY)} + 1) % 10 AS VARCHAR(2)))"


def _pieces(template: tuple[str, ...]) -> list[str]:
    return [SLOTS[x[1:-1]][0] if x.startswith("{") else f"'{x}'" for x in template]


def _case(values: list[str]) -> str:
    return "CASE template " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


def _drawn() -> str:
    ends = [sum(WEIGHTS[: k + 1]) for k in range(len(WEIGHTS))]
    return "CASE " + " ".join(f"WHEN draw < {end} THEN {k}" for k, end in enumerate(ends)) + " END"


def _slots() -> str:
    rows = []
    for k, template in enumerate(TEMPLATES):
        pieces = _pieces(template)
        for n, x in enumerate(template):
            if x.startswith("{"):
                value, kind, hard = SLOTS[x[1:-1]]
                begin = " + ".join(f"length({p})" for p in pieces[:n]) or "0"
                rows.append(f"SELECT claim_id, '{kind}' AS kind, {value} AS value, {begin} AS begins, {begin} + length({value}) AS ends, {hard} AS hard FROM drawn WHERE template = {k}")
    return " UNION ALL ".join(rows)


#: claim_id, template, and the columns of people; then notes (claim_id, notes) and planted (claim_id, kind, value, begins, ends, hard).
DRAWN = f"SELECT *, {_drawn()} AS template FROM (SELECT o.o_orderkey AS claim_id, (o.o_orderkey * 7919 + 17) % 100 AS draw, p.*, {_INVOICE} AS invoice FROM orders o JOIN people p ON o.o_custkey = p.person_id) d"
NOTES = f"SELECT claim_id, {_case(['concat(' + ', '.join(_pieces(t)) + ')' for t in TEMPLATES])} AS notes FROM drawn"
PLANTED = _slots()
WITH_GOLDEN = f"{fixtures.WITH_PEOPLE}, drawn AS ({DRAWN}), notes AS ({NOTES}), planted AS ({PLANTED})"


def golden(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(notes with ROW, planted spans): planted has (table, column, ROW, start, end, kind, hard)."""
    people = fixtures.people(spark, sf_dir)
    drawn = spark.sql(DRAWN.replace("FROM orders o JOIN people p", "FROM {orders} o JOIN {people} p"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"), people=people)
    drawn = written(drawn.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "golden")
    notes = spark.sql(NOTES.replace("FROM drawn", "FROM {drawn}"), drawn=drawn).select(F.col("claim_id").cast("long").alias(ROW), "notes")
    planted = spark.sql(PLANTED.replace("FROM drawn", "FROM {drawn}"), drawn=drawn)
    spans = planted.select(F.lit("claims").alias("table"), F.lit("notes").alias("column"), F.col("claim_id").cast("long").alias(ROW), F.col("begins").cast("int").alias("start"), F.col("ends").cast("int").alias("end"), "kind", "hard")
    return written(notes, "golden-notes"), written(spans, "golden-spans")


def scores(notes: DataFrame, planted: DataFrame, detectors: dict[str, bool] | None = None) -> DataFrame:
    """score_detection of each detector (name -> is it the naive one?) over the same golden spans."""
    out = None
    for name, naive in (detectors or {"full": False, "baseline": True}).items():
        found = written(text_spans({"claims": notes}, [("claims", "notes")], baseline=naive).select("table", "column", ROW, "start", "end", "kind"), f"found-{name}")
        part = scans.score_detection(found, planted.filter("NOT hard").drop("hard"), planted.filter("hard").drop("hard")).withColumn("detector", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
