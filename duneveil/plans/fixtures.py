"""People and claims derived from the test tables by SQL that Spark and DuckDB both run.

The test tables hold no Saudi identifiers, so customers get identity numbers, mobiles, IBANs, mail addresses and
names by rule: some in Eastern digits, some with separators, some invalid; orders become claims with notes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.tables import written

# Names given out in turn.
FIRST = ("محمد", "أحمد", "خالد", "فهد", "سارة", "نورة", "منى", "هدى", "علي", "ريم")
FAMILY = ("الغامدي", "القحطاني", "الزهراني", "العتيبي", "الشمري", "الدوسري", "المطيري")


def _luhn(body: str) -> str:
    terms = []
    for k in range(9):
        digit = f"CAST(substr({body}, {k + 1}, 1) AS INT)"
        terms.append(digit if k % 2 else f"(CASE WHEN {digit} >= 5 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)")
    return f"((10 - ({' + '.join(terms)}) % 10) % 10)"


def _one_of(values, index: str) -> str:
    return "CASE " + " ".join(f"WHEN {index} % {len(values)} = {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


_BODY = "concat(CASE WHEN c_custkey % 3 = 0 THEN '2' ELSE '1' END, lpad(CAST(c_custkey AS VARCHAR(20)), 8, '0'))"

PEOPLE = f"""
WITH base AS (
  SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, {_BODY} AS body,
    lpad(CAST((c_custkey * 7919) % 10000000 AS VARCHAR(20)), 7, '0') AS tail, concat('10', lpad(CAST(c_custkey AS VARCHAR(20)), 18, '0')) AS bban
  FROM customer
), made AS (
  SELECT *, {_luhn("body")} AS digit,
    CAST(98 - CAST(concat(bban, '281000') AS DECIMAL(38, 0)) % 97 AS INT) AS mod
  FROM base
), plain AS (
  SELECT *, concat(body, CAST(CASE WHEN c_custkey % 10 = 0 THEN (digit + 1) % 10 ELSE digit END AS VARCHAR(2))) AS nid,
    concat('05', CASE WHEN c_custkey % 10 = 1 THEN '' ELSE '5' END, tail) AS mob,
    concat(CASE WHEN c_custkey % 7 = 0 THEN 'sa' ELSE 'SA' END, lpad(CAST(CASE WHEN c_custkey % 10 = 2 THEN (mod + 1) % 97 ELSE mod END AS VARCHAR(2)), 2, '0'), bban) AS iban
  FROM made
)
SELECT c_custkey AS person_id,
  concat({_one_of(FIRST, "c_custkey")}, ' ', {_one_of(FAMILY, "c_custkey")}) AS full_name,
  CASE WHEN c_custkey % 20 = 4 THEN translate(nid, '0123456789', '٠١٢٣٤٥٦٧٨٩')
    WHEN c_custkey % 5 = 0 THEN concat(substr(nid, 1, 3), '-', substr(nid, 4, 3), ' ', substr(nid, 7, 4)) ELSE nid END AS national_id,
  CASE WHEN c_custkey % 4 = 0 THEN concat('+966', substr(mob, 2, 20)) WHEN c_custkey % 4 = 1 THEN concat('966', substr(mob, 2, 20))
    WHEN c_custkey % 4 = 2 THEN concat(substr(mob, 1, 3), ' ', substr(mob, 4, 20)) ELSE mob END AS mobile,
  iban,
  CASE WHEN c_custkey % 10 = 3 THEN concat('user', CAST(c_custkey AS VARCHAR(20)), '@@example') ELSE concat(' User', CAST(c_custkey AS VARCHAR(20)), '@example.com') END AS email,
  CAST(c_nationkey AS VARCHAR(20)) AS city, CAST(c_acctbal AS VARCHAR(40)) AS balance, c_mktsegment AS segment
FROM plain
"""

CLAIMS = """
SELECT o.o_orderkey AS claim_id, o.o_custkey AS person_id, CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR(10)) AS claim_date, o.o_orderpriority AS claim_type,
  o.o_totalprice AS amount,
  CASE o.o_orderkey % 4
    WHEN 0 THEN concat('تواصل العميل ', p.full_name, ' على الرقم ', p.mobile, ' بخصوص المطالبة')
    WHEN 1 THEN concat('رقم الهوية ', p.national_id, ' مسجل لدى الفرع')
    WHEN 2 THEN concat('تحويل إلى حساب ', p.iban, ' وإشعار على ', p.email)
    ELSE concat('رقم الطلب ', p.national_id, ' قيد المراجعة والمتابعة من القسم') END AS notes
FROM orders o JOIN people p ON o.o_custkey = p.person_id
"""

WITH_PEOPLE = f"people AS ({PEOPLE})"
WITH_CLAIMS = f"{WITH_PEOPLE}, claims AS ({CLAIMS})"


_made: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame) -> DataFrame:
    """rows written once in a session, in as many files as a shuffle has partitions, so that all cores read them."""
    at = spark.sparkContext.applicationId, sf_dir, name
    if at not in _made:
        _made[at] = written(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), name)
    return _made[at]


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person_id, full_name, national_id, mobile, iban, email, city, balance, segment)"""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return _once(spark, sf_dir, "people", spark.sql(PEOPLE.replace("FROM customer", "FROM {customer}"), customer=customer))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(claim_id, person_id, claim_date, claim_type, amount, notes)"""
    orders, owners = spark.read.parquet(f"{sf_dir}/orders.parquet"), people(spark, sf_dir)
    return _once(spark, sf_dir, "claims", spark.sql(CLAIMS.replace("FROM orders o JOIN people p", "FROM {orders} o JOIN {people} p"), orders=orders, people=owners))


#: Values as they come in uploads: padded, missing in many spellings, grouped, in day order, formulas.
MESSY = """
SELECT c_custkey AS id,
  CASE WHEN c_custkey % 2 = 0 THEN concat('  ', c_name, '   x ') ELSE c_name END AS padded,
  CASE c_custkey % 6 WHEN 0 THEN ' N/A ' WHEN 1 THEN '-' WHEN 2 THEN 'None' WHEN 3 THEN NULL ELSE c_mktsegment END AS maybe,
  CASE WHEN c_custkey % 2 = 0 THEN concat('+', CAST(c_custkey AS VARCHAR(20)), ',', '500') ELSE translate(concat(CAST(c_custkey AS VARCHAR(20)), '٫25'), '0123456789', '٠١٢٣٤٥٦٧٨٩') END AS grouped,
  concat(CAST(13 + c_custkey % 16 AS VARCHAR(4)), '/', CAST(1 + c_custkey % 12 AS VARCHAR(4)), '/', CAST(2000 + c_custkey % 24 AS VARCHAR(8))) AS day,
  CASE WHEN c_custkey % 3 = 0 THEN concat('+9665', lpad(CAST(c_custkey AS VARCHAR(20)), 8, '0')) WHEN c_custkey % 3 = 1 THEN concat('05', lpad(CAST(c_custkey AS VARCHAR(20)), 8, '0')) ELSE 'none given' END AS phone,
  CASE WHEN c_custkey % 10 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 10 = 1 THEN concat(c_mktsegment, ' ') ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 200 = 0 THEN '9000000' ELSE CAST(c_custkey % 97 AS VARCHAR(20)) END AS amount,
  CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR(20)) ELSE 'word' END AS mixed,
  CASE c_custkey % 5 WHEN 0 THEN '=1+2' WHEN 1 THEN '-12.5' WHEN 2 THEN '@name' WHEN 3 THEN '+1,000' ELSE c_name END AS formula
FROM customer
"""
WITH_MESSY = f"messy AS ({MESSY})"
