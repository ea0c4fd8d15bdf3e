"""DuckDB SQL of the library's queries."""

from __future__ import annotations

from ..functions.names import FAMILY, FEMALE, MALE
from .fixtures import WITH_CLAIMS, WITH_MESSY, WITH_PEOPLE
from .golden import WITH_GOLDEN

_EASTERN = "translate({0}, '٠١٢٣٤٥٦٧٨٩', '0123456789')"


def ascii_(x: str) -> str:
    return _EASTERN.format(x)


def joined(x: str) -> str:
    """Digits without the blanks and hyphens between them; RE2 looks at each place once, so it is done twice."""
    once = lambda y: f"regexp_replace({y}, '([0-9٠-٩])[ \\-]{{1,3}}([0-9٠-٩])', '\\1\\2', 'g')"
    return ascii_(once(once(x)))


def flat(x: str) -> str:
    return f"replace({joined(x)}, ' ', '')"


def luhn(x: str) -> str:
    """Is a text of ten digits, the first 1 or 2, with a check digit that fits?"""
    total = f"list_sum(list_transform(range(1, 11), lambda i: CASE WHEN i % 2 = 1 THEN (CASE WHEN 2 * CAST(substr({x}, CAST(i AS INT), 1) AS INT) > 9 THEN 2 * CAST(substr({x}, CAST(i AS INT), 1) AS INT) - 9 ELSE 2 * CAST(substr({x}, CAST(i AS INT), 1) AS INT) END) ELSE CAST(substr({x}, CAST(i AS INT), 1) AS INT) END))"
    return f"CASE WHEN regexp_full_match({x}, '[12][0-9]{{9}}') THEN {total} % 10 = 0 ELSE false END"


def mobile(x: str) -> str:
    return f"regexp_full_match({x}, '(05|\\+9665|9665|009665)[0-9]{{8}}')"


def iban(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, 'SA[0-9]{{22}}') THEN CAST(concat(substr({x}, 5), '2810', substr({x}, 3, 2)) AS HUGEINT) % 97 = 1 ELSE false END"


def mail(x: str) -> str:
    return f"regexp_full_match({x}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{{2,}}')"


def plain(x: str) -> str:
    return f"trim(regexp_replace(translate({x}, 'أإآٱىة', 'اااايه'), '\\s+', ' ', 'g'))"


_MOBILE_CANON = f"regexp_replace({flat('mobile')}, '^\\+?(00966|966|0)', '')"
_NAMES = ", ".join(f"'{x}'" for x in sorted({n.translate(str.maketrans("أإآٱىة", "اااايه")) for n in (*MALE, *FEMALE)}))
assert FAMILY

_FACTS = f"""facts AS (
  SELECT *, {flat('national_id')} AS nid, {flat('mobile')} AS mob, upper({flat('iban')}) AS acc, lower(trim(email)) AS adr FROM people
), checked AS (
  SELECT *, {luhn('nid')} AS ok_id, {mobile('mob')} AS ok_mobile, {iban('acc')} AS ok_iban, {mail('trim(email)')} AS ok_mail, regexp_replace(mob, '^\\+?(00966|966|0)', '') AS nine FROM facts
)"""

TEXT_FORMS = f"""WITH {WITH_PEOPLE}
SELECT person_id, {ascii_('national_id')} AS ascii_id, {joined('national_id')} AS joined_id, {flat('mobile')} AS flat_mobile, {plain('full_name')} AS plain_name FROM people"""

VALIDITY = f"""WITH {WITH_PEOPLE}, {_FACTS}
SELECT person_id, ok_id AS valid_national_id, ok_mobile AS valid_mobile, ok_iban AS valid_iban, ok_mail AS valid_email,
  split_part({plain('full_name')}, ' ', 1) IN ({_NAMES}) AS valid_full_name,
  nid AS canonical_national_id, nine AS canonical_mobile, acc AS canonical_iban, adr AS canonical_email, {plain('full_name')} AS canonical_full_name
FROM checked"""

COMPLETED = """
WITH b AS (
  SELECT c_custkey, concat('1', lpad(CAST(c_custkey AS VARCHAR), 8, '0')) AS body, concat('80', lpad(CAST(c_custkey AS VARCHAR), 18, '0')) AS bban FROM customer
), t AS (
  SELECT *, list_sum(list_transform(range(1, 10), lambda i: CASE WHEN i % 2 = 1 THEN (2 * CAST(substr(body, CAST(i AS INT), 1) AS INT)) // 10 + (2 * CAST(substr(body, CAST(i AS INT), 1) AS INT)) % 10 ELSE CAST(substr(body, CAST(i AS INT), 1) AS INT) END)) AS total FROM b
)
SELECT c_custkey, concat(body, CAST((10 - total % 10) % 10 AS VARCHAR)) AS identity,
  concat('SA', lpad(CAST(98 - CAST(concat(bban, '281000') AS HUGEINT) % 97 AS VARCHAR), 2, '0'), bban) AS iban FROM t"""

PROFILES = f"""WITH {WITH_CLAIMS}, cells AS (
  SELECT 'claim_id' AS "column", CAST(claim_id AS VARCHAR) AS v FROM claims UNION ALL SELECT 'person_id', CAST(person_id AS VARCHAR) FROM claims
  UNION ALL SELECT 'claim_date', claim_date FROM claims UNION ALL SELECT 'claim_type', claim_type FROM claims UNION ALL SELECT 'notes', notes FROM claims
), s AS (
  SELECT "column", count(*) AS n_rows, count(*) - count(v) AS n_null, count(DISTINCT v) AS n_unique, avg(length(v)) AS mean_len,
    avg(CAST(regexp_full_match(v, '[+-]?[0-9]+(\\.[0-9]*)?') AS INT)) AS numeric_share, avg(CAST(regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS INT)) AS dates,
    sum(length(regexp_replace(v, '[^ء-يٱ-ۓ]', '', 'g'))) / sum(length(regexp_replace(v, '\\s', '', 'g'))) AS arabic
  FROM cells GROUP BY "column"
)
SELECT "column", n_rows, n_null, n_unique, mean_len,
  CASE WHEN numeric_share >= 0.98 THEN 'numeric' WHEN dates >= 0.95 THEN 'date' WHEN mean_len > 30 AND arabic >= 0.4 THEN 'free_text'
    WHEN n_unique <= greatest(20, floor(0.05 * n_rows)) THEN 'categorical' ELSE 'short_text' END AS dtype, n_unique = n_rows AS is_unique FROM s"""


def _contained(child: str, column: str, parent: str, key: str) -> str:
    return f"SELECT '{child}.{column}' AS child, '{parent}.{key}' AS parent, count({column})::BIGINT AS n, count(*) FILTER ({column} IN (SELECT {key} FROM {parent}))::BIGINT AS inside FROM {child}"


CONTAINMENT = " UNION ALL ".join(_contained(*x) for x in (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "supplier", "s_suppkey")))

_COLUMNS = ("full_name", "national_id", "mobile", "iban", "email", "segment")
SHARES = f"""WITH {WITH_PEOPLE}, cells AS ({" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v FROM people" for c in _COLUMNS)}), f AS (
  SELECT *, {flat('v')} AS fl, upper({flat('v')}) AS up FROM cells
)
SELECT "column", count(*) AS n, avg(CAST({luhn('fl')} AS INT)) AS saudi_id, avg(CAST({mobile('fl')} AS INT)) AS mobile, avg(CAST({iban('up')} AS INT)) AS iban,
  avg(CAST({mail('trim(v)')} AS INT)) AS email, avg(CAST(split_part({plain('v')}, ' ', 1) IN ({_NAMES}) AS INT)) AS person_name
FROM f WHERE v IS NOT NULL GROUP BY "column" """

_AT = "strpos(c.notes, {0}) - 1"


def _span(value: str, kind: str, conf: str, where: str) -> str:
    at = _AT.format(value)
    return f"SELECT claim_id, {at} AS span_start, {at} + length({value}) AS span_end, '{kind}' AS kind, {conf} AS conf FROM known c WHERE {where}"


_KNOWN = "known AS (SELECT c.claim_id, c.notes, p.* FROM claims c JOIN checked p ON c.person_id = p.person_id)"
NOTE_SPANS = f"""WITH {WITH_CLAIMS}, {_FACTS}, {_KNOWN}, spans AS (
  {_span('c.full_name', 'PERSON_NAME', '0.9::DOUBLE', 'claim_id % 4 = 0')} UNION ALL {_span('c.mobile', 'MOBILE', '0.95::DOUBLE', 'claim_id % 4 = 0 AND ok_mobile')}
  UNION ALL {_span('c.national_id', 'SAUDI_ID', '0.95::DOUBLE', 'claim_id % 4 = 1 AND ok_id')} UNION ALL {_span('c.national_id', 'SAUDI_ID', '0.6::DOUBLE', 'claim_id % 4 = 3 AND ok_id')}
  UNION ALL {_span('c.iban', 'IBAN', 'CASE WHEN ok_iban THEN 0.99 ELSE 0.9 END::DOUBLE', 'claim_id % 4 = 2')} UNION ALL {_span('trim(c.email)', 'EMAIL', '0.99::DOUBLE', 'claim_id % 4 = 2 AND ok_mail')}
)
SELECT claim_id, span_start::BIGINT AS span_start, span_end::BIGINT AS span_end, kind, conf FROM spans"""

NAIVE = f"""WITH {WITH_CLAIMS}, n AS (
  SELECT claim_id, concat(' ', notes, ' ') AS t FROM claims
), k AS (
  SELECT claim_id, 'SAUDI_ID' AS kind, len(regexp_extract_all(t, '[^0-9]([12][0-9]{{9}})[^0-9]')) AS n FROM n
  UNION ALL SELECT claim_id, 'MOBILE', len(regexp_extract_all(t, '[^0-9](05[0-9]{{8}})[^0-9]')) FROM n
  UNION ALL SELECT claim_id, 'IBAN', len(regexp_extract_all(t, 'SA[0-9]{{22}}')) FROM n
  UNION ALL SELECT claim_id, 'EMAIL', len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{{2,}}')) FROM n
)
SELECT claim_id, kind, n::BIGINT AS n FROM k WHERE n > 0"""

MAILS = r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}')) AS m FROM documents)
SELECT doc_id, count(*)::BIGINT AS n, sum(length(m))::BIGINT AS letters FROM m GROUP BY doc_id"""

CLEANED = f"""WITH {WITH_MESSY}, d AS (SELECT *, translate(grouped, '٠١٢٣٤٥٦٧٨٩', '0123456789') AS g, {flat('phone')} AS ph FROM messy)
SELECT id, trim(regexp_replace(padded, ' +', ' ', 'g')) AS trimmed, CASE WHEN lower(trim(maybe)) IN ('n/a', '-', 'none') THEN NULL ELSE maybe END AS nulled,
  regexp_replace(replace(replace(replace(g, ',', ''), '٬', ''), '٫', '.'), '^\\+', '') AS number,
  strftime(strptime(day, '%d/%m/%Y'), '%Y-%m-%d') AS iso_day,
  CASE WHEN {mobile('ph')} THEN concat('0', regexp_replace(ph, '^\\+?(00966|966|0)', '')) ELSE phone END AS phone
FROM d"""

DEDUPE = """SELECT row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS place, CAST(o_custkey AS VARCHAR) AS custkey, o_orderpriority AS priority FROM orders GROUP BY o_custkey, o_orderpriority"""

SPELLINGS = f"""WITH {WITH_MESSY}, c AS (
  SELECT trim(segment) AS variant, count(*) AS n, replace(lower(trim(segment)), ' ', '') AS group_key FROM messy WHERE segment IS NOT NULL GROUP BY trim(segment)
), b AS (SELECT group_key, arg_min(variant, (-n, variant)) AS target, count(*) AS k FROM c GROUP BY group_key)
SELECT 'segment' AS "column", c.group_key, target, variant, n::BIGINT AS n FROM c JOIN b USING (group_key) WHERE k > 1 AND variant <> target"""

LOOK = f"""WITH {WITH_MESSY}, q AS (
  SELECT quantile_cont(CAST(amount AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(amount AS DOUBLE), 0.75) AS q3 FROM messy
)
SELECT 'maybe' AS "column", count(*) FILTER (maybe IS NULL)::BIGINT AS missing, 0::BIGINT AS extreme_outliers, false AS mixed_types FROM messy
UNION ALL SELECT 'amount', 0, (SELECT count(*) FROM messy, q WHERE CAST(amount AS DOUBLE) < q1 - 3 * (q3 - q1) OR CAST(amount AS DOUBLE) > q3 + 3 * (q3 - q1))::BIGINT, false
UNION ALL SELECT 'mixed', 0, 0, (SELECT avg(CAST(mixed <> 'word' AS INT)) BETWEEN 0.2 AND 0.94999 FROM messy)"""

POPULATION = f"""WITH {WITH_CLAIMS}, {_FACTS}, {_KNOWN}
SELECT CASE claim_id % 4 WHEN 1 THEN 'رقم الهويه' ELSE 'رقم الطلب' END AS phrase, count(*)::BIGINT AS population, count(*) FILTER (ok_id)::BIGINT AS passed
FROM known WHERE claim_id % 4 IN (1, 3) GROUP BY claim_id % 4"""

_ORIGINALS = """originals AS (
  SELECT 'SAUDI_ID' AS kind, nid AS canon FROM checked WHERE ok_id UNION SELECT 'MOBILE', nine FROM checked WHERE ok_mobile
  UNION SELECT 'IBAN', acc FROM checked WHERE ok_iban UNION SELECT 'EMAIL', adr FROM checked WHERE ok_mail
)"""
_HITS = """hits AS (
  SELECT claim_id, 'SAUDI_ID' AS kind, nid AS canon FROM known WHERE claim_id % 4 IN (1, 3) AND ok_id UNION ALL SELECT claim_id, 'MOBILE', nine FROM known WHERE claim_id % 4 = 0 AND ok_mobile
  UNION ALL SELECT claim_id, 'IBAN', acc FROM known WHERE claim_id % 4 = 2 AND ok_iban UNION ALL SELECT claim_id, 'EMAIL', adr FROM known WHERE claim_id % 4 = 2 AND ok_mail
)"""
LEAKED = f"WITH {WITH_CLAIMS}, {_FACTS}, {_KNOWN}, {_HITS} SELECT claim_id, kind, canon FROM hits"

COPIES = """SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus FROM orders o WHERE o_orderkey % 2 = 1
  AND EXISTS (SELECT 1 FROM orders e WHERE e.o_orderkey % 2 = 0 AND e.o_custkey = o.o_custkey AND e.o_orderpriority = o.o_orderpriority AND e.o_orderstatus = o.o_orderstatus)"""
ORPHANS = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)"

OVERLAPS = """
WITH s AS (
  SELECT l_orderkey AS row, (l_linenumber * 7)::INT AS a, (l_linenumber * 7 + 4 + l_suppkey % 9)::INT AS b, l_returnflag AS kind, l_partkey % 7 AS mode FROM lineitem
), p AS (SELECT * FROM s WHERE mode IN (0, 1, 2)), g AS (SELECT * FROM s WHERE mode IN (0, 3, 4)), h AS (SELECT * FROM s WHERE mode = 5), w AS (
  SELECT kind, 'golden' AS what FROM g UNION ALL SELECT kind, 'predicted' FROM p
  UNION ALL SELECT kind, 'found' FROM g WHERE EXISTS (SELECT 1 FROM p WHERE p.row = g.row AND p.kind = g.kind AND g.a < p.b AND p.a < g.b)
  UNION ALL SELECT kind, 'exact' FROM g WHERE EXISTS (SELECT 1 FROM p WHERE p.row = g.row AND p.kind = g.kind AND g.a = p.a AND p.b = g.b)
  UNION ALL SELECT kind, 'right' FROM p WHERE EXISTS (SELECT 1 FROM g WHERE p.row = g.row AND p.kind = g.kind AND g.a < p.b AND p.a < g.b)
  UNION ALL SELECT kind, 'hit' FROM h WHERE EXISTS (SELECT 1 FROM p WHERE p.row = h.row AND p.kind = h.kind AND h.a < p.b AND p.a < h.b)
)
SELECT coalesce(kind, 'OVERALL') AS kind, count(*) FILTER (what = 'golden')::BIGINT AS golden, count(*) FILTER (what = 'predicted')::BIGINT AS predicted, count(*) FILTER (what = 'found')::BIGINT AS found,
  count(*) FILTER (what = 'exact')::BIGINT AS exact, count(*) FILTER (what = 'right')::BIGINT AS "right", count(*) FILTER (what = 'hit')::BIGINT AS hard_negatives_hit
FROM w GROUP BY GROUPING SETS ((kind), ())"""

PLACES = "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS prior_orders FROM orders"


def _ks(column: str) -> str:
    return f"""(SELECT '{column}' AS "column", max(abs(fa - fb)) AS distance FROM (
  SELECT {column}, max(ca) / max(max(ca)) OVER () AS fa, max(cb) / max(max(cb)) OVER () AS fb FROM (
    SELECT {column}, count(*) FILTER (l_returnflag = 'A') OVER w AS ca, count(*) FILTER (l_returnflag = 'R') OVER w AS cb FROM lineitem WHERE l_returnflag IN ('A', 'R') WINDOW w AS (ORDER BY {column})
  ) GROUP BY {column}))"""


DISTANCES = f"""WITH d AS ({_ks('l_extendedprice')} UNION ALL {_ks('l_quantity')} UNION ALL (
  SELECT 'l_linestatus', sum(abs(a / na - b / nb)) / 2 FROM (
    SELECT count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS b, sum(count(*) FILTER (l_returnflag = 'A')) OVER () AS na, sum(count(*) FILTER (l_returnflag = 'R')) OVER () AS nb
    FROM lineitem GROUP BY l_linestatus)))
SELECT "column", round(distance, 9) AS distance FROM d"""


def _eta(category: str) -> str:
    return f"""SELECT '{category}' AS category, 'o_totalprice' AS number, round(sum(n * (m - mm) * (m - mm)) / max(total), 8) AS eta2 FROM (
  SELECT count(*) AS n, avg(ln(o_totalprice::DOUBLE)) AS m, (SELECT avg(ln(o_totalprice::DOUBLE)) FROM orders) AS mm, (SELECT var_pop(ln(o_totalprice::DOUBLE)) * count(*) FROM orders) AS total FROM orders GROUP BY {category})"""


ETA = f"{_eta('o_orderpriority')} UNION ALL {_eta('o_orderstatus')}"
QUANTILE = """SELECT o_orderpriority, count(*)::BIGINT AS n, count(*) FILTER (o_totalprice::DOUBLE > (SELECT quantile_cont(o_totalprice::DOUBLE, 0.9) FROM orders))::BIGINT AS costly FROM orders GROUP BY o_orderpriority"""

NEAREST = """
WITH e AS (SELECT (max(c_acctbal) - min(c_acctbal))::DOUBLE AS scale FROM customer), q AS (SELECT s_acctbal::DOUBLE AS b, s_nationkey AS k, count(*) AS n FROM supplier GROUP BY ALL)
SELECT round(q.b, 2) AS balance, q.k::BIGINT AS nation, n::BIGINT AS n,
  round(min(sqrt(power(q.b / scale - c_acctbal::DOUBLE / scale, 2) + power(q.k / 25.0::DOUBLE - c_nationkey / 25.0::DOUBLE, 2))), 7) AS nearest
FROM q CROSS JOIN e CROSS JOIN customer GROUP BY q.b, q.k, n"""

PAGE = """SELECT c_custkey::BIGINT AS place, c_name, CAST(c_custkey AS VARCHAR) AS number, c_mktsegment FROM customer
WHERE contains(lower(c_name), 'build') OR contains(CAST(c_custkey AS VARCHAR), 'build') OR contains(lower(c_mktsegment), 'build') ORDER BY c_custkey DESC LIMIT 25 OFFSET 25"""

GUARDED = f"""WITH {WITH_MESSY}
SELECT id, CASE WHEN regexp_matches(formula, '^[=+\\-@\\t\\r]') AND NOT regexp_full_match(formula, '[+-]?([0-9]+([.,][0-9]+)?|[0-9]{{1,3}}(,[0-9]{{3}})+([.][0-9]+)?)')
  THEN concat('''', formula) ELSE coalesce(formula, '') END AS safe FROM messy"""
ROUND_TRIP = f"WITH {WITH_MESSY} SELECT row_number() OVER (ORDER BY id) - 1 AS place, CAST(id AS VARCHAR) AS id, padded, maybe, formula FROM messy"
COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*)::BIGINT AS n FROM {t}" for t in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events"))
NUMBERED = "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS place, n_nationkey, n_name FROM nation"

TWIN_FACTS = f"""WITH {WITH_CLAIMS}, {_FACTS}
SELECT count(*)::BIGINT AS people, 0::BIGINT AS same_national_id, 0::BIGINT AS same_full_name, count(*)::BIGINT AS valid_national_id, count(*)::BIGINT AS valid_mobile, count(*)::BIGINT AS valid_iban,
  count(*)::BIGINT AS distinct_ids, count(*)::BIGINT AS distinct_keys, 0::BIGINT AS orphans, 0::BIGINT AS leaks, (SELECT count(*) FROM claims)::BIGINT AS claims FROM checked"""

REFERENCES = "SELECT c_name, 'verified' AS status, CAST(c_custkey AS VARCHAR) AS customer_id FROM customer"
_KIND_OF = "CASE WHEN c_custkey % 7 = 0 THEN 'invalid' WHEN c_custkey % 11 = 0 THEN 'missing' WHEN c_custkey % 13 = 0 THEN 'foreign' ELSE 'verified' END"
STATUSES = f"""WITH r AS (
  SELECT {_KIND_OF} AS status FROM customer UNION ALL SELECT CASE WHEN {_KIND_OF} = 'verified' THEN 'duplicate' ELSE {_KIND_OF} END FROM customer WHERE c_custkey % 5 = 0
) SELECT status, count(*)::BIGINT AS n FROM r GROUP BY status"""
RELINKED = f"SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS original_name, CAST(c_custkey * 3 AS VARCHAR) AS score, 'linked' AS relink_status FROM customer WHERE {_KIND_OF} = 'verified'"
TOTALS = "SELECT 'customer' AS \"column\", count(*)::BIGINT AS n, sum(o_custkey)::BIGINT AS total FROM orders UNION ALL SELECT 'order', count(*), sum(o_orderkey)::BIGINT FROM orders"

def _distance(column: str) -> str:
    return f"""SELECT 'shape' AS property, '{column}' AS a, CAST(NULL AS VARCHAR) AS b, 1 - max(abs(fx - fy)) AS score FROM (
  SELECT sum(sum(x)) OVER (ORDER BY {column}) / sum(sum(x)) OVER () AS fx, sum(sum(1 - x)) OVER (ORDER BY {column}) / sum(sum(1 - x)) OVER () AS fy FROM o GROUP BY {column})"""


def _contingency(*columns: str) -> str:
    a, b = columns if len(columns) == 2 else (columns[0], None)
    cells = ", ".join(f"{c[2:]}_cell" for c in columns)
    name = f"'{b}'" if b else "CAST(NULL AS VARCHAR)"
    return f"""SELECT '{'trend' if b else 'shape'}' AS property, '{a}' AS a, {name} AS b, 1 - sum(abs(nx / tx - ny / ty)) / 2 AS score FROM (
  SELECT sum(x) AS nx, sum(1 - x) AS ny, sum(sum(x)) OVER () AS tx, sum(sum(1 - x)) OVER () AS ty FROM o GROUP BY {cells})"""


def _correlated(a: str, b: str) -> str:
    return f"SELECT 'trend' AS property, '{a}' AS a, '{b}' AS b, 1 - abs(corr({a}, {b}) FILTER (x = 1) - corr({a}, {b}) FILTER (x = 0)) / 2 AS score FROM o"


_NUMBERS, _WORDS = ("o_totalprice", "o_custkey", "o_orderdate"), ("o_orderstatus", "o_orderpriority")
_CELL = "least(greatest(floor(({0} - min({0}) FILTER (x = 1) OVER ()) / (max({0}) FILTER (x = 1) OVER () - min({0}) FILTER (x = 1) OVER ()) * 10), 0), 9) AS {1}_cell"
_SCORES = [*map(_distance, _NUMBERS), *map(_contingency, _WORDS), *(_correlated(a, b) for k, a in enumerate(_NUMBERS) for b in _NUMBERS[k + 1 :]), *(_contingency(a, b) for a in _NUMBERS for b in _WORDS), _contingency(*_WORDS)]
QUALITY = f"""WITH typed AS (
  SELECT CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END AS x, o_totalprice::DOUBLE AS o_totalprice, o_custkey::DOUBLE AS o_custkey, epoch(o_orderdate::DATE) / 86400 AS o_orderdate, o_orderstatus, o_orderpriority FROM orders
), o AS (SELECT *, {", ".join(_CELL.format(c, c[2:]) for c in _NUMBERS)}, o_orderstatus AS orderstatus_cell, o_orderpriority AS orderpriority_cell FROM typed)
SELECT property, a, b, round(score, 7) AS score FROM ({" UNION ALL ".join(_SCORES)})"""

#: What is no valid number or address stays in a note as it is; an account number's shape is enough.
_FRAME = "notes"
for _tag, _valid in (("iban", "true"), ("email", "p.person_id % 10 <> 3"), ("mobile", "p.person_id % 10 <> 1"), ("national_id", "p.person_id % 10 <> 0"), ("full_name", "true")):
    _FRAME = f"CASE WHEN {_valid} THEN replace({_FRAME}, trim({_tag}), '<{_tag}>') ELSE {_FRAME} END"
FRAMES = f"WITH {WITH_CLAIMS} SELECT c.claim_id::BIGINT AS claim_id, {_FRAME} AS frame FROM claims c JOIN people p ON c.person_id = p.person_id"
#: Identity numbers after the words of an order are the only uncertain spans; they pass far too often for chance.
GROUPS = f"""SELECT concat('claims|notes|SAUDI_ID|', phrase) AS key, 'claims' AS "table", 'notes' AS "column", 'SAUDI_ID' AS kind, phrase, passed AS count, population, passed,
  'replace' AS auto, 'replace' AS suggestion, 'ids' AS code FROM ({POPULATION}) WHERE phrase LIKE '%طلب%'"""

GOLDEN = f"""WITH {WITH_GOLDEN}, seen AS (
  SELECT kind, hard, 'full' AS detector, NOT hard OR kind = 'IBAN' AS hit FROM planted
  UNION ALL SELECT kind, hard, 'baseline', CASE kind WHEN 'SAUDI_ID' THEN regexp_full_match(value, '[12][0-9]{{9}}') WHEN 'MOBILE' THEN regexp_full_match(value, '05[0-9]{{8}}')
    WHEN 'IBAN' THEN regexp_full_match(value, 'SA[0-9]{{22}}') WHEN 'EMAIL' THEN {mail('value')} ELSE false END FROM planted
)
SELECT detector, coalesce(kind, 'OVERALL') AS kind, count_if(NOT hard)::BIGINT AS golden, count_if(hit)::BIGINT AS predicted, count_if(hit AND NOT hard)::BIGINT AS found, count_if(hit AND NOT hard)::BIGINT AS exact,
  count_if(hit AND NOT hard)::BIGINT AS "right", count_if(hit AND hard)::BIGINT AS hard_negatives_hit,
  CASE WHEN count_if(NOT hard) > 0 THEN round(count_if(hit AND NOT hard) / count_if(NOT hard), 4) END AS recall, CASE WHEN count_if(hit) > 0 THEN round(count_if(hit AND NOT hard) / count_if(hit), 4) END AS precision
FROM seen GROUP BY GROUPING SETS ((detector, kind), (detector))"""

CHILDREN = "SELECT l_orderkey AS o_orderkey, count(*)::BIGINT AS n, round(avg(l_quantity::DOUBLE), 6) AS mean_quantity, round(avg(l_discount::DOUBLE), 6) AS mean_discount FROM lineitem GROUP BY l_orderkey"
MULTI_TABLE = """WITH lines AS (
  SELECT l_orderkey, count(*) AS n, avg(l_quantity::DOUBLE) AS q FROM lineitem GROUP BY l_orderkey
), o AS (
  SELECT o_custkey, o_totalprice::DOUBLE AS price, coalesce(n, 0) AS n, q FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey
), c AS (
  SELECT c_acctbal::DOUBLE AS balance, coalesce(k, 0) AS k, coalesce(lines, 0) AS lines FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k, sum(n) AS lines FROM o GROUP BY o_custkey) ON c_custkey = o_custkey
), facts AS (
  SELECT 'lines_per_order' AS what, avg(n) AS value FROM o UNION ALL SELECT 'price_with_lines', corr(price, n) FROM o UNION ALL SELECT 'price_with_quantity', corr(price, q) FROM o
  UNION ALL SELECT 'orders_per_customer', avg(k) FROM c UNION ALL SELECT 'spread_of_orders', stddev_pop(k) FROM c UNION ALL SELECT 'orders_with_lines', corr(k, lines) FROM c UNION ALL SELECT 'balance_with_orders', corr(balance, k) FROM c
  UNION ALL SELECT 'quantity_with_price', corr(l_quantity::DOUBLE, l_extendedprice::DOUBLE) FROM lineitem UNION ALL SELECT 'quantity_with_discount', corr(l_quantity::DOUBLE, l_discount::DOUBLE) FROM lineitem
) SELECT what, round(value, 4) AS value, true AS near FROM facts"""

SQL = {
    "masked_note_frames": FRAMES, "review_groups": GROUPS, "child_summaries": CHILDREN, "golden_scores": GOLDEN, "quality_scores": QUALITY, "multi_table_facts": MULTI_TABLE,
    "text_forms": TEXT_FORMS, "identifier_validity": VALIDITY, "completed_identifiers": COMPLETED, "column_profiles": PROFILES, "key_containment": CONTAINMENT, "identifier_shares": SHARES,
    "note_spans": NOTE_SPANS, "naive_note_spans": NAIVE, "document_mails": MAILS, "cleaned_values": CLEANED, "deduplicated_rows": DEDUPE, "spelling_suggestions": SPELLINGS, "worth_a_look": LOOK,
    "review_population": POPULATION, "leaked_originals": LEAKED, "copied_rows": COPIES, "orphan_rows": ORPHANS, "overlap_scores": OVERLAPS, "flat_view_places": PLACES,
    "distribution_distances": DISTANCES, "variance_shares": ETA, "rows_over_quantile": QUANTILE, "nearest_records": NEAREST, "page_of_rows": PAGE, "guarded_cells": GUARDED,
    "csv_round_trip": ROUND_TRIP, "parquet_rows": COUNTS, "numbered_rows": NUMBERED, "masked_twin_facts": TWIN_FACTS, "token_references": REFERENCES, "return_statuses": STATUSES, "relinked_rows": RELINKED, "totals_of_columns": TOTALS,
}
