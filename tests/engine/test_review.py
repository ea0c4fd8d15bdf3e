"""Review statistics, groups, decisions; cleaning; answer keys and marked notes."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from duneveil.operators import answer_key, cleaning, review
from duneveil.operators.detection import detect_columns, text_spans
from duneveil.operators.profiling import profile
from duneveil.operators.scans import score_detection
from duneveil.operators.tables import ROW


def test_the_binomial_tail_is_the_sum():
    for n, k in ((10, 3), (24, 9), (120, 20), (40, 40)):
        want = sum(math.comb(n, i) * 0.1**i * 0.9 ** (n - i) for i in range(k, n + 1))
        assert review.chance_tail(n, k) == pytest.approx(want, rel=1e-9)
    assert review.lower_bound(14, 14) == pytest.approx(0.05 ** (1 / 14), rel=1e-9)
    assert review.chance_tail(10**7, 10**6 + 9000) < 1e-10 < review.chance_tail(10**7, 10**6)


@pytest.mark.parametrize(
    ("n", "k", "auto", "code"),
    [(9, 9, None, "too_few"), (10, 4, "keep", "chance"), (10, 10, None, "mixed"), (13, 13, None, "mixed"), (14, 14, "replace", "ids"), (20, 6, "keep", "chance"), (20, 20, "replace", "ids"), (40, 37, "replace", "ids"), (40, 36, None, "mixed"), (120, 20, "keep", "chance"), (120, 104, "replace", "ids"), (24, 12, None, "mixed")],
)
def test_thresholds(n, k, auto, code):
    assert review.judge(n, k)[::2] == (auto, code)


def test_phrases(spark):
    rows = [("رقم الطلب: 123", 11, "رقم الطلب"), ("x 12; 34", 6, ""), ("invoice #9", 9, "invoice"), ("9", 0, ""), ("one two three 5", 14, "two three")]
    df = spark.createDataFrame(rows, "t string, at int, want string").withColumn("got", review.phrase_before(F.col("t"), F.col("at")))
    assert [(r.t, r.got) for r in df.collect()] == [(t, w) for t, _, w in rows]


def valid_ids(n):
    out = []
    for k in range(n):
        body = f"1{k:08d}"
        total = sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 == 0 else int(c) for i, c in enumerate(body))
        out.append(body + str((10 - total % 10) % 10))
    return out


@pytest.fixture(scope="module")
def reviewed(spark):
    ids = valid_ids(60)
    filler = " وهذا نص عربي طويل يكفي لكي يعد العمود نصا حرا بلا شك"
    notes = [f"رقم الطلب {ids[k] if k < 30 else ids[k][:-1] + str((int(ids[k][-1]) + 5) % 10)}{filler}" for k in range(32)] + [f"رقم العملية {ids[40 + k]}{filler}" for k in range(5)]
    tables = {"t": spark.createDataFrame([(k, str(k), n, f"c{k}") for k, n in enumerate(notes)], f"{ROW} long, t_id string, notes string, ref string")}
    detections = detect_columns(tables, profile(tables))
    spans = text_spans(tables, [("t", "notes")])
    return tables, detections, spans


def test_groups_and_decisions(reviewed):
    tables, detections, spans = reviewed
    settled = review.resolve(tables, spans, detections)
    by = {r["phrase"]: r for r in review.group_summary(settled).collect()}
    assert by["رقم الطلب"]["population"] == 32 and by["رقم الطلب"]["passed"] == 30 and by["رقم الطلب"]["final"] == "replace"
    few = by["رقم العمليه"]
    assert few["final"] == "pending" and few["pending"] == 5
    decided = review.settle(settled, review.decide_group({}, few["key"], "keep"))
    assert review.totals(decided).first().asDict() == {"auto": 30, "admin": 5, "pending": 0, "replace": 30, "keep": 5}
    one = decided.filter(F.col("key") == few["key"]).first()
    both = {"groups": {few["key"]: "keep"}, "values": {few["key"]: {f"{one[ROW]}:{one['start']}": "replace"}}}
    assert review.totals(review.settle(settled, both)).first()["replace"] == 31
    assert review.decide_group(both, few["key"], "replace") == {"groups": {few["key"]: "replace"}, "values": {}}
    assert review.carried_over(both) == {"groups": {few["key"]: "keep"}, "values": {}}
    chosen, waiting = review.partition_spans(spans, settled, 0.5)
    assert chosen.filter("conf < 0.7").count() == 30 and waiting.count() == 5


# ------------------------------------------------------------------ cleaning


def table(spark, *rows, schema="a string, b string"):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"{ROW} long, {schema}")


def test_rules(spark):
    df = table(spark, (" x‏  y ", "1,500"), ("N/A", "+٢٫٥"), ("لا يوجد", "7"), ("x y", "8"), ("x y", "8"))
    out, report = cleaning.clean({"t": df})
    got = sorted((r[ROW], r["a"], r["b"]) for r in out["t"].collect())
    assert got == [(0, "x y", "1500"), (1, None, "2.5"), (2, None, "7"), (3, "x y", "8")]
    assert report["applied"]["trim"]["total"] == 1 and report["applied"]["nulls"]["total"] == 2 and report["applied"]["numbers"]["total"] == 2 and report["applied"]["dedupe"]["total"] == 1


def test_dates_need_one_order(spark):
    sure, unsure = table(spark, ("13/02/2024", "01/02/2024"), ("1/2/2024", "03/04/2024")), None
    out, report = cleaning.clean({"t": sure}, cleaning.CleanOptions.only("dates"))
    rows = sorted((r["a"], r["b"]) for r in out["t"].collect())
    assert rows == [("2024-02-01", "03/04/2024"), ("2024-02-13", "01/02/2024")] and report["ambiguous_dates"] == ["t.b"]
    assert unsure is None


def test_suggestions_and_merges(spark):
    df = table(spark, *[("North", "x")] * 5, ("north", "x"), ("NORTH ", "y"), ("South", "y"))
    found = cleaning.category_suggestions(df, ["a"]).collect()
    assert {(r["target"], r["variant"], r["n"]) for r in found} == {("North", "north", 1), ("North", "NORTH", 1)}
    out, _ = cleaning.clean({"t": df}, cleaning.CleanOptions.from_dict({"trim": False, "nulls": False, "numbers": False, "dates": False, "dedupe": False, "merges": ["t.a#0"], "other": 1}))
    assert {r["a"] for r in out["t"].collect()} == {"North", "South"}


def test_off_changes_nothing(spark):
    df = table(spark, (" a ", None), (None, None))
    out, report = cleaning.clean({"t": df}, cleaning.CleanOptions.off())
    assert sorted(map(str, out["t"].collect())) == sorted(map(str, df.collect())) and report["applied"] == {}
    assert cleaning.examples("t", df, "trim").collect()[0]["after"] == "a"
    assert cleaning.potential({"t": df})["trim"] == 1


# ------------------------------------------------------------------ answer keys


def test_answer_keys(spark):
    filler = " وهذا نص عربي طويل يكفي لكي يعد العمود نصا حرا بلا شك"
    df = spark.createDataFrame([(0, "F1", "هوية 1110704341" + filler), (1, "F2", "جوال 0558472803" + filler), (2, "F3", "لا شيء 1234567890" + filler)], f"{ROW} long, file string, notes string")
    twin = df.withColumn("notes", F.regexp_replace("notes", "1110704341", "1909266858"))
    key = "file_id,column,type,planted_value,expected\nF1,notes,هوية,1110704341,replace\nF2,notes,mobile,+966558472803,\nF3,notes,id,1234567890,ignore\nF9,notes,id,1,replace\n"
    entries = answer_key.load_key(spark, key.encode("utf-8-sig"))
    spans = text_spans({"t": df}, [("t", "notes")])
    found = answer_key.outcomes({"t": df}, [], spans, entries, {"t": twin})
    by = {r["kind"]: r.asDict() for r in answer_key.by_kind(found).collect()}
    assert by["SAUDI_ID"] == {"kind": "SAUDI_ID", "planted": 2, "found": 1, "replaced": 1, "missed": 1, "not_located": 1, "recall": 0.5}
    assert by["MOBILE"]["found"] == 1 and by["MOBILE"]["replaced"] == 0
    assert answer_key.look_alikes(found).first().asDict() == {"total": 1, "ignored": 1, "review_kept": 0, "review_replaced": 0, "wrong": 0, "not_located": 0}
    for bad, code in (("a,b\n", "answer_key_empty"), ("a,b\n1,2\n", "answer_key_columns"), ("column,type,value\nx,shoe,1\n", "answer_key_values")):
        with pytest.raises(answer_key.AnswerKeyError) as e:
            answer_key.load_key(spark, bad.encode())
        assert e.value.code == code


def test_marked_notes(spark):
    texts, golden = answer_key.marked_notes(spark, ["هوية ⟦SAUDI_ID:1110704341⟧ واسم ⟦PERSON_NAME:محمد الغامدي⟧", "بلا شيء"])
    spans = text_spans({"notes": texts}, [("notes", "text")])
    rows = {r["kind"]: r for r in score_detection(spans, golden).collect()}
    assert rows["OVERALL"]["recall"] == 1.0 and rows["OVERALL"]["precision"] == 1.0 and rows["SAUDI_ID"]["exact"] == 1
