"""Identifiers and text forms against known vectors and plain Python."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from duneveil.functions import spans as S
from duneveil.functions import text as T
from duneveil.functions.identifiers import KINDS, canonical, generate, is_valid
from duneveil.functions.names import GAZETTEER

SEPARATORS = " \t\xa0  -‐‑‒–−.٫٬()‎‏؜‪‫‬‭‮⁦⁧⁨⁩"
DIGITS = "0123456789٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"


def plain_normalize(text):
    """(normalized, offsets) in plain Python."""
    out, at, k = [], [], 0
    while k < len(text):
        c = text[k]
        if c in SEPARATORS and k and text[k - 1] in DIGITS:
            end = k
            while end < len(text) and text[end] in SEPARATORS:
                end += 1
            if end - k <= 3 and end < len(text) and text[end] in DIGITS:
                k = end
                continue
            out += text[k:end]
            at += range(k, end)
            k = end
            continue
        out.append(str(DIGITS.index(c) % 10) if c in DIGITS else c)
        at.append(k)
        k += 1
    return "".join(out), at


def test_normal_form_and_offsets_are_those_of_plain_python(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(DIGITS + SEPARATORS * 2 + "ab@س😀") for _ in range(rng.randrange(14))) for _ in range(800)] + ["", "1 2", "05-5 (1)", "123    456"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.normalize(F.col("t")).alias("n"), T.offsets(F.col("t")).alias("o")).collect()
    for r in rows:
        assert (r.n, list(r.o)) == plain_normalize(texts[r.k]), repr(texts[r.k])


@pytest.mark.parametrize(
    ("kind", "value", "ok"),
    [
        ("SAUDI_ID", "1110704341", True), ("SAUDI_ID", "1909266858", True), ("SAUDI_ID", "2129040479", True), ("SAUDI_ID", "1234567890", False), ("SAUDI_ID", "2111111111", False),
        ("SAUDI_ID", "١١١٠-٧٠٤ ٣٤١", True), ("SAUDI_ID", "3110704341", False), ("SAUDI_ID", "111070434", False), ("MOBILE", "0558472803", True), ("MOBILE", "(058) 547 2803", True),
        ("MOBILE", "+966558472803", True), ("MOBILE", "00966558472803", True), ("MOBILE", "055847280", False), ("IBAN", "SA0380000000608010167519", True), ("IBAN", "sa03 8000 0000 6080 1016 7519", True),
        ("IBAN", "SA0380000000608010167510", False), ("EMAIL", " User.Name@mail.example.com ", True), ("EMAIL", "user@@example.com", False), ("EMAIL", "user@example.c", False),
        ("PERSON_NAME", "مُحمَّد الغامدي", True), ("PERSON_NAME", "طاولة", False), ("SAUDI_ID", None, False), ("SAUDI_ID", "", False),
    ],
)
def test_validity(spark, kind, value, ok):
    assert spark.createDataFrame([(value,)], "v string").select(is_valid(kind, F.col("v"))).first()[0] is ok


def test_all_spellings_of_a_mobile_have_one_canonical_form(spark):
    rows = spark.createDataFrame([(x,) for x in ("0558472803", "+966558472803", "966558472803", "00966558472803", "٠٥٥ ٨٤٧ ٢٨٠٣")], "v string")
    assert {r[0] for r in rows.select(canonical("MOBILE", F.col("v"))).collect()} == {"558472803"}


def test_made_up_identifiers_are_valid(spark):
    rows = spark.range(300).select(*(is_valid(k, generate(k, F.col("id").cast("string"))).alias(k) for k in KINDS))
    assert rows.filter(" OR ".join(f"NOT {k}" for k in KINDS)).count() == 0


def test_redacted_texts_hold_no_numbers(spark):
    texts = ["id 1110704341 here", "SA03 8000 0000 6080 1016 7519", "a.b@c.com", "٠٥٥ ٨٤٧ ٢٨٠٣", "room 12"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.redact(F.col("t"))).collect()]
    assert all("***" in g for g in got[:4]) and got[4] == "room 12"


# ------------------------------------------------------------------ spans


def found(spark, text, **more):
    rows = S.with_spans(spark.createDataFrame([(text,)], "t string"), "t", **more).first()["spans"]
    return [(text[s.start : s.end], s.kind, s.conf) for s in rows]


def test_numbers_in_any_script_and_layout(spark):
    assert found(spark, "الهوية ١١١٠ ٧٠٤ ٣٤١ والجوال +966 55 847 2803") == [("١١١٠ ٧٠٤ ٣٤١", "SAUDI_ID", 0.95), ("+966 55 847 2803", "MOBILE", 0.95)]
    assert found(spark, "رقم الطلب 1110704341") == [("1110704341", "SAUDI_ID", 0.6)]
    assert found(spark, "😀 x@y.com") == [("x@y.com", "EMAIL", 0.99)]
    assert found(spark, "12345678901234567890") == []


def test_account_numbers_by_check_and_by_word(spark):
    good, bad = "SA0380000000608010167519", "SA0380000000608010167510"
    assert found(spark, good) == [(good, "IBAN", 0.99)]
    assert found(spark, f"تحويل {bad}") == [(bad, "IBAN", 0.9)]
    assert found(spark, f"code {bad}") == [(bad, "IBAN", 0.6)]


def test_names_by_gazetteer(spark):
    assert found(spark, "حضر محمد الغامدي اليوم") == [("محمد الغامدي", "PERSON_NAME", 0.9)]
    assert found(spark, "قابلت المريض خالد") == [("خالد", "PERSON_NAME", 0.8)]
    assert found(spark, "ذهب خالد") == [("خالد", "PERSON_NAME", 0.7)]
    assert found(spark, "ذهب وخالد") == [("خالد", "PERSON_NAME", 0.7)]
    assert found(spark, "كله أمل") == []
    assert found(spark, "على المكتب") == []
    assert found(spark, "شركة الغامدي") == []


def test_null_and_empty_texts_have_no_spans(spark):
    rows = S.with_spans(spark.createDataFrame([(None,), ("",), ("plain",)], "t string"), "t").collect()
    assert all(r["spans"] == [] for r in rows)


def test_replaced_spans_leave_the_rest(spark):
    df = spark.createDataFrame([("ab12cd34", [(2, 4, "X"), (3, 5, "Y"), (6, 8, "ZZZ")])], "t string, p array<struct<start:int,end:int,value:string>>")
    assert df.select(S.replace_spans(F.col("t"), F.col("p"))).first()[0] == "abXcdZZZ"


def test_lists_are_in_plain_spelling():
    assert all(re.fullmatch("[ء-ي]+", w) for w in GAZETTEER.first())


def test_profiles_count_values_without_copies_of_rows(spark):
    from duneveil.operators.profiling import column_stats
    from duneveil.operators.tables import ROW

    rows = [(0, "7", "-"), (1, "7", None), (2, "8.5", "سلام x"), (3, None, "سلام x")]
    stats = column_stats(spark.createDataFrame(rows, f"{ROW} long, a string, b string"))
    assert stats._jdf.queryExecution().optimizedPlan().toString().count("Expand") == 1  # that of the cells alone
    found = {r["column"]: r for r in stats.collect()}
    a, b = ([found[c][x] for x in ("n_rows", "n_null", "n_unique", "n_real", "u_real", "mean_len", "arabic_ratio", "numeric", "dates")] for c in "ab")
    assert a == [4, 1, 2, 3, 2, 5 / 3, 0.0, 1.0, 0.0] and b == [4, 1, 2, 2, 1, 6.0, 0.8, 0.0, 0.0]


def test_a_long_text_is_searched_by_its_names_and_not_by_its_words(spark):
    df = spark.createDataFrame([("كلمة " * 60_000 + "السيد سالم 05512-34567",)], "t string")
    df.select(S.matches(F.col("t"), "x")).collect()
    began = time.monotonic()
    spans = S.with_spans(df, "t").first()["spans"]
    assert [(s["kind"], s["start"], s["end"], s["conf"]) for s in spans] == [("PERSON_NAME", 300_006, 300_010, 0.8), ("MOBILE", 300_011, 300_022, 0.95)]
    assert time.monotonic() - began < 20


def test_places_by_dropped_separators_are_those_of_the_offsets(spark):
    texts = ["", "a1 2", "٠٥٠ ٣٣١ ٨٨٤٢", "1-2--3---4----5", "no digit", "1 . 2+3 4", "+966 55-5"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("n", T.normalize(F.col("t"))).withColumn("o", T.offsets(F.col("t")))
    rows = rows.withColumn("d", S.dropped(F.col("t"), F.col("n"))).withColumn("p", F.transform("o", lambda _, k: S.place(F.col("d"), k)))
    assert all(r["o"] == r["p"] for r in rows.collect())


def test_a_plus_sign_belongs_to_the_digits_behind_it(spark):
    rows = S.with_spans(spark.createDataFrame([("1610925164+0567605952",), ("1610925164+966567605952",)], "t string"), "t").collect()
    assert [[s["kind"] for s in r["spans"]] for r in rows] == [["SAUDI_ID"], ["SAUDI_ID", "MOBILE"]]


def test_classes_of_characters_hold_what_they_list(spark):
    every = [chr(k) for k in range(1, 0x10000) if not 0xD800 <= k < 0xE000] + ["😀", "𝟘"]
    blanks = {chr(k) for k in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]}
    df = spark.createDataFrame([(c,) for c in every], "c string")
    matched = lambda pattern: {r["c"] for r in df.filter(F.col("c").rlike(rf"\A(?s:{pattern})\z")).collect()}
    assert matched(f"[{T.BLANKS}]") == blanks and matched(f"[^{T.BLANKS}]") == set(every) - blanks
    assert matched(f"[{T.BLANKS}()]") == blanks | set("()") and matched(f"[{T.DIGIT}]") == set(DIGITS)
    assert {r["c"] for r in df.filter(T.flatten(F.col("c")) == "").collect()} == blanks | set("()")
