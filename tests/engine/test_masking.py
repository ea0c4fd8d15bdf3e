"""The masked twin from end to end, its proofs, and what must make them fail."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from duneveil.functions.identifiers import canonical, is_valid
from duneveil.functions.spans import with_spans
from duneveil.operators import policy as policies
from duneveil.operators import pseudonyms, report, scans, twin, viewer
from duneveil.operators.detection import text_spans
from duneveil.operators.tables import ROW, as_text, written
from duneveil.plans import fixtures, masking

KEY = b"a key for tests, thirty-two or more"


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    out = {}
    for name, df, key in (("people", fixtures.people(spark, sf_dir).drop("balance").filter("person_id <= 60"), "person_id"), ("claims", fixtures.claims(spark, sf_dir).drop("amount").filter("person_id <= 60"), "claim_id")):
        out[name] = written(as_text(df.withColumn(ROW, F.col(key).cast("long"))), name)
    return out


@pytest.fixture(scope="module")
def analysis(tables):
    return masking.analyze(tables)


@pytest.fixture(scope="module")
def run(analysis):
    return masking.run_masked(analysis, policies.policy_from_dict(policies.DEFAULT), KEY)


def test_what_is_found(analysis):
    kinds = {(d.table, d.column): d.kind or d.tag for d in analysis.detections}
    assert kinds["people", "national_id"] == "SAUDI_ID" and kinds["people", "mobile"] == "MOBILE" and kinds["people", "iban"] == "IBAN"
    assert kinds["people", "email"] == "EMAIL" and kinds["people", "full_name"] == "PERSON_NAME" and kinds["claims", "notes"] == "FREE_TEXT"
    assert analysis.profile.primary_keys == {"people": "person_id", "claims": "claim_id"}
    assert [(f.child_table, f.child_column, f.parent_table) for f in analysis.profile.foreign_keys] == [("claims", "person_id", "people")]


def test_the_twin_holds_no_original_and_fits_together(tables, run):
    p, c = run.twin["people"], run.twin["claims"]
    assert p.count() == tables["people"].count() and c.count() == tables["claims"].count()
    assert scans.orphans(c, "person_id", p, "person_id").count() == 0
    for kind, column in (("SAUDI_ID", "national_id"), ("MOBILE", "mobile"), ("IBAN", "iban")):
        new = p.select(canonical(kind, F.col(column)).alias("c"), is_valid(kind, F.col(column)).alias("ok")).collect()
        assert all(r.ok for r in new) and len({r.c for r in new}) == len(new)
    checks = {x["name"]: x["status"] for x in run.report["checks"]}
    assert checks["leak_scan"] == "PASS" and checks["exact_copies"] == "PASS"
    assert not run.report["withheld"]
    # a person's number is the same in the table and in the notes
    both = c.join(p.select("person_id", "full_name"), "person_id").filter("claim_id IS NOT NULL AND notes LIKE '%تواصل%'")
    assert both.filter(~F.contains("notes", "full_name")).count() == 0


def test_a_long_pseudonym_holds_no_original(spark):
    values = spark.createDataFrame([("SAUDI_ID", "1110704341"), ("IBAN", "SA0380000000608010167519")], "kind string, canon string")

    def draw(kind, canon, hexes, attempt, *_):
        iban = F.when(attempt == 0, "SA9900111070434100000000").otherwise("SA9900000000000000000000")
        return F.when(kind == "IBAN", iban).otherwise("1909266858")

    assert {r.kind: r.fake for r in pseudonyms.assign(values, KEY, draw=draw).collect()} == {"SAUDI_ID": "1909266858", "IBAN": "SA9900000000000000000000"}


def test_the_same_key_makes_the_same_twin_and_another_key_another(tables, analysis, run):
    policy = policies.policy_from_dict(policies.DEFAULT)
    again = masking.run_masked(analysis, policy, KEY).twin["people"]
    other = masking.run_masked(analysis, policy, KEY + b"2").twin["people"]
    assert sorted(again.collect()) == sorted(run.twin["people"].collect())
    assert {r.national_id for r in other.collect()} != {r.national_id for r in again.collect()}


def test_the_key_is_in_no_plan(tables):
    mapping = pseudonyms.digest_function(b"hush-hush-hush")
    df = tables["people"].select(mapping(F.col("person_id")).alias("x"))
    assert "hush" not in df._jdf.queryExecution().toString()


def test_layouts_are_kept(spark):
    rows = [("SAUDI_ID", "١١١٠-٧٠٤ ٣٤١", "1909266858", "١٩٠٩-٢٦٦ ٨٥٨"), ("MOBILE", "+966 55 847 2803", "501234567", "+966 50 123 4567"), ("IBAN", "sa0380000000608010167519", "SA4420000001234567891234", "sa4420000001234567891234")]
    df = spark.createDataFrame(rows, "kind string, raw string, fake string, want string")
    for r in df.withColumn("got", pseudonyms.render_like(F.col("raw"), F.col("kind"), F.col("fake"))).collect():
        assert r.got == r.want


def test_small_keys_get_distinct_pseudonyms(spark):
    values = spark.createDataFrame([("PK:t.id", str(k)) for k in range(1, 40)], "kind string, canon string")
    fakes = [r.fake for r in pseudonyms.assign(values, KEY).collect()]
    assert len(fakes) == len(set(fakes)) == 39


def test_keys_that_fill_their_space_take_few_draws(spark, monkeypatch):
    drawn = []

    def counted(df, name):
        out = written(df, name)
        drawn.append(out.count() if name == "drawn" else 0)
        return out

    monkeypatch.setattr(pseudonyms, "written", counted)
    values = spark.createDataFrame([("PK:t.id", str(k)) for k in range(1000, 9000)], "kind string, canon string")
    fakes = [r.fake for r in pseudonyms.assign(values, KEY).collect()]
    assert len(fakes) == len(set(fakes)) == 8000 and sum(drawn) < 8 * 8000, drawn


@pytest.mark.parametrize(("canon", "own", "want"), [("0042", "0777", "0777"), ("42", "07", "77"), ("1900", "0000", "7000"), ("A-007", "0012345", "A-123"), ("1" * 30, "0" * 29 + "5", "7" + "0" * 28 + "5")])
def test_keys_keep_their_shape(spark, canon, own, want):
    hexes = "f" * 40 + own + "1" * (88 - len(own))
    df = spark.createDataFrame([(canon, hexes)], "canon string, hexes string")
    assert df.select(pseudonyms.candidate(F.lit("PK:x"), F.col("canon"), F.col("hexes"), F.lit(0))).first()[0] == want


def test_an_exhausted_space_names_no_value(spark):
    values = spark.createDataFrame([("SAUDI_ID", "1110704341")], "kind string, canon string")
    same = lambda kind, canon, *_: canon
    with pytest.raises(pseudonyms.PseudonymSpaceExhausted) as e:
        pseudonyms.assign(values, KEY, max_rounds=2, draw=same)
    assert "1110704341" not in str(e.value)


def test_only_cells_without_an_identifier_are_left_out_of_scans(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("0123456789٠٥٦۹15- .+SAsa@b.c") for _ in range(rng.randrange(34))) for _ in range(1500)] + ["1110704341", "١١١٠-٧٠٤ ٣٤١", "+966558472803", "a@b.co", "SA0380000000608010167519"]
    df = with_spans(spark.createDataFrame([(t,) for t in texts], "t string"), "t", names=False)
    held = [r["some"] for r in df.withColumn("some", F.col("t").rlike(scans.SOME_IDENTIFIER)).collect() if r["spans"]]
    assert len(held) >= 5 and all(held)
    plain = spark.createDataFrame([("1234.56",), ("2020-01-01",), ("12345678",), ("HIGH",)], "t string")
    assert plain.filter(F.col("t").rlike(scans.SOME_IDENTIFIER)).count() == 0


# ------------------------------------------------------------------ what must fail


def scan(tables, analysis, twin_tables):
    originals = scans.original_values(tables, analysis.detections, analysis.spans)
    return scans.leak_scan(originals, twin_tables, "masked", tables, [("people", "full_name")])


@pytest.mark.parametrize(("how", "method"), [("spaced", "detector"), ("glued", "exhaustive")])
def test_a_planted_original_is_seen(tables, analysis, run, how, method):
    original = tables["people"].filter(is_valid("SAUDI_ID", F.col("national_id"))).select(canonical("SAUDI_ID", F.col("national_id"))).first()[0]
    at = run.twin["claims"].agg(F.min(ROW)).first()[0]
    bad = run.twin | {"claims": viewer.plant_leak(run.twin["claims"], "notes", at, original, how)}
    got = scan(tables, analysis, bad)
    assert got["hard_fail"] and got["leaks_by_method"][method] == 1 and got["locations"][0]["row"] == at


def test_a_kept_name_fails(tables, analysis, run):
    one = tables["people"].select(ROW, F.col("full_name").alias("old")).limit(1)
    bad = run.twin["people"].join(one, ROW, "left").withColumn("full_name", F.coalesce("old", "full_name")).drop("old")
    got = scan(tables, analysis, run.twin | {"people": bad})
    assert got["hard_fail"] and got["names"]["rows_keeping_original_full_name"] == 1


def test_an_identifier_that_a_person_keeps_withholds_the_twin(tables, analysis, tmp_path):
    result = masking.run_masked(analysis, policies.policy_from_dict(policies.DEFAULT), KEY, overrides={"people.national_id": {"tag": "NORMAL", "action": "keep"}})
    assert result.report["verdict"] == "FAIL" and result.report["withheld"]
    assert [x.split("/")[-1] for x in masking.write_outputs(result, str(tmp_path))] == ["report.json"]
    assert report.shareable(result.report) == "twin_not_shareable"


def test_a_table_of_kept_columns_is_a_copy(spark):
    df = spark.createDataFrame([(k, "x", str(k % 3)) for k in range(9)], f"{ROW} long, a string, b string")
    assert scans.exact_copies(df, df).count() == 9
    assert scans.exact_copies(df, spark.createDataFrame([(0, None, "1")], df.schema)).count() == 0
    assert scans.exact_copies(spark.createDataFrame([(5, None, "1")], df.schema), spark.createDataFrame([(0, None, "1")], df.schema)).count() == 1


def test_residual_identifiers(spark, run):
    df = spark.createDataFrame([(0, "call 0558472803"), (1, "code 1110704341"), (2, "nothing")], f"{ROW} long, t string")
    none = spark.createDataFrame([("558472803",)], "value string")
    got = scans.residual_scan({"t": df}, none)
    assert got["verdict"] == "FAIL" and got["by_kind"]["SAUDI_ID"] == 1 and got["by_kind"]["MOBILE"] == 0
    allowed = spark.createDataFrame([("t", "t", 1, "1110704341")], f"table string, column string, {ROW} long, canon string")
    assert scans.residual_scan({"t": df}, none, allowed)["verdict"] == "PASS"
    assert scans.residual_scan({"t": df}, none.limit(0), None, frozenset({"t.t"}))["verdict"] == "PASS"


def test_previews_are_masked(spark):
    df = spark.createDataFrame([(0, "الهوية 1110704341 للعميل محمد الغامدي"), (1, "plain")], f"{ROW} long, value string")
    got = {r[ROW]: r["value"] for r in twin.mask_texts(df, text_spans({"p": df}, [("p", "value")]), KEY).collect()}
    assert "1110704341" not in got[0] and "محمد الغامدي" not in got[0] and got[0].startswith("الهوية 1") and got[1] == "plain"


def test_marks_and_entities(tables, analysis, run):
    marks = {r["mark"] for r in run.marks.select("mark").distinct().collect()}
    assert marks <= {"replaced", "review"} and "replaced" in marks
    rows = viewer.entity_rows(tables, analysis.profile, "7")
    assert rows["people"].count() == 1 and rows["claims"].filter("person_id <> '7'").count() == 0
    baseline = text_spans(tables, [("claims", "notes")], baseline=True)
    scores = viewer.note_scores(analysis.spans, baseline)
    assert viewer.top_notes(scores).count() == 12
    assert viewer.default_entity(tables, analysis.profile, scores) is not None
    assert viewer.note_marks(analysis.spans, baseline, run.settled).filter("mark = 'hit'").count() > 0
    totals = {(r["table"], r["column"]): r for r in viewer.twin_totals(tables, analysis.profile).collect()}
    assert totals["claims", ""]["rows"] == tables["claims"].count()
    assert viewer.referential_integrity(run.twin, analysis.profile.foreign_keys).first()["orphans"] == 0
    assert scans.fake_validity(run.twin, analysis.detections).filter("n <> valid").count() == 0


def test_policies():
    p = policies.policy_from_dict(policies.DEFAULT)
    assert p.hash == policies.policy_from_dict(policies.DEFAULT).hash
    with pytest.raises(ValueError, match="names no known action"):
        policies.policy_from_dict({"policy": {"SAUDI_ID": {"action": "shred"}}})


def test_reports_are_checked(run):
    report.validate(run.report)
    with pytest.raises(ValueError, match="verdict"):
        report.validate(run.report | {"verdict": "MAYBE"})
    assert report.shareable(run.report | {"verdict": "PASS", "withheld": False}, pending=2) == "decisions_pending"
    assert "| masked |" in report.summarize_runs([run.report]) and len(report.proof_cards(run.report)) == 3
