"""Synthetic twins: split, view, copulas, likeness, distances; a model that memorises must fail."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from duneveil.operators import fidelity, scans, synthesis
from duneveil.operators.profiling import profile
from duneveil.operators.tables import ROW, numbered, numbered_in_group
from duneveil.plans import masking, synthesizing
from duneveil.operators.policy import DEFAULT, policy_from_dict

KEY = b"a key for tests, thirty-two or more"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    people = [(k, str(k), f"05{50000000 + k}", rng.choice(["north", "south"])) for k in range(150)]
    claims, n = [], 0
    for k in range(150):
        for _ in range(rng.randrange(1, 7)):
            kind = rng.choice(["dental", "surgery", "checkup"])
            amount = {"dental": 300, "surgery": 9000, "checkup": 100}[kind] * rng.lognormvariate(0, 0.3)
            claims.append((n, str(n), str(k), f"2024-{rng.randrange(1, 13):02d}-{rng.randrange(1, 28):02d}", kind, f"{amount:.2f}"))
            n += 1
    return {
        "people": spark.createDataFrame(people, f"{ROW} long, person_id string, mobile string, region string"),
        "claims": spark.createDataFrame(claims, f"{ROW} long, claim_id string, person_id string, claim_date string, kind string, amount string"),
    }


def test_units_are_split_whole(tables):
    p = profile(tables)
    train, hold, info = synthesis.split_holdout(tables, p, 0.2, 1)
    assert info["unit_table"] == "people" and info["holdout_rows"]["people"] == 30 and info["train_rows"]["people"] == 120
    assert train["claims"].join(hold["claims"], "person_id").count() == 0
    assert info["train_rows"]["claims"] + info["holdout_rows"]["claims"] == tables["claims"].count()
    again = synthesis.split_holdout(tables, p, 0.2, 1)[1]["people"]
    assert {r.person_id for r in again.collect()} == {r.person_id for r in hold["people"].collect()}


def test_rows_are_numbered_in_groups_of_any_size(spark):
    rows = [(k, "hot" if k % 3 else f"g{k % 7}", k % 5) for k in range(500)] + [(999, None, 1)]
    df = spark.createDataFrame(rows, "k long, g string, o int").repartition(6)
    got = {r.k: r.place for r in numbered_in_group(df, "g", ["o", "k"], "place").collect()}
    want, seen = {999: None}, {}
    for k, g, o in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[2], r[0])):
        want[k] = seen[g] = seen.get(g, -1) + 1
    assert got == want
    assert [r[ROW] for r in numbered(spark.range(0, 97, 1, 5)).orderBy("id").collect()] == list(range(97))


def test_the_view_and_its_plan(tables):
    p = profile(tables)
    a = masking.analyze(tables)
    view = synthesis.build_view(tables, p, {t: df.count() for t, df in tables.items()})
    assert view.base == "claims" and view.origin["region"] == ("people", "region") and "prior_claims" in view.df.columns
    kinds, left = synthesis.view_plan(view, p, a.detections)
    assert kinds == {"claim_date": "datetime", "kind": "categorical", "amount": "numerical", "region": "categorical", "prior_claims": "numerical"}
    assert set(left) == {"claim_id", "person_id", "mobile"}
    wide = replace(p, columns=p.columns | {("claims", "kind"): replace(p.columns["claims", "kind"], n_unique=fidelity.MAX_VALUES + 1)})
    kinds, left = synthesis.view_plan(view, wide, a.detections)
    assert "kind" not in kinds and str(fidelity.MAX_VALUES) in left["kind"]


def test_a_stratified_copula_keeps_what_depends_on_a_category(tables):
    f = synthesizing.fit(masking.analyze(tables), "stratified_copula", 0)
    assert f["model"].by == "kind"
    made = f["model"].sample(None, 3)
    assert made.count() == f["train"].count()
    assert sorted(map(str, made.collect())) == sorted(map(str, f["model"].sample(None, 3).collect()))
    real = {r["kind"]: r["m"] for r in f["train"].groupBy("kind").agg(F.median("amount").alias("m")).collect()}
    twin = {r["kind"]: r["m"] for r in made.groupBy("kind").agg(F.median("amount").alias("m")).collect()}
    assert all(abs(np.log(twin[k] / real[k])) < 0.25 for k in real)
    kinds = synthesizing.day_kinds(f["kinds"])
    near = fidelity.fidelity(f["train"], made, kinds)
    assert near["mean_distance"] < 0.1


def test_small_strata_come_from_the_pooled_copula(tables):
    model = synthesis.StratifiedCopula("kind", min_rows=10**6)
    typed = synthesis.typed_view(tables["claims"], {"kind": "categorical", "amount": "numerical"})
    model.fit(typed, {"kind": "categorical", "amount": "numerical"})
    made = model.sample(600, 1)
    assert not model.details["strata_with_own_copula"] and {r["kind"] for r in made.select("kind").distinct().collect()} == {"dental", "surgery", "checkup"}


def test_a_memorising_model_fails(tables):
    f = synthesizing.fit(masking.analyze(tables), "gaussian_copula", 0)
    kinds = synthesizing.day_kinds(f["kinds"])
    copied = fidelity.distance_to_closest(f["train"], f["train"], f["holdout"], kinds)
    assert not copied["passed"] and copied["twin_rows_at_distance_zero"] == f["train"].count()
    assert scans.exact_copies(f["train"], f["train"], list(kinds)).count() == f["train"].count()


def test_nearest_distances_are_exact(spark):
    rng = np.random.default_rng(2)
    points, queries = rng.random((500, 3)).round(2), rng.random((120, 3)).round(2)
    frame = lambda x: spark.createDataFrame([(list(map(float, v)),) for v in x], "vector array<double>")
    got = {tuple(r.vector): (r.n, r.nearest) for r in fidelity.nearest_distances(frame([*queries, queries[0]]), frame(points)).collect()}
    for q in queries:
        assert got[tuple(q)][1] == pytest.approx(np.sqrt(((points - q) ** 2).sum(axis=1)).min(), abs=1e-12)
    assert got[tuple(queries[0])][0] == 2


def test_nearest_distances_meet_in_small_parts(spark, monkeypatch):
    """Many cells of several blocks, columns of zeros and ones, one point far off; a part's points are read once for all its queries."""
    for name, value in (("CELL_ROWS", 40), ("MAX_CELLS", 6), ("BLOCK_ROWS", 30)):
        monkeypatch.setattr(fidelity, name, value)
    rng = np.random.default_rng(4)
    kinds = lambda n: np.eye(5)[rng.integers(0, 5, n)]
    points = np.vstack([np.hstack([rng.random((700, 2)), kinds(700)]), [[9.0, -9.0, 0, 0, 0, 0, 0]]])
    asked = np.vstack([np.hstack([rng.random((150, 2)), kinds(150)]), points[:3], [[8.0, 8.0, 1, 1, 1, 1, 1]]])
    frame = lambda x: spark.createDataFrame([(list(map(float, v)),) for v in x], "vector array<double>")
    found = fidelity.nearest_distances(frame(asked), frame([*points, points[0]]))
    got = {tuple(r.vector): r.nearest for r in found.collect()}
    for q in asked:
        assert got[tuple(q)] == pytest.approx(np.sqrt(((points - q) ** 2).sum(axis=1)).min(), abs=1e-12)
    plan = found._jdf.queryExecution().toString()
    assert "CoGroups" in plan and "MapInPandas" not in plan
    assert fidelity.nearest_distances(frame(asked[:2]), frame(points).limit(0)).filter("nearest IS NULL").count() == 2


def test_a_run_and_its_report(tables):
    result = synthesizing.run_synthetic(masking.analyze(tables), policy_from_dict(DEFAULT), KEY, target="costly = amount > p90", seed=1)
    checks = {c["name"]: c for c in result.report["checks"]}
    assert checks["holdout_split"]["status"] == checks["leak_scan"]["status"] == checks["exact_copies"]["status"] == "PASS"
    assert checks["utility_tstr"]["status"] in ("PASS", "FAIL") and checks["utility_tstr"]["details"]["models"]["logistic"]["train"]["auc"] > 0.8
    twin = result.twin["claims"]
    assert set(twin.columns) - {ROW} == {"claim_id", "person_id", "claim_date", "kind", "amount", "mobile", "region", "prior_claims"}
    assert twin.filter("claim_date IS NOT NULL").filter(~F.col("claim_date").rlike(r"^\d{4}-\d\d-\d\d$")).count() == 0
    assert twin.select("mobile").distinct().count() == twin.count()


def test_targets():
    assert fidelity.parse_target("high=amount>p90") == ("high", "amount", 0.9) and fidelity.parse_target("label") == ("label", "label", None)
    with pytest.raises(ValueError, match="unknown"):
        synthesis.make_synthesizer("ctgan")
