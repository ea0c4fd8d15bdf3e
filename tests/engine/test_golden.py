"""Golden notes are the same on any partitioning; quality scores and percentiles are what they are defined to be."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from duneveil.operators import fidelity
from duneveil.operators.tables import ROW, exact_percentiles
from duneveil.plans import golden


def test_golden_spans_hold_what_was_planted(spark, sf_dir):
    notes, spans = golden.golden(spark, sf_dir)
    rows = spans.join(notes, ROW).withColumn("piece", F.substring("notes", F.col("start") + 1, F.col("end") - F.col("start"))).collect()
    assert len(rows) > 1500
    shape = {"SAUDI_ID": 10, "MOBILE": 9, "IBAN": 22}
    for r in rows:
        assert r["piece"] == r["piece"].strip() and (r["start"] == 0 or r["notes"][r["start"] - 1] == " ")
        digits = "".join(str(int(c)) for c in r["piece"] if c.isdigit())
        if not r["hard"] and r["kind"] in shape:
            assert len(digits) >= shape[r["kind"]]
    share = notes.filter(F.col("notes").startswith("تواصل")).count() / notes.count()
    assert abs(share - golden.WEIGHTS[0] / 100) < 0.05
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = golden.golden(spark, sf_dir)[1]
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, spans.collect()))


def test_quality_of_equal_and_of_unrelated_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=600)
    rows = [(float(v), float(v + rng.normal() * 0.1), "a" if v > 0 else None, f"2024-01-{1 + int(abs(v) * 7) % 28:02d}") for v in x]
    kinds = {"x": "numerical", "y": "numerical", "w": "categorical", "d": "datetime"}
    real = spark.createDataFrame(rows, "x double, y double, w string, d string")
    assert all(r["score"] == pytest.approx(1.0) for r in fidelity.quality_scores(real, real.repartition(3), kinds).collect())
    mixed = [(a[0], b[1], b[2], a[3]) for a, b in zip(rows, [rows[k] for k in rng.permutation(600)], strict=True)]
    twin = spark.createDataFrame(mixed, real.schema)
    got = {(r["property"], r["a"], r["b"]): r["score"] for r in fidelity.quality_scores(real, twin, kinds).collect()}
    assert all(v == pytest.approx(1.0) for (p, *_), v in got.items() if p == "shape") and len(got) == 4 + 6
    assert got["trend", "x", "y"] == pytest.approx(1 - abs(np.corrcoef(x, [r[1] for r in rows])[0, 1] - np.corrcoef([r[0] for r in mixed], [r[1] for r in mixed])[0, 1]) / 2)
    assert got["trend", "x", "w"] < 0.8 and got["trend", "y", "w"] == pytest.approx(1.0)
    found = fidelity.quality(real, twin, kinds)
    assert found["shapes"] == 1.0 and found["trends"] < 0.95 and found["pairs"] == 6
    assert fidelity.quality(real.limit(0), twin.limit(0), kinds)["pairs"] >= 0


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(v), int(n)) for v, n in zip(rng.normal(size=200).round(1), rng.integers(1, 5, 200), strict=True)] + [("b", 7.0, 1), ("c", None, 3)]
    df = spark.createDataFrame(rows, "g string, v double, n long").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_percentiles(df, shares)
    whole = np.repeat([v for g, v, _ in rows if g == "a"], [n for g, _, n in rows if g == "a"])
    assert got["a"] == pytest.approx({s: np.quantile(whole, s) for s in shares}) and got["b"] == dict.fromkeys(shares, 7.0) and "c" not in got
    assert exact_percentiles(df.limit(0), shares) == {}
