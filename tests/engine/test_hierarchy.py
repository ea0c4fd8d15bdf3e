"""Several tables drawn at once: a planted three-level set comes back in its numbers and correlations."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from duneveil.operators import hierarchy
from duneveil.operators.policy import DEFAULT, policy_from_dict
from duneveil.operators.tables import ROW, ForeignKey, as_text
from duneveil.plans import masking, queries, synthesizing

LINKS = [ForeignKey("visit", "person", "person", "id"), ForeignKey("item", "visit", "visit", "id"), ForeignKey("item", "shop", "shop", "id")]
KEYS = {"person": "id", "visit": "id", "item": None, "shop": "id"}
KINDS = {"person": {"wealth": "numerical", "town": "categorical"}, "visit": {"price": "numerical"}, "item": {"weight": "numerical", "colour": "categorical"}, "shop": {}}


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(2)
    people, visits, items = [], [], []
    for k in range(1500):
        wealth = rng.normal()
        people.append((k, f"p{k}", float(np.exp(wealth)), "north" if wealth + rng.normal() > 0 else "south"))
        for _ in range(rng.poisson(max(0.2, 3 + wealth))):
            price = 0.7 * wealth + 0.7 * rng.normal()
            v = len(visits)
            visits.append((v, f"v{v}", f"p{k}", price))
            for _ in range(rng.poisson(max(0.2, 2.5 + 0.8 * price))):
                weight = 0.8 * price + 0.6 * rng.normal()
                items.append((len(items), f"v{v}", f"s{rng.integers(5)}", weight, "red" if weight > rng.normal() else None if rng.random() < 0.1 else "blue"))
    return {
        "person": spark.createDataFrame(people, f"{ROW} long, id string, wealth double, town string"), "visit": spark.createDataFrame(visits, f"{ROW} long, id string, person string, price double"),
        "item": spark.createDataFrame(items, f"{ROW} long, visit string, shop string, weight double, colour string"), "shop": spark.createDataFrame([(k, f"s{k}") for k in range(5)], f"{ROW} long, id string"),
    }


def facts(tables):
    p, v, i = (tables[t].toPandas() for t in ("person", "visit", "item"))
    n_items = i.groupby("visit").size().reindex(v["id"], fill_value=0).to_numpy()
    owner = p.set_index("id").loc[v["person"], "wealth"].to_numpy()
    price = v.set_index("id").loc[i["visit"], "price"].to_numpy()
    per = v.groupby("person").size().reindex(p["id"], fill_value=0).to_numpy()
    spearman = lambda a, b: np.corrcoef(np.argsort(np.argsort(a)), np.argsort(np.argsort(b)))[0, 1]
    return {
        "visits": len(v) / len(p), "items": len(i) / len(v), "spread": per.std() / per.mean(), "north": (p["town"] == "north").mean(), "red": (i["colour"] == "red").mean(), "weight": i["weight"].std(),
    }, {
        "wealth-visits": spearman(p["wealth"], per), "wealth-price": spearman(owner, v["price"]), "price-items": spearman(v["price"], n_items), "price-weight": spearman(price, i["weight"]),
        "weight-red": spearman(i["weight"], (i["colour"] == "red").astype(int)), "alike": spearman(i["weight"], i.groupby("visit")["weight"].transform("mean")),
    }


def test_three_levels_keep_their_numbers_and_correlations(planted):
    model = hierarchy.HierarchicalCopula(KEYS, LINKS)
    model.fit(planted, KINDS)
    made = model.sample()
    sizes, links = facts(planted)
    new_sizes, new_links = facts(made)
    for name, value in sizes.items():
        assert abs(new_sizes[name] - value) <= 0.06 * value, (name, value, new_sizes[name])
    for name, value in links.items():
        assert abs(new_links[name] - value) <= 0.07, (name, value, new_links[name])
    assert made["item"].join(made["visit"].select(F.col("id").alias("v")), F.col("visit") == F.col("v"), "left_anti").count() == 0
    assert made["item"].select("shop").distinct().count() == 5 and made["item"].filter("colour IS NULL").count() > 0
    again = model.sample()
    assert sorted(map(tuple, made["visit"].drop(ROW, "id").collect())) == sorted(map(tuple, again["visit"].drop(ROW, "id").collect()))
    assert abs(model.sample(0.2)["person"].count() - 300) <= 1


def test_a_parent_with_very_many_children_is_drawn_in_chunks(spark):
    parents = spark.createDataFrame([(k, f"p{k}") for k in range(3)], f"{ROW} long, id string")
    rows = spark.range(12_000).select(F.col("id").alias(ROW), F.when(F.col("id") < 11_990, "p0").otherwise("p1").alias("p"), (F.col("id") % 100).cast("double").alias("x"))
    model = hierarchy.HierarchicalCopula({"a": "id", "b": None}, [ForeignKey("b", "p", "a", "id")])
    model.fit({"a": parents, "b": rows}, {"a": {}, "b": {"x": "numerical"}})
    made = model.sample(40)
    per = [r["n"] for r in made["b"].groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(per) > 2 * hierarchy.CHUNK and made["a"].count() == 120
    assert made["b"].agg(F.countDistinct("x")).first()[0] == 100


def test_empty_tables_and_circles(spark):
    a = spark.createDataFrame([], f"{ROW} long, id string, other string, x double")
    model = hierarchy.HierarchicalCopula({"a": "id", "b": "id"}, [ForeignKey("a", "other", "b", "id"), ForeignKey("b", "other", "a", "id")])
    model.fit({"a": a, "b": a}, {"a": {"x": "numerical"}, "b": {"x": "numerical"}})
    assert model.sample()["b"].count() <= 1


def test_run_over_all_tables(spark, sf_dir):
    tables = {"people": queries.people(spark, sf_dir), "claims": queries.claims(spark, sf_dir)}
    tables = {t: as_text(df.withColumn(ROW, F.col({"people": "person_id", "claims": "claim_id"}[t]).cast("long"))) for t, df in tables.items()}
    analysis = masking.analyze(tables)
    result = synthesizing.run_multi_table(analysis, policy_from_dict(DEFAULT), queries.TEST_KEY)
    status = {c["name"]: c["status"] for c in result.report["checks"]}
    assert status["leak_scan"] == status["referential_integrity"] == status["exact_copies"] == "PASS"
    assert result.twin["people"].columns == [ROW, *(c for c in tables["people"].columns if c != ROW)] and abs(result.twin["people"].count() - tables["people"].count()) <= 1
    assert result.twin["claims"].filter("notes IS NULL").count() == 0


def test_roots_have_no_correlation_by_chance(spark):
    model = hierarchy.HierarchicalCopula({}, [])
    model.spark = spark
    ids = np.arange(300)
    g = np.column_stack([hierarchy._gauss(ids, k, 7) for k in range(4)])
    middle, even = model._moments(300, 4, 7)
    z = (g - middle) @ even.T
    assert np.abs(np.cov(g.T, bias=True) - np.eye(4)).max() > 0.03  # as they are drawn
    assert np.abs(np.cov(z.T, bias=True) - np.eye(4)).max() < 1e-6 and np.abs(z.mean(axis=0)).max() < 1e-6
    assert np.array_equal(model._moments(3, 4, 7)[1], np.eye(4))


def test_what_is_seen_between_own_columns_stays():
    matrix = np.array([[1.0, 0.0, 0.9], [0.0, 1.0, -0.9], [0.9, -0.9, 1.0]])  # none has all three
    both = hierarchy._factor_with_own(matrix, 2)
    both = both @ both.T
    assert abs(both[0, 1]) < 1e-9 and np.allclose(np.diag(both), 1) and both[0, 2] > 0.6 and both[1, 2] < -0.6
    assert abs((lambda f: f @ f.T)(hierarchy._correlation_factor(matrix, np.ones(3)))[0, 1]) > 0.05  # before


def test_what_is_seen_inside_parents_stays(spark):
    # lines say nothing of their orders, so that effects on them are noise that no covariance has
    number = lambda salt: (F.pmod(F.xxhash64(ROW, F.lit(salt)), F.lit(100_003)) / 100_003).cast("double")
    rows = lambda n, per, *columns: spark.range(n).select(F.col("id").alias(ROW), F.col("id").cast("string").alias("id"), (F.col("id") / per).cast("long").cast("string").alias("up"), *(number(c).alias(c) for c in columns))
    tables = {"a": rows(150, 1, "w"), "b": rows(1200, 8, "p").withColumn("up", F.pmod(F.xxhash64(ROW), F.lit(150)).cast("string")), "c": rows(4800, 1, "x", "y", "v").withColumn("up", F.pmod(F.xxhash64(ROW), F.lit(1200)).cast("string"))}
    model = hierarchy.HierarchicalCopula({"a": "id", "b": "id", "c": None}, [ForeignKey("b", "up", "a", "id"), ForeignKey("c", "up", "b", "id")])
    model.fit(tables, {"a": {"w": "numerical"}, "b": {"p": "numerical"}, "c": {k: "numerical" for k in "xyv"}})
    level = model.levels["b"]
    own = range(len(level.kinds))
    correlation = lambda m: (m / np.sqrt(np.outer(np.diag(m), np.diag(m))))
    seen, drawn = correlation(level.spread.inside[np.ix_(own, own)]), correlation((level.factor @ level.factor.T)[np.ix_(own, own)])
    assert list(level.kinds) == ["p", "c#rows"] and np.allclose(np.diag(level.factor @ level.factor.T), 1 - level.effect**2)
    assert abs(drawn - seen).max() < 0.02, (seen, drawn)
