"""Every registered query of the library against its SQL on the smallest tables; the rest give rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from duneveil.plans import registry


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, tables, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = tables.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_queries_without_sql_are_known():
    assert sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)) == ["masked_report", "masked_twin", "synthetic_twin"]


def test_review_groups_are_decided(spark, sf_dir):
    (row,) = registry.QUERIES["review_groups"](spark, sf_dir).collect()
    assert row["auto"] == "replace" and row["code"] == "ids" and row["passed"] <= row["population"]
