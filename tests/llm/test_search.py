"""Bit-sliced search: against plain Python over whole texts, and against the SQL."""

from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duneveil.llm import oracle, queries, search


def plain(docs, items, k=10):
    """[(item, rank, doc, score)] of rows (id, text), one score after the other."""
    held = [(d, Counter(search.terms_of(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in search.terms_of(text) if t in c)
            if score:
                scored.append((-score, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def test_terms_of_arrow_are_those_of_python():
    texts = ["", "Ab-c d_E ÄÖ x9\x00y", "日本 (語)", "…a", None, " .,", "A" * 1000 + "\t\x1cz"]
    got = search.split_terms(pa.array([t or "" for t in texts], pa.large_utf8())).to_pylist()
    assert [[w for w in x if w] for x in got] == [search.terms_of(t) for t in texts]


def test_carries_add_any_impacts_and_the_best_are_found():
    rng = np.random.default_rng(3)
    impact = rng.integers(0, 1 << 34, (6, 130)) * (rng.random((6, 130)) < 0.4)
    impact[5] = 0
    impact[:, 7] = impact[:, 9]  # ties
    terms, slots = np.nonzero(impact[:5])
    values = impact[terms, slots]
    slices = (values >> np.arange(34)[:, None] & 1).astype(bool)
    owner, word, held = search.bitmaps(np.arange(5), np.searchsorted(terms, np.arange(6)), slots, slices, 3)
    dense = np.zeros((6, 34, 3), np.uint64)
    dense[owner, :, word] = held
    wanted = rng.integers(0, 6, (40, 11))
    total = search.scores(dense, wanted)
    want = impact[wanted].sum(1)
    item, slot, score = search.best(total, 10)
    for i in range(40):
        order = sorted((-v, s) for s, v in enumerate(want[i]) if v)[:10]
        assert sorted(zip(-score[item == i], slot[item == i], strict=True)) == order


@pytest.mark.parametrize("block", [7, 64, 2048])
def test_search_equals_plain_python(spark, block):
    rng = random.Random(8)
    word = lambda: f"w{min(int(rng.paretovariate(0.6)), 60)}"
    docs = [(k, " ".join(word() for _ in range(rng.randrange(0, 40)))) for k in range(150)]
    docs += [(200 + k, docs[3][1]) for k in range(14)] + [(None, docs[3][1].upper()), (7, docs[8][1]), (900, None), (901, "")]  # ties, repeated and null ids
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 25)))) for k in range(12)] + [(None, "w1 W1 w1"), (50, None), (51, "nowhere"), (3, docs[3][1])]
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({"item": F.lit(1), "score": F.lit("clash")})
    right = spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert found(search.search(left, right, block=block)) == want
    assert found(search.search(left, right, block=block, most=1)) == want  # a round for each item


def test_long_texts_and_text_ids(spark, monkeypatch):
    docs = [("a", "x " * 50_000 + "y"), ("b", "x y"), ("c", "z" * 100_000)]
    got = found(search.search(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([("q", "x y")], "item_id string, text string")))
    assert got == plain(docs, [("q", "x y")])


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(docs, items).collect() == []
    assert search.search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).collect() == []
    assert search.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, folder):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS FROM '/root/testdata/{folder}/{name}.parquet'")
    got = queries.op11_bit_sliced_search(spark, f"/root/testdata/{folder}")
    want = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({oracle.SQL['op11_bit_sliced_search']})").fetchall()
    assert found(got) == sorted(want, key=repr) and len(want) > 300
