"""The pipeline's stages on a small fixture with planted cases, and its queries on the smallest tables."""

from __future__ import annotations

import random

import corpus_pipeline
import duckdb
import pytest

import __spark_entry__

from .test_operators import SCHEMA, invented


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(21)
    folder = tmp_path_factory.mktemp("planted")
    rows, labels = [], []

    def add(text, toxic=None):
        k = len(rows)
        rows.append((k, text, "en", f"s{k % 2}", len(text or "")))
        if toxic is not None:
            labels.append((k, toxic))
        return k

    for _ in range(300):
        bad = rng.random() < 0.3
        w = invented(rng, 40, 10**6)
        if bad:
            w[5] = w[20] = rng.choice(["grimwort", "sludgeling"])
        add("Header line\n" + " ".join(w), int(bad))
    item = " ".join(invented(rng, 40, 10**6))
    case = {
        "toxic": add(" ".join([*invented(rng, 30, 10**6), "grimwort", "sludgeling", "grimwort"])),
        "copy": [add("copied " + " ".join(invented(rng, 60, 10**6)))],
        "leak": add(" ".join(invented(rng, 30, 10**6)) + " " + item),
        "clean": add(" ".join(invented(rng, 50, 10**6))),
        "empty": [add(None), add("")],
    }
    for _ in range(5):
        case["copy"].append(add(rows[case["copy"][0]][1]))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), case


def test_each_stage_takes_its_cases_and_leaves_the_rest(spark, planted):
    folder, case = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, folder), "test")
        after[name] = {r.doc_id: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert case["toxic"] not in after["toxicity"] and case["clean"] in after["toxicity"]
    assert set(after["line_dedup"]) == set(after["toxicity"])
    assert not after["line_dedup"][next(iter(set(after["line_dedup"]) & set(range(300))))].text.startswith("Header line")
    assert [k for k in case["copy"] if k in after["near_dedup"]] == case["copy"][:1]
    assert case["leak"] in after["near_dedup"] and case["leak"] not in after["decontamination"]
    assert set(case["empty"]) | {case["clean"]} <= set(after["decontamination"])
    assert set(after["mixing"]) <= set(after["decontamination"]) and all(r.copies >= 1 for r in after["mixing"].values())


def test_a_frame_line_of_a_twentieth_of_a_hot_source_goes(spark):
    rng = random.Random(22)
    rows = [(k, ("Part of the archive\nYes.\n" if k % 20 == 0 else "") + "\n".join(" ".join(invented(rng, 8, 10**6)) for _ in range(5)), "en", "hot", 0) for k in range(400)]
    rows += [(400 + k, "Part of the archive\n" + " ".join(invented(rng, 8, 10**6)) + "\nmore of it", "en", f"s{k}", 0) for k in range(4)]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_frame_lines(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    for k, text, *_ in rows:
        assert got[k] == (text.replace("Part of the archive\n", "") if k < 400 else text)


def test_short_pages_lose_their_frame_and_copies_stay_whole(spark):
    rng = random.Random(23)
    own = ["\n".join(" ".join(invented(rng, 6, 10**6)) for _ in range(2)) for _ in range(200)]
    rows = [(k, f"Home and news\n{x}\nAll rights are ours\nWrite to us", "en", "s", 0) for k, x in enumerate(own)]
    copy = "\n".join(" ".join(invented(rng, 8, 10**6)) for _ in range(6))
    rows += [(200 + k, copy, "en", "s", 0) for k in range(30)] + [(230, "Home and news\nWrite to us", "en", "s", 0)]
    rows += [(231 + k, f"Home and news\n{copy}\n" + " ".join(invented(rng, 5, 10**6)), "en", "s", 0) for k in range(30)]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_frame_lines(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    for k, text, *_ in rows:
        assert got[k] == (own[k] if k < 200 else text if k <= 230 else text.replace("Home and news\n", ""))


def test_run_equals_the_stages(spark, planted):
    folder, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, folder), "test")
    assert sorted(docs.collect(), key=str) == sorted(corpus_pipeline.run(spark, folder).collect(), key=str)


@pytest.mark.parametrize("name", sorted(x for x in __spark_entry__.queries() if x.startswith("op")))
def test_query_on_the_smallest_tables(spark, sf_dir, name):
    df = __spark_entry__.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert rows
    if name in (sql := __spark_entry__.oracle_sql()):
        con = duckdb.connect()
        for t in ("documents", "pages", "conversations", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
        found = con.sql(sql[name])
        columns = sorted(df.columns)
        assert columns == sorted(found.columns)
        want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql[name]})").fetchall()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in columns)) for r in rows)


def test_rows_that_share_an_id_or_have_none_are_judged_by_their_own_texts(spark, planted):
    folder, _ = planted
    rng = random.Random(41)
    leak = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    own = [" ".join(invented(rng, 40, 10**6)) for _ in range(4)]
    rows = [(1, own[0]), (1, own[1]), (1, own[1]), (None, own[2]), (None, own[3]), (None, leak), (2, own[2]), (2, leak), (3, None), (3, None), (4, "")]
    extra = SCHEMA + ", key string, gone int, site string, n_dropped int, kept_text string, prints string, size int, target string, weight int, u double, rank int, k int"
    table = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x", 1, "y", 2, "z", "p", 3, "t", 4, 0.5, 5, 6]) for i, t in rows], extra)
    left = lambda stage: sorted(((r.doc_id, r.text) for r in stage(spark, table, folder).collect()), key=str)
    want = lambda x: sorted(x, key=str)
    assert left(corpus_pipeline.drop_toxic) == want(rows)
    assert left(corpus_pipeline.drop_frame_lines) == want(rows)
    assert left(corpus_pipeline.drop_near_copies) == want([(1, own[0]), (1, own[1]), (2, own[2]), (None, own[3]), (2, leak), (3, None), (3, None), (4, "")])
    assert left(corpus_pipeline.drop_leaks) == want([x for x in rows if x[1] != leak])
    mixed = corpus_pipeline.take_mix(spark, table, folder)
    assert set(table.columns) <= set(mixed.columns) and len(set(mixed.columns)) == len(mixed.columns)
    assert all(r.taken == r.copies * r.size and r.key == "x" and r.rank == 5 for r in mixed.collect())
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, folder)
        assert set(table.columns) <= set(out.columns)
        assert stage(spark, table.limit(0), folder).count() == 0


def test_columns_of_any_type_and_long_texts_pass_every_stage(spark, planted):
    folder, _ = planted
    rng = random.Random(43)
    long = " ".join(invented(rng, 60_000, 10**6))
    odd = ["MAP('a', doc_id) AS tags", "ARRAY(1.5D, NULL) AS list", "NAMED_STRUCT('x', 1) AS pair", "X'00FF' AS raw", "TIMESTAMP'2024-01-01 00:00:00' AS at"]
    rows = [(1, long), (1, long), (2, "one two three four five six"), (2, "one two three four five six"), (None, "seven eight nine ten eleven twelve"), (3, None)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).selectExpr("*", *odd)
    got = corpus_pipeline.drop_near_copies(spark, table, folder)
    assert sorted((r.doc_id, r.text, r.tags) for r in got.collect() if r.doc_id) == sorted([(1, long, {"a": 1}), (2, rows[2][1], {"a": 2}), (3, None, {"a": 3})])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, folder)
        assert set(table.columns) <= set(out.columns) and all(bytes(r.raw) == b"\x00\xff" for r in out.collect())
        assert stage(spark, table.limit(0), folder).count() == 0
