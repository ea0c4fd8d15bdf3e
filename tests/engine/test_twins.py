"""Twins are stored whole or not at all, and no original outlives its session."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from duneveil.operators import sessions
from duneveil.operators.policy import DEFAULT, policy_from_dict
from duneveil.operators.tables import ROW, as_text, shared_dir, written
from duneveil.plans import fixtures, masking, twins
from duneveil.sources import sinks

KEY = b"a key of this test"


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    people = fixtures.people(spark, sf_dir).filter("person_id <= 60").drop("balance").withColumn(ROW, F.col("person_id").cast("long"))
    claims = fixtures.claims(spark, sf_dir).filter("person_id <= 60").drop("amount").withColumn(ROW, F.col("claim_id").cast("long"))
    return {"people": as_text(people), "claims": as_text(claims)}


def files_of(spark):
    return glob.glob(f"{shared_dir(spark).removeprefix('file://')}/sessions/**/*.parquet", recursive=True)


def test_sessions_delete_what_they_wrote(spark):
    session = sessions.begin(spark)
    with sessions.using(session):
        inside = written(spark.range(5), "inside")
    outside = written(spark.range(5), "outside")
    assert inside.count() == 5 and len(names := sessions.names_in(spark, f"{session.folder}/tables")) == 1 and names[0].startswith("inside")
    session.hold("reader")
    assert session.end() is False and inside.count() == 5
    with pytest.raises(ValueError, match="ended"):
        session.hold("another")
    session.release("reader")
    assert sessions.names_in(spark, session.folder) == [] and outside.count() == 5 and session.end() is True


def test_sessions_that_nobody_ends_are_swept(spark):
    late, early = sessions.begin(spark, 100, now=1_000.0), sessions.begin(spark, 10, now=1_000.0)
    early.hold("a lost driver")
    assert early.name in (gone := sessions.sweep(spark, now=1_050.0)) and late.name not in gone
    assert late.name in sessions.sweep(spark, now=1_100.0)


def test_twin_is_stored_replaced_and_kept_when_shared(spark, tables, tmp_path, monkeypatch):
    folder, policy = f"file://{tmp_path}", policy_from_dict(DEFAULT)
    twin = twins.generate_twin(tables, folder, "d1", policy, KEY, twins.Options(cleaning={"trim": True}))
    assert twin.verdict == "PASS" and twin.report["generation"]["link"] == {"table": "people", "column": "person_id"} and not files_of(spark)
    told, stored, marks = twins.load(spark, folder, twin.name)
    assert told == twin and stored["claims"].count() == tables["claims"].count() and marks.count() > 0
    originals = {r["national_id"] for r in tables["people"].collect()}
    assert not originals & {r["national_id"] for r in stored["people"].collect()}
    assert twin.report["generation"]["references"] == {"people": "person_id", "claims": "claim_id"}

    # a run that dies while it writes leaves the old twin, and nothing of its own
    real = sinks.write_table_set
    monkeypatch.setattr(sinks, "write_table_set", lambda *a, **k: (real(*a, **k), 1 / 0))
    with pytest.raises(ZeroDivisionError):
        twins.generate_twin(tables, folder, "d1", policy, KEY, replaces=twin.name)
    monkeypatch.undo()
    assert twins.load(spark, folder, twin.name)[0] == twin and len([x for x in os.listdir(tmp_path / twin.name) if x.startswith("v-")]) == 1 and not files_of(spark)

    copies, marks = {t: written(df, t) for t, df in stored.items()}, written(marks, "marks")  # the run itself is not repeated
    monkeypatch.setattr(masking, "run_masked", lambda *a, **k: masking.RunResult(dict(copies), twin.report, marks))
    again = twins.generate_twin(tables, folder, "d1", policy, KEY, replaces=twin.name)
    assert again.name == twin.name and again.version != twin.version and len([x for x in os.listdir(tmp_path / twin.name) if x.startswith("v-")]) == 1
    assert twins.share(spark, folder, twin.name).shared
    beside = twins.generate_twin(tables, folder, "d1", policy, KEY, replaces=twin.name)
    assert beside.name != twin.name and twins.find(spark, folder, twin.name).version == again.version
    assert twins.generate_twin(tables, folder, "d2", policy, KEY, replaces=beside.name).name != beside.name

    leaked = twin.report | {"withheld": True, "verdict": "FAIL"}
    monkeypatch.setattr(masking, "run_masked", lambda *a, **k: masking.RunResult(dict(copies), leaked, marks))
    held = twins.generate_twin(tables, folder, "d1", policy, KEY)
    assert held.version is None and twins.load(spark, folder, held.name)[1] == {}
    with pytest.raises(twins.TwinError, match="not_shareable"):
        twins.share(spark, folder, held.name)
    assert twins.purge(spark, folder, beside.name).version is None and twins.load(spark, folder, beside.name)[1] == {}


def test_refused_runs(spark, tables, tmp_path):
    policy = policy_from_dict(DEFAULT)
    for options, code in ((twins.Options("other"), "unknown_mode"), (twins.Options("synthetic", most_synthetic=10), "too_large")):
        with pytest.raises(twins.TwinError, match=code):
            twins.generate_twin(tables, f"file://{tmp_path}", "d", policy, KEY, options)
    with pytest.raises(twins.TwinError, match="no_twin"):
        twins.find(spark, f"file://{tmp_path}", "nobody")
