"""Returns as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from duneveil.operators import tokens
from duneveil.operators.tables import ROW
from duneveil.streaming import returned

SEALER = tokens.Sealer("share", "data", 1, b"a key for tests, thirty-two or more")


def test_each_reference_is_passed_once(spark, tmp_path):
    rows = spark.createDataFrame([(k, str(k), f"n{k}") for k in range(6)], f"{ROW} long, id string, name string")
    shared = tokens.for_share({"t": tokens.add_references(rows, "id").drop("id")}, SEALER)["t"]
    sent = [(r[tokens.TOKEN_COLUMN], r["name"]) for r in sorted(shared.collect(), key=lambda r: r[ROW])]
    sent += [sent[0], ("NZ-AAAA", "bad")]
    columns = [tokens.TOKEN_COLUMN, "name"]
    for k, part in enumerate((sent[:4], sent[4:])):
        spark.createDataFrame(part, columns).coalesce(1).write.option("header", True).csv(str(tmp_path / "in" / str(k)))
    stream = returned.opened(returned.read_returns(spark, str(tmp_path / "in" / "*"), columns), SEALER)
    query = returned.start(returned.first_sightings(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["row_key"] for r in got.select("row_key").collect()) == [str(k) for k in range(6)]
    batch = returned.opened(spark.createDataFrame(sent, columns), SEALER)
    assert batch.filter(F.col("status") == "verified").count() == 7
