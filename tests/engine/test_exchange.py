"""Tokens, returns, files, exports, pages, guards."""

from __future__ import annotations

import logging

import pytest
from pyspark.sql import functions as F

from duneveil.operators import guards, returns, tokens, viewer
from duneveil.operators.tables import ROW, ForeignKey
from duneveil.sources import files, sinks, workbook

KEY = b"a key for tests, thirty-two or more"
SEALER = tokens.Sealer("share", "data", 3, KEY)


@pytest.mark.parametrize("key", ["0", "7", "007", "123456789", "9" * 38, "9" * 39, "A-17", "س١", ""])
def test_references_round_trip(key):
    packed = tokens.pack(5, key)
    assert tokens.unpack(packed) == (5, key)
    assert SEALER.open(SEALER.seal(packed)) == (5, key) if key else True


def test_tokens_are_sealed():
    t = SEALER.seal(tokens.pack(0, "42"))
    assert t == SEALER.seal(tokens.pack(0, "42")) and t.startswith("NZ-")
    assert SEALER.opened(t.lower())[0] == "verified"
    for k in range(len("NZ-") + 8, len(t)):
        bad = t[:k] + ("A" if t[k] != "A" else "B") + t[k + 1 :]
        assert SEALER.opened(bad)[0] in ("invalid", "foreign")
    assert tokens.Sealer("other", "data", 3, KEY).opened(t)[0] == "foreign"
    assert tokens.Sealer("share", "data", 4, KEY).opened(t)[0] == "invalid"
    assert tokens.Sealer("share", "data", 3, None).opened(t)[0] == "old_key"
    with pytest.raises(tokens.TokenError):
        SEALER.open("NZ-AAAA")
    with pytest.raises(ValueError, match="tables"):
        tokens.pack(128, "1")


@pytest.fixture(scope="module")
def shared(spark):
    rows = spark.createDataFrame([(k, f"k{k}", f"name {k}", str(k * 10)) for k in range(20)], f"{ROW} long, id string, name string, amount string")
    twins = {"t": tokens.add_references(rows, "id").drop("id")}
    return rows, twins, tokens.for_share(twins, SEALER)["t"]


def test_statuses_of_a_return(spark, shared):
    rows, twins, sheet = shared
    got = sorted(sheet.collect(), key=lambda r: r[ROW])
    own = [r[tokens.TOKEN_COLUMN] for r in got]
    foreign = [tokens.Sealer("else", "data", 3, KEY).seal(tokens.pack(0, f"k{k}")) for k in (0, 1)]
    sent = [own[0][:-2] + ("AA" if own[0][-2:] != "AA" else "BB"), None, *own[2:], own[2], *foreign]
    back = spark.createDataFrame([(k, t, "changed" if k == 5 else f"name {k}", str(k)) for k, t in enumerate(sent)], f"{ROW} long, `Record Token` string, name string, score string")
    verified, report = returns.verify({"sheet": back}, twins, SEALER)
    assert report["counts"] == {"verified": 18, "invalid": 1, "missing": 1, "foreign": 2, "duplicate": 1, "old_key": 0}
    assert report["integrity"] == round(18 / 23, 4) and report["coverage"] == round(23 / 20, 4)
    assert report["added_columns"] == {"t": ["score"]} and report["rows_changed_in_twin_columns"] == 1 and report["rows_by_status"]["duplicate"] == [21]
    out, counts = returns.relink(verified, report, {"t": rows.filter("id <> 'k19'")}, {"t": "ID"})
    assert counts == {"linked": 17, "original_not_found": 1}
    assert {(r["id"], r["name"], r["score"]) for r in out["t"].collect() if r["id"]} == {(f"k{k}", f"name {k}", str(k)) for k in range(2, 19)}


def test_returns_that_cant_be_used(spark, shared):
    rows, twins, sheet = shared
    with pytest.raises(returns.ReturnError) as e:
        returns.verify({"s": rows}, twins, SEALER)
    assert e.value.code == "token_column_missing"
    _, report = returns.verify({"s": sheet}, twins, tokens.Sealer("share", "data", 3, None))
    assert report["counts"]["old_key"] == 20
    with pytest.raises(returns.ReturnError) as e:
        returns.relink(rows, report, {"t": rows}, {"t": "id"})
    assert e.value.code == "relink_no_verified"
    assert returns.complete_report({"rows_returned": 3})["legacy"] and not returns.complete_report(report)["legacy"]


# ------------------------------------------------------------------ files


def test_files_of_any_layout(spark, tmp_path):
    book = workbook.write_workbook({"Sheet A": (["id", "اسم"], [["1", "محمد"], ["2", "=1+2 <&>"]]), "B": (["k", "v"], [["x", "1"], ["y", "2"]])})
    made = {
        "plain.csv": "id,name\n1,a\n2,\n".encode(), "arabic.csv": "رقم;اسم\n1;محمد\n2;سارة\n".encode("cp1256"), "wide.txt": "تقرير\n\nid\tname\tcity\n1\tx\ty\n2\tz\t\n3\tq\tw\n4\tq\tw\n".encode("utf-16"),
        "no header.csv": b"1,2,3\n4,5,6\n", "ragged.csv": b'\xef\xbb\xbfid,id, \n1,"a\nb"\n2,x,y\n,,\n', "book.xlsx": book,
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    got = files.read_files(spark, [str(tmp_path / n) for n in made])
    notes = {n.table: n for n in got.notes}
    rows = {t: [tuple(r)[:-1] if df.columns[-1] == ROW else tuple(r[c] for c in df.columns if c != ROW) for r in df.orderBy(ROW).collect()] for t, df in got.tables.items()}
    assert rows["plain"] == [("1", "a"), ("2", None)]
    assert rows["arabic"] == [("1", "محمد"), ("2", "سارة")] and notes["arabic"].encoding == "windows-1256" and notes["arabic"].delimiter == ";"
    assert notes["wide"].skipped_title_rows == 1 and notes["wide"].encoding == "utf-16" and [c for c in got.tables["wide"].columns if c != ROW] == ["id", "name", "city"]
    assert notes["no_header"].header == "generated" and len(rows["no_header"]) == 2
    assert [c for c in got.tables["ragged"].columns if c != ROW] == ["id", "id_2", "col_3"] and rows["ragged"][0] == ("1", "a\nb", None)
    assert rows["Sheet_A"] == [("1", "محمد"), ("2", "=1+2 <&>")] and rows["B"] == [("x", "1"), ("y", "2")]
    assert {r["source"] for r in got.report()} == set(made)


@pytest.mark.parametrize(
    ("name", "data", "code"),
    [("a.csv", b"  \n", "empty_file"), ("a.csv", b"\xff\xfe"[::-1][:1] + b"\x80\x00\x01x,\n", "binary_file"), ("a.xls", b"x", "old_excel"), ("a.pdf", b"x", "unsupported_type"), ("a.xlsx", b"PK\x03\x04junk", "bad_excel"), ("a.csv", b"id,name\n", "no_data"), ("a.csv", b"x" * 200, "file_too_large")],
)
def test_files_that_cant_be_read(spark, tmp_path, name, data, code):
    (tmp_path / name).write_bytes(data)
    with pytest.raises(files.IngestError) as e:
        files.read_files(spark, [str(tmp_path / name)], files.Limits(file_bytes=100))
    assert e.value.code == code


def test_limits_of_an_upload(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"id,name\n1,a\n2,b\n")
    for limits, code in ((files.Limits(rows=1), "too_many_rows"), (files.Limits(columns=1), "too_many_columns"), (files.Limits(total_bytes=3), "total_too_large")):
        with pytest.raises(files.IngestError) as e:
            files.read_files(spark, [str(tmp_path / "a.csv")], limits)
        assert e.value.code == code
    with pytest.raises(files.IngestError, match="no_files"):
        files.read_files(spark, [])


def test_exports_are_guarded(spark, tmp_path):
    df = spark.createDataFrame([(0, "=SUM(A1)", "-12.5"), (1, "@x", "+1,000"), (2, None, "a,b\"c\nd")], f"{ROW} long, `=h` string, n string")
    got = sinks.safe_table(df).orderBy(ROW).collect()
    assert [tuple(r)[1:] for r in got] == [("'=SUM(A1)", "-12.5"), ("'@x", "+1,000"), ("", "a,b\"c\nd")] and "'=h" in got[0].asDict()
    sinks.export_csv({"t": df}, str(tmp_path))
    back = files.csv_folder(spark, str(tmp_path), ["t"])["t"].orderBy(ROW).collect()
    assert back[2]["n"] == "a,b\"c\nd" and back[0]["'=h"] == "'=SUM(A1)"
    path = sinks.export_workbook({"t": df}, str(tmp_path / "t.xlsx"))
    assert dict(workbook.sheets(open(path, "rb").read()))["t"][1] == ["'=SUM(A1)", "-12.5"]
    marks = spark.createDataFrame([("t", "n", 1, "review")], f"table string, column string, {ROW} long, mark string")
    sinks.write_table_set({"t": df}, str(tmp_path / "set"), marks)
    tables, read, meta = sinks.read_table_set(spark, str(tmp_path / "set"))
    assert tables["t"].count() == 3 and read.count() == 1 and meta["order"] == ["t"]


def test_files_are_numbered_by_name_and_not_by_size(spark, tmp_path):
    (tmp_path / "t.csv").mkdir()
    parts = [range(2), range(2, 40), range(40, 43), range(43, 200)]  # Spark reads the largest first
    for k, part in enumerate(parts):
        (tmp_path / "t.csv" / f"part-{k}.csv").write_text("first,p\n" + "".join(f"{n},x\n" for n in part), encoding="utf-8")
    for multiline in (True, False):
        back = files.csv_folder(spark, str(tmp_path), ["t"], multiline)["t"]
        assert back.columns == ["first", "p", ROW]
        assert sorted((r[ROW], r["first"]) for r in back.collect()) == [(n, str(n)) for n in range(200)]



def test_database_targets():
    keys = [ForeignKey("claims", "p", "people", "id"), ForeignKey("items", "c", "claims", "id")]
    assert sinks.parents_first(["items", "claims", "people"], keys) == ["people", "claims", "items"]
    assert sinks.guarded_target("prod", "twin") == "twin"
    for bad in ("PROD", "mysql", "a; drop"):
        with pytest.raises(ValueError, match="target|name"):
            sinks.guarded_target("prod", bad)


def test_column_types(spark):
    df = spark.createDataFrame([(0, "1", "1.5", "2024-01-02", "x", "y" * 300, None), (1, "-20", "2", "2024-03-01", None, "z", None)], f"{ROW} long, a string, b string, c string, d string, e string, f string")
    assert sinks.column_types(df) == {"a": "BIGINT", "b": "DOUBLE", "c": "DATE", "d": "VARCHAR(255)", "e": "TEXT", "f": "VARCHAR(255)"}


# ------------------------------------------------------------------ pages and guards


def test_pages(spark):
    df = spark.createDataFrame([(k, f"{k},000" if k % 2 else str(k), "Even" if k % 2 == 0 else "odd") for k in range(45)] + [(45, None, None)], f"{ROW} long, n string, w string")
    rows, info = viewer.page(df, 9, 3, "even", "n", True)
    assert info == {"total": 23, "page": 3, "pages": 3, "size": 10} and [r["n"] for r in rows.collect()] == ["4", "2", "0"]
    assert viewer.page(df, 1, 500)[1]["size"] == 100
    marks = spark.createDataFrame([("t", "w", 1, "review")], f"table string, column string, {ROW} long, mark string")
    got = {(r[ROW], r["column"]): r["mark"] for r in viewer.cell_marks(df.limit(3), "t", marks, ["n"]).collect()}
    assert got[1, "w"] == "review" and got[0, "n"] == "replaced" and got[0, "w"] == "none"


def test_retention(spark):
    twins = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-01"), (3, "2024-01-20")], "twin_id int, d string").withColumn("created", F.to_timestamp("d"))
    shares = spark.createDataFrame([(2, True), (1, False)], "twin_id int, active boolean")
    assert [r["twin_id"] for r in viewer.expired(twins, shares, F.lit("2024-01-21").cast("timestamp")).collect()] == [1]


def test_keys_and_logs(monkeypatch):
    monkeypatch.delenv("DUNEVEIL_KEY", raising=False)
    with pytest.raises(guards.ConfigError):
        guards.load_key()
    monkeypatch.setenv("DUNEVEIL_KEY", "x" * 32)
    assert guards.load_key() == b"x" * 32
    record = logging.LogRecord("n", 20, "f", 1, "id %s mail %s", ("1110704341", "a@b.co"), None)
    assert guards.RedactingFilter().filter(record) and record.getMessage() == "id *** mail ***"
    assert guards.audit_value("1110704341") == "redacted" and guards.audit_value("ok") == "ok"
