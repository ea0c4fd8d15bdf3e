"""Sheets of an .xlsx workbook as rows of text, with the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
EPOCH = datetime(1899, 12, 30)


def cell_text(value: str, kind: str, is_date: bool, strings: list[str]) -> str:
    """A cell as text: shared strings, booleans in lower case, whole numbers without a fraction, dates in ISO form."""
    if kind == "s":
        return strings[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind in ("str", "inlineStr", "e", "d"):
        return value
    number = float(value)
    if is_date:
        moment = EPOCH + timedelta(seconds=round(number * 86_400))
        return moment.date().isoformat() if moment.time() == datetime.min.time() else moment.isoformat()
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId", 0)): f.get("formatCode", "") for f in root.iter(f"{MAIN}numFmt")}
    shows_date = lambda code: bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())))
    formats = root.find(f"{MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in formats] if formats is not None else []
    return [k in DATE_FORMATS or shows_date(own.get(k, "")) for k in ids]


def column_number(reference: str) -> int:
    out = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        out = 26 * out + ord(c) - 64
    return out - 1


def sheets(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(name, rows) of each sheet that holds anything; empty rows and empty columns at the end are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        strings = []
        if "xl/sharedStrings.xml" in book.namelist():
            strings = ["".join(t.text or "" for t in x.iter(f"{MAIN}t")) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        dates = _date_styles(book)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            target = targets[sheet.get(RELATION)].lstrip("/")
            rows = [_row(row, dates, strings) for row in ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{MAIN}row")]
            rows = [r for r in rows if any(c.strip() for c in r)]
            if rows:
                yield sheet.get("name"), rows


def _row(row, dates: list[bool], strings: list[str]) -> list[str]:
    out: list[str] = []
    for c in row.iter(f"{MAIN}c"):
        at = column_number(c.get("r")) if c.get("r") else len(out)
        kind, style = c.get("t", "n"), int(c.get("s", 0))
        text = "".join(t.text or "" for t in c.iter(f"{MAIN}t")) if kind == "inlineStr" else (v.text or "") if (v := c.find(f"{MAIN}v")) is not None else ""
        out += [""] * (at + 1 - len(out))
        out[at] = cell_text(text, kind, style < len(dates) and dates[style], strings) if text else ""
    return out


def write_workbook(tables: dict[str, tuple[list[str], Iterator[list[str]]]]) -> bytes:
    """A workbook of text cells: no cell is a formula."""
    escape = lambda s: re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    out, names = io.BytesIO(), [re.sub(r"[\[\]:*?/\\]", "_", n)[:31] or "sheet" for n in tables]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        sheet_type = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{sheet_type}.worksheet+xml"/>' for k in range(1, len(names) + 1))
        book.writestr(
            "[Content_Types].xml",
            f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{sheet_type}.sheet.main+xml"/>{parts}</Types>',
        )
        relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        rels = f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        book.writestr("_rels/.rels", f'{rels}<Relationship Id="rId1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", rels + "".join(f'<Relationship Id="rId{k}" Type="{relation}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{relation}"><sheets>{listed}</sheets></workbook>')
        for k, (columns, rows) in enumerate(tables.values(), 1):
            with book.open(f"xl/worksheets/sheet{k}.xml", "w") as file:
                file.write(f'{head}<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
                for row in (columns, *rows) if isinstance(rows, list) else _chain(columns, rows):
                    cells = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c or "")}</t></is></c>' for c in row)
                    file.write(f"<row>{cells}</row>".encode())
                file.write(b"</sheetData></worksheet>")
    return out.getvalue()


def _chain(columns: list[str], rows: Iterator[list[str]]) -> Iterator[list[str]]:
    yield columns
    yield from rows
