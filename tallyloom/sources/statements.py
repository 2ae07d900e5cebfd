"""Bank statements in banking formats: CAMT.053, MT940 and XLSX, read and written.

A statement is one small file, parsed whole by one task; any number of files are parsed in parallel.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from decimal import Decimal
from xml.etree import ElementTree

import pandas as pd

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, bank_index int, reference string, value_date date, narration string, amount long"
Line = tuple[str, date, str, int]
_AMOUNT = re.compile(r"-?\d+(\.\d{1,2})?")


def paise(text: str) -> int:
    if not _AMOUNT.fullmatch(text):
        raise ValueError(f"not a rupee amount: {text}")
    return int(Decimal(text) * 100)


def camt053(data: bytes) -> Iterator[Line]:
    """Entries of a CAMT.053 document of any namespace; a DOCTYPE is refused before it is parsed."""
    if re.search(rb"<!\s*DOCTYPE", data, re.IGNORECASE):
        raise ValueError("a DOCTYPE is not allowed")
    root = ElementTree.fromstring(data)
    for element in root.iter():
        element.tag = element.tag.rpartition("}")[2]
    for entry in root.iter("Ntry"):
        pick = lambda *paths: next((x for p in paths if (x := entry.findtext(p))), None)  # noqa: B023, E731
        sign = {"CRDT": 1, "DBIT": -1}[pick("CdtDbtInd")]
        yield pick("NtryRef", "AcctSvcrRef") or "", date.fromisoformat(pick("ValDt/Dt", "BookgDt/Dt")), entry.findtext("AddtlNtryInf") or "", sign * paise(pick("Amt").strip())


#: The fields of a statement line after its tag, in the format's order, and how each looks.
_FIELDS = {"value date": "[0-9]{6}", "entry date": "([0-9]{4})?", "mark": "R?[CD]", "funds code": "[A-Z]?", "amount and type": "([0-9]+,[0-9]*)([A-Z0-9]{4})"}


def statement_line(text: str) -> tuple[str, date, int]:
    """Reference, value date and signed paise of a :61: line. The owner's reference ends at a double slash."""
    at, found = len(":61:"), {}
    for name, form in _FIELDS.items():
        part = re.compile(form).match(text, at)
        if not part:
            raise ValueError(f"no {name} in the statement line {text}")
        found[name], at = part, part.end()
    day, mark, (whole, _, cents) = found["value date"][0], found["mark"][0], found["amount and type"][1].partition(",")
    if len(cents) > 2:
        raise ValueError(f"more than two decimals in the statement line {text}")
    value = int(whole) * 100 + int((cents + "00")[:2])
    year = int(day[:2]) + (2000 if int(day[:2]) <= 79 else 1900)
    return text[at:].split("//", 1)[0].strip(), date(year, int(day[2:4]), int(day[4:])), value if mark.endswith("C") else -value


def mt940(data: bytes) -> Iterator[Line]:
    """Statement lines of an MT940 file; a reversal mark counts as its letter, a second :86: replaces the first."""
    head: tuple[str, date, int] | None = None
    narration = ""
    for text in [*data.decode().splitlines(), ":61:end"]:
        if text.startswith(":61:"):
            if head:
                yield head[0], head[1], narration, head[2]
            if text == ":61:end":
                return
            head, narration = statement_line(text), ""
        elif text.startswith(":86:"):
            narration = text[4:]


def sheet(data: bytes) -> list[list[object]]:
    """Cells of the first sheet of an XLSX file, as text or numbers."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        plain = lambda name: re.sub(rb'\sxmlns(:\w+)?="[^"]*"', b"", book.read(name))
        shared = [
            "".join(t.text or "" for t in s.iter("t")) for s in ElementTree.fromstring(plain("xl/sharedStrings.xml")).iter("si")
        ] if "xl/sharedStrings.xml" in book.namelist() else []
        first = min(n for n in book.namelist() if n.startswith("xl/worksheets/sheet"))
        rows = []
        for row in ElementTree.fromstring(plain(first)).iter("row"):
            cells: list[object] = []
            for c in row.iter("c"):
                column = 0
                for letter in re.match("[A-Z]+", c.get("r", "A"))[0]:
                    column = column * 26 + ord(letter) - 64
                cells += [None] * (column - len(cells))
                kind, value = c.get("t"), c.findtext("v")
                if kind == "inlineStr":
                    cells[column - 1] = "".join(t.text or "" for t in c.iter("t"))
                elif value is not None:
                    cells[column - 1] = shared[int(value)] if kind == "s" else value if kind == "str" else float(value)
            rows.append(cells)
    return rows


def xlsx(data: bytes) -> Iterator[Line]:
    """Lines of the first sheet below a header found in its first 20 rows; blank rows don't count."""
    from .files import BANK_ROLES, resolve_roles

    rows = sheet(data)
    for at, header in enumerate(rows[:20]):
        names = [str(h).strip().lower() if h is not None else "" for h in header]
        try:
            where = {role: names.index(column) for role, column in resolve_roles(names, BANK_ROLES).items()}
        except ValueError:
            continue
        for cells in rows[at + 1 :]:
            if all(c is None or c == "" for c in cells):
                continue
            own = {role: cells[k] if k < len(cells) else None for role, k in where.items()}
            day, amount = own["value_date"], own["amount"]
            day = date(1899, 12, 30) + timedelta(int(day)) if isinstance(day, float) else date.fromisoformat(str(day))
            yield str(own["reference"] or ""), day, str(own["narration"] or ""), paise(f"{amount:.2f}" if isinstance(amount, float) else str(amount))
        return
    raise ValueError("no header row")


PARSERS: dict[str, Callable[[bytes], Iterator[Line]]] = {"camt053": camt053, "mt940": mt940, "xlsx": xlsx}


def read_statements(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Bank lines of all files under a path."""
    parse = PARSERS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, content in zip(files.path, files.content, strict=True):
                lines = list(parse(content))
                if not lines:
                    raise ValueError(f"{name} has no lines")
                yield pd.DataFrame([(name, k, *line) for k, line in enumerate(lines)], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def to_camt053(lines: list[Line]) -> bytes:
    root = ElementTree.Element("Document", xmlns="urn:iso:std:iso:20022:tech:xsd:camt.053.001.02")
    statement = ElementTree.SubElement(ElementTree.SubElement(root, "BkToCstmrStmt"), "Stmt")
    for reference, day, narration, amount in lines:
        entry = ElementTree.SubElement(statement, "Ntry")
        ElementTree.SubElement(entry, "NtryRef").text = reference
        ElementTree.SubElement(entry, "Amt", Ccy="INR").text = f"{abs(amount) // 100}.{abs(amount) % 100:02}"
        ElementTree.SubElement(entry, "CdtDbtInd").text = "CRDT" if amount >= 0 else "DBIT"
        ElementTree.SubElement(ElementTree.SubElement(entry, "ValDt"), "Dt").text = day.isoformat()
        ElementTree.SubElement(entry, "AddtlNtryInf").text = narration
    return ElementTree.tostring(root, "utf-8")


def to_mt940(lines: list[Line]) -> bytes:
    out = [":20:STATEMENT", ":25:ACCOUNT", ":28C:1/1"]
    for reference, day, narration, amount in lines:
        out += [f":61:{day:%y%m%d}{'C' if amount >= 0 else 'D'}{abs(amount) // 100},{abs(amount) % 100:02}NTRF{reference}", f":86:{narration}"]
    return "\n".join(out).encode()


def to_xlsx(lines: list[Line]) -> bytes:
    from xml.sax.saxutils import escape

    text = lambda x: f'<c t="inlineStr" r="{{}}"><is><t>{escape(x)}</t></is></c>'
    rows = [["bank_reference", "value_date", "narration", "amount"]] + [[r, d.isoformat(), n, f"{'-' if a < 0 else ''}{abs(a) // 100}.{abs(a) % 100:02}"] for r, d, n, a in lines]
    body = "".join(f"<row>{''.join(text(x).format(f'{chr(65 + k)}{i}') for k, x in enumerate(row))}</row>" for i, row in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


