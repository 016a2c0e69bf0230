"""XLSX sheets by the standard library: zip archive and XML parts, cells as text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref.upper())[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _texts(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def sheet_rows(data: bytes, sheet: str = "") -> Iterator[tuple[int, list[str]]]:
    """(row ordinal, cell texts) of the named sheet, else of the first."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        book = ET.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), rels[s.get(f"{_REL}id")]) for s in book.iter(f"{_MAIN}sheet")]
        chosen = [t for n, t in sheets if not sheet or n == sheet]
        if not chosen:
            raise ValueError(f"no sheet {sheet!r}")
        target = chosen[0].lstrip("/")
        part = target if target in names else f"xl/{target}"
        shared = [_texts(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        for ordinal, row in enumerate(ET.fromstring(z.read(part)).iter(f"{_MAIN}row"), 1):
            cells: list[str] = []
            for k, c in enumerate(row.iter(f"{_MAIN}c")):
                at = _column(c.get("r")) if c.get("r") else k
                cells += [""] * (at + 1 - len(cells))
                kind, v = c.get("t"), c.find(f"{_MAIN}v")
                if kind == "inlineStr":
                    cells[at] = _texts(c)
                elif v is not None and v.text is not None:
                    cells[at] = shared[int(v.text)] if kind == "s" else {"0": "FALSE", "1": "TRUE"}.get(v.text, v.text) if kind == "b" else v.text
            yield int(row.get("r") or ordinal), cells
