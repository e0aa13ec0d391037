"""Rows of a spreadsheet workbook (Office Open XML), read as a stream."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _targets(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet names in order, with the part of the archive each is in."""
    links = {e.get("Id"): e.get("Target") for e in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
    out = {}
    for e in ElementTree.parse(book.open("xl/workbook.xml")).getroot().iter():
        if _local(e.tag) == "sheet":
            target = links[e.get(_LINK)]
            out[e.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return out


def sheets(file) -> list[str]:
    with zipfile.ZipFile(file) as book:
        return list(_targets(book))


def _texts(e) -> str:
    """The text of a cell or shared string, without phonetic hints."""
    return "".join(t.text or "" for part in e if _local(part.tag) in ("t", "r") for t in ([part] if _local(part.tag) == "t" else part) if _local(t.tag) == "t")


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def records(file, sheet: str) -> Iterator[dict[str, str]]:
    """Rows after the first as {header: text}; empty cells are left out. Numbers are as the file has them, truth values 'true' and 'false'."""
    with zipfile.ZipFile(file) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            for _, e in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
                if _local(e.tag) == "si":
                    shared.append(_texts(e))
                    e.clear()
        header: dict[int, str] | None = None
        for _, e in ElementTree.iterparse(book.open(_targets(book)[sheet])):
            if _local(e.tag) != "row":
                continue
            row: dict[int, str] = {}
            for i, c in enumerate(c for c in e if _local(c.tag) == "c"):
                value = next((v.text for v in c if _local(v.tag) == "v"), None)
                inline = next((v for v in c if _local(v.tag) == "is"), None)
                kind = c.get("t")
                if inline is not None:
                    value = _texts(inline)
                elif value is not None and kind == "s":
                    value = shared[int(value)]
                elif value is not None and kind == "b":
                    value = "true" if value == "1" else "false"
                if value is not None and kind != "e":
                    row[_column(c.get("r")) if c.get("r") else i] = value
            e.clear()
            if header is None:
                header = row
            elif row:
                yield {header[k]: v for k, v in row.items() if k in header}
