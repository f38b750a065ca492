"""Cells of one OOXML workbook as text, row by row.

A small helper for the landing task: it streams the sheet XML and keeps only
the shared strings and date styles of the workbook in memory.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

_DATE_FORMAT_IDS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_NOT_DATE_PARTS = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.')
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _children(node, name: str):
    return [child for child in node.iter() if _local(child.tag) == name]


def _parse(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _text(node) -> str:
    """Text of a string item: its runs joined, phonetic hints left out."""
    out = []
    for child in node:
        tag = _local(child.tag)
        if tag == "t":
            out.append(child.text or "")
        elif tag == "r":
            out.extend(part.text or "" for part in child if _local(part.tag) == "t")
    return "".join(out)


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    styles = _parse(book, "xl/styles.xml")
    if styles is None:
        return set()
    custom = {
        int(fmt.get("numFmtId"))
        for fmt in _children(styles, "numFmt")
        if re.search("[dmyhs]", _NOT_DATE_PARTS.sub("", fmt.get("formatCode", "")).lower())
    }
    dates = _DATE_FORMAT_IDS | custom
    formats = [xf for group in _children(styles, "cellXfs") for xf in group]
    return {i for i, xf in enumerate(formats) if int(xf.get("numFmtId", "0")) in dates}


def _number(raw: str, is_date: bool, epoch: datetime) -> str:
    if is_date:
        serial = float(raw)
        try:
            moment = epoch + timedelta(milliseconds=round(serial * 86_400_000))
        except OverflowError:
            return raw
        return moment.strftime("%H:%M:%S") if 0 <= serial < 1 else f"{moment:%Y-%m-%d %H:%M:%S}"
    if re.fullmatch(r"-?\d+", raw):
        return raw
    return repr(float(raw))


def _column(ref: str) -> int:
    index = 0
    for char in ref:
        if not char.isalpha():
            break
        index = index * 26 + ord(char.upper()) - 64
    return index - 1


def _cell(node, strings: list[str], dates: set[int], epoch: datetime) -> str | None:
    kind = node.get("t", "n")
    if kind == "inlineStr":
        return next((_text(child) for child in node if _local(child.tag) == "is"), None)
    raw = next((child.text for child in node if _local(child.tag) == "v"), None)
    if raw is None:
        return None
    if kind == "s":
        return strings[int(raw)]
    if kind == "b":
        return "True" if raw == "1" else "False"
    if kind == "d":
        return raw.replace("T", " ")[:19]
    if kind == "n":
        return _number(raw, int(node.get("s", "0")) in dates, epoch)
    return raw


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """``(sheet, row number, cells)`` of every filled row, and of the first row of each blank run.

    Each sheet starts with a marker row 0 without cells, so that an empty sheet
    is known to exist.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _parse(book, "xl/sharedStrings.xml")
        strings = [] if shared is None else [_text(item) for item in shared]
        dates = _date_styles(book)
        workbook = _parse(book, "xl/workbook.xml")
        links = {rel.get("Id"): rel.get("Target") for rel in _parse(book, "xl/_rels/workbook.xml.rels")}
        old_epoch = any(pr.get("date1904") in ("1", "true") for pr in _children(workbook, "workbookPr"))
        epoch = datetime(1904, 1, 1) if old_epoch else datetime(1899, 12, 30)
        for sheet in _children(workbook, "sheet"):
            name, target = sheet.get("name"), links[sheet.get(_REL)]
            yield name, 0, []
            path = target.lstrip("/") if target.startswith("/") else "xl/" + target
            number, blank = 0, False
            with book.open(path) as stream:
                for _, node in ElementTree.iterparse(stream):
                    if _local(node.tag) != "row":
                        continue
                    last, number = number, int(node.get("r", number + 1))
                    if number > last + 1 and not blank:
                        blank = True
                        yield name, last + 1, []
                    cells: list[str | None] = []
                    for cell in node:
                        at = _column(cell.get("r")) if cell.get("r") else len(cells)
                        cells.extend([None] * (at - len(cells)))
                        cells.append(_cell(cell, strings, dates, epoch))
                    if any(value is not None for value in cells):
                        blank = False
                        yield name, number, cells
                    elif not blank:
                        blank = True
                        yield name, number, []
                    node.clear()
