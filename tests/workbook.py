"""Write small OOXML workbooks for the landing tests, with the standard library alone."""

from __future__ import annotations

import zipfile
from datetime import datetime
from xml.sax.saxutils import escape

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _ref(row: int, col: int) -> str:
    letters = ""
    col += 1
    while col:
        col, rest = divmod(col - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row}"


def _cell(row: int, col: int, value, strings: list[str]) -> str:
    ref = _ref(row, col)
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, datetime):
        serial = (value - datetime(1899, 12, 30)).total_seconds() / 86400
        return f'<c r="{ref}" s="1"><v>{serial!r}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    if value.startswith("#"):
        return f'<c r="{ref}" t="e"><v>{escape(value)}</v></c>'
    if value.startswith("inline:"):
        return f'<c r="{ref}" t="inlineStr"><is><t>{escape(value[7:])}</t></is></c>'
    strings.append(value)
    return f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'


def write_workbook(path: str, sheets: dict[str, dict[int, list]]) -> None:
    """``sheets`` maps a sheet name to ``{row number: values}``."""
    strings: list[str] = []
    pages = []
    for rows in sheets.values():
        body = "".join(
            f'<row r="{n}">' + "".join(_cell(n, i, v, strings) for i, v in enumerate(values)) + "</row>"
            for n, values in sorted(rows.items())
        )
        pages.append(f"<worksheet {_NS}><sheetData>{body}</sheetData></worksheet>")
    with zipfile.ZipFile(path, "w") as book:
        book.writestr(
            "xl/workbook.xml",
            f"<workbook {_NS} {_REL}><sheets>"
            + "".join(
                f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(sheets, 1)
            )
            + "</sheets></workbook>",
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            + "".join(
                f'<Relationship Id="rId{i}" Type="worksheet" Target="worksheets/sheet{i}.xml"/>'
                for i in range(1, len(pages) + 1)
            )
            + "</Relationships>",
        )
        book.writestr(
            "xl/styles.xml",
            f'<styleSheet {_NS}><numFmts count="1"><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/></numFmts>'
            '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        )
        book.writestr(
            "xl/sharedStrings.xml",
            f"<sst {_NS}>" + "".join(f"<si><r><t>{escape(s)}</t></r></si>" for s in strings) + "</sst>",
        )
        for i, page in enumerate(pages, 1):
            book.writestr(f"xl/worksheets/sheet{i}.xml", page)
