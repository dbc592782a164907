"""Text of DOCX, XLSX and PPTX packages with bounded reads, and small writers of the same formats for round trips."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

PART_MOST, ROWS_MOST = 8 << 20, 5000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class Unsupported(Exception):
    """The bytes are no such document, or too large to read safely."""


def _package(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Unsupported("no zip package") from e


def _part(z: zipfile.ZipFile, name: str) -> bytes | None:
    """A part of the package; its declared and its real size are bounded, so that no bomb unfolds."""
    try:
        info = z.getinfo(name)
    except KeyError:
        return None
    if info.file_size > PART_MOST:
        raise Unsupported(f"{name} is too large")
    with z.open(info) as f:
        data = f.read(PART_MOST + 1)
    if len(data) > PART_MOST:
        raise Unsupported(f"{name} is too large")
    return data


def _xml(data: bytes | None, name: str) -> ET.Element:
    if data is None:
        raise Unsupported(f"{name} is missing")
    if b"<!DOCTYPE" in data[:2000] or b"<!ENTITY" in data[:2000]:
        raise Unsupported("entities are not read")
    try:
        return ET.fromstring(data)
    except ET.ParseError as e:
        raise Unsupported(str(e)) from e


def _targets(z: zipfile.ZipFile, rels: str, base: str) -> dict[str, str]:
    data = _part(z, rels)
    if data is None:
        return {}
    out = {}
    for r in _xml(data, rels):
        t = r.get("Target", "")
        out[r.get("Id", "")] = t.lstrip("/") if t.startswith("/") else base + t
    return out


def _words(p: ET.Element) -> str:
    say = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(e.text or "" if e.tag == f"{_W}t" else say.get(e.tag, "") for e in p.iter())


def docx_blocks(data: bytes) -> Iterator[tuple[int, str | list[list[str]]]]:
    """Paragraphs (heading level or 0, text) and tables (0, rows of cells) in document order. A heading has an outline level, or a style whose
    id or name says so."""
    z = _package(data)
    body = _xml(_part(z, "word/document.xml"), "word/document.xml").find(f"{_W}body")
    names: dict[str, str] = {}
    if (raw := _part(z, "word/styles.xml")) is not None:
        for s in _xml(raw, "word/styles.xml").iter(f"{_W}style"):
            name = s.find(f"{_W}name")
            names[s.get(f"{_W}styleId", "")] = name.get(f"{_W}val", "") if name is not None else ""
    for e in body if body is not None else []:
        if e.tag == f"{_W}p":
            style, outline = e.find(f"{_W}pPr/{_W}pStyle"), e.find(f"{_W}pPr/{_W}outlineLvl")
            level = 0
            if outline is not None and outline.get(f"{_W}val", "").isdigit():
                level = int(outline.get(f"{_W}val")) + 1
            elif style is not None:
                used = style.get(f"{_W}val", "")
                for said in (used, names.get(used, "")):
                    if m := re.match(r"(?i)(?:heading|标题|見出し|title)\s*(\d*)", said):
                        level = int(m[1] or 1)
                        break
            yield level, _words(e)
        elif e.tag == f"{_W}tbl":
            yield 0, [[" ".join(_words(p) for p in c.iter(f"{_W}p")).strip() for c in row.iter(f"{_W}tc")] for row in e.iter(f"{_W}tr")]


def docx(data: bytes) -> tuple[str, list[tuple[str, int, str, str]]]:
    """(text, sections): paragraphs and table rows in document order; a section starts at each heading paragraph."""
    lines: list[tuple[str, bool]] = []
    for level, what in docx_blocks(data):
        lines += [(what, level > 0)] if isinstance(what, str) else [(" | ".join(c for c in row if c), False) for row in what]
    units: list[tuple[str, int, str, str]] = []
    at: list[str] | None = None
    for text, head in lines:
        if head and text.strip():
            at = []
            units.append(("section", len(units) + 1, text.strip(), ""))
        if at is not None:
            at.append(text)
            units[-1] = (*units[-1][:3], "\n".join(at))
    return "\n".join(t for t, _ in lines if t.strip()), units


#: Number formats of the standard that are dates or times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def is_date_format(number: int, code: str | None = None) -> bool:
    """Whether a number format shows a date or time: one of the built-in ones, or a code with such a part outside of quotes, brackets and
    escapes."""
    if code is None:
        return number in _DATE_FORMATS
    bare = re.sub(r'"[^"]*"|\\.|_.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.lower())
    return bare != "general" and any(c in bare for c in "ymdhs")


def serial_date(value: str) -> str:
    """A day number as ISO date, with the time of day if there is one; what is no day number stays as it is."""
    try:
        number = float(value)
    except ValueError:
        return value
    if not 0 <= number <= 2958465:
        return value
    day, seconds = int(number), round(number % 1 * 86400)
    if day == 60:
        return "1900-02-29"  # the day that never was
    at = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=day + (day < 60), seconds=seconds)
    return at.date().isoformat() if number == day else at.isoformat(" ")


class Workbook:
    """Sheets of an XLSX file, their rows read one by one: ``rows(i)`` gives (row number, cells by column) with dates as ISO text."""

    def __init__(self, data: bytes):
        z = self.z = _package(data)
        book = _xml(_part(z, "xl/workbook.xml"), "xl/workbook.xml")
        to = _targets(z, "xl/_rels/workbook.xml.rels", "xl/")
        self.sheets = [(s.get("name", ""), to.get(s.get(f"{_R}id", ""), f"xl/worksheets/sheet{i + 1}.xml")) for i, s in enumerate(book.iter(f"{_S}sheet"))]
        self.shared: list[str] = []
        if (raw := _part(z, "xl/sharedStrings.xml")) is not None:
            self.shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in _xml(raw, "sharedStrings")]
        self.dates: list[bool] = []
        if (raw := _part(z, "xl/styles.xml")) is not None:
            styles = _xml(raw, "xl/styles.xml")
            codes = {n.get("numFmtId"): n.get("formatCode", "") for n in styles.iter(f"{_S}numFmt")}
            forms = styles.find(f"{_S}cellXfs")
            ids = [x.get("numFmtId", "0") for x in forms] if forms is not None else []
            self.dates = [is_date_format(int(i) if i.isdigit() else 0, codes.get(i)) for i in ids]

    def _cell(self, c) -> str:
        v, kind, style = c.find(f"{_S}v"), c.get("t", ""), c.get("s", "")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_S}t"))
        if v is None or v.text is None:
            return ""
        if kind == "s":
            return self.shared[int(v.text)] if v.text.isdigit() and int(v.text) < len(self.shared) else ""
        if kind == "b":
            return "TRUE" if v.text == "1" else "FALSE"
        if kind in ("", "n") and style.isdigit() and int(style) < len(self.dates) and self.dates[int(style)]:
            return serial_date(v.text)
        return v.text

    def rows(self, i: int) -> Iterator[tuple[int, list[str]]]:
        name = self.sheets[i][1]
        raw = _part(self.z, name)
        if raw is None:
            return
        last = 0
        for _, e in ET.iterparse(io.BytesIO(raw), events=("end",)):
            if e.tag != f"{_S}row":
                continue
            last = int(e.get("r")) if (e.get("r") or "").isdigit() else last + 1
            cells: list[str] = []
            for c in e.iter(f"{_S}c"):
                letters = re.match("[A-Za-z]*", c.get("r", ""))[0].upper()
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                cells += [""] * (max(at - 1, len(cells)) - len(cells)) if letters else []
                cells.append(self._cell(c).strip())
            e.clear()
            yield last, cells


def xlsx(data: bytes, most: int = ROWS_MOST) -> tuple[str, list[tuple[str, int, str, str]], bool]:
    """(text, sheets, whether rows are left out): cells joined by `` | ``, sheets in workbook order, ``most`` rows of each at most."""
    book, units, cut = Workbook(data), [], False
    for i, (name, _) in enumerate(book.sheets):
        rows: list[str] = []
        for _, cells in book.rows(i):
            if not any(cells):
                continue
            if len(rows) >= most:
                cut = True
                break
            rows.append(" | ".join(x for x in cells if x))
        units.append(("sheet", i, name, "\n".join(rows)))
    return "\n".join(u[3] for u in units if u[3]), units, cut


def sheet_page(data: bytes, sheet: int = 0, offset: int = 0, limit: int = 200) -> dict:
    """One page of a sheet: names of the sheets, the first row as columns, rows after it with their number and cells, and whether there
    are more. ``total_rows`` is known where the page reaches the end; a sheet number out of range is moved into it."""
    book = Workbook(data)
    if not book.sheets:
        raise Unsupported("no sheet")
    i, offset, limit = max(0, min(sheet, len(book.sheets) - 1)), max(0, offset), max(1, limit)
    columns: list[str] = []
    rows, seen, more = [], -1, False
    for _, cells in book.rows(i):
        seen += 1
        if seen == 0:
            columns = cells
        elif seen > offset + limit:
            more = True
            break
        elif seen > offset:
            rows.append({"r": seen - 1, "c": cells})
    return {
        "sheets": [{"name": n, "index": j} for j, (n, _) in enumerate(book.sheets)], "sheet": book.sheets[i][0], "columns": columns, "rows": rows,
        "total_rows": None if more else max(0, seen), "has_more": more, "offset": offset, "limit": limit,
    }


def pptx(data: bytes) -> tuple[str, list[tuple[str, int, str, str]]]:
    """(text, slides) in the order of the presentation's list, whatever the parts are called."""
    z = _package(data)
    deck = _xml(_part(z, "ppt/presentation.xml"), "ppt/presentation.xml")
    to = _targets(z, "ppt/_rels/presentation.xml.rels", "ppt/")
    units = []
    for i, s in enumerate(deck.iter(f"{_P}sldId"), 1):
        part = to.get(s.get(f"{_R}id", ""), "")
        root = _xml(_part(z, part), part)
        say = lambda e: [x for p in e.iter(f"{_A}p") if (x := "".join(t.text or "" for t in p.iter(f"{_A}t"))).strip()]
        lines = say(root)
        # the title is that of the title shape, else the first line
        shapes = [s for s in root.iter(f"{_P}sp") if any(ph.get("type") in ("title", "ctrTitle") for ph in s.iter(f"{_P}ph"))]
        title = next((" ".join(x) for x in map(say, shapes) if x), lines[0] if lines else "")
        units.append(("slide", i, title, "\n".join(lines)))
    return "\n".join(u[3] for u in units if u[3]), units


def _escape(s: str) -> str:
    s = "".join(c for c in s if c >= " " and c not in "￾￿")
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def make_docx(lines: list[str], headings: set[int] = frozenset()) -> bytes:
    style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
    body = "".join(f'<w:p>{style if i in headings else ""}<w:r><w:t xml:space="preserve">{_escape(x)}</w:t></w:r></w:p>' for i, x in enumerate(lines))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def make_xlsx(sheets: list[tuple[str, list[list]]]) -> bytes:
    """Cells are strings, or (number, style): style 1 a date, 2 a date with time, 3 a number of days."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="{_escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_S[1:-1]}" xmlns:r="{_R[1:-1]}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{_S[1:-1]}"><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy hh:mm"/><numFmt numFmtId="171" formatCode="0.0&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, (_, rows) in enumerate(sheets, 1):
            cell = lambda c: f'<c t="inlineStr"><is><t xml:space="preserve">{_escape(c)}</t></is></c>' if isinstance(c, str) else f'<c s="{c[1]}"><v>{c[0]}</v></c>'
            cells = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_S[1:-1]}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def make_pptx(slides: list[list[str]]) -> bytes:
    """Slides whose part numbers run against their order."""
    out, n = io.BytesIO(), len(slides)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        ids = "".join(f'<p:sldId id="{256 + i}" r:id="r{i}"/>' for i in range(n))
        z.writestr("ppt/presentation.xml", f'<p:presentation xmlns:p="{_P[1:-1]}" xmlns:r="{_R[1:-1]}"><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="slides/slide{n - i}.xml"/>' for i in range(n)) + "</Relationships>")
        for i, lines in enumerate(slides):
            body = "".join(f"<a:p><a:r><a:t>{_escape(x)}</a:t></a:r></a:p>" for x in lines)
            z.writestr(f"ppt/slides/slide{n - i}.xml", f'<p:sld xmlns:p="{_P[1:-1]}" xmlns:a="{_A[1:-1]}">{body}</p:sld>')
    return out.getvalue()
