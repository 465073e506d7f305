"""Worksheets as cells: types, shared strings, number formats, merged cells."""

from __future__ import annotations

import datetime as dt
import html
import re
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

from docframe.sources.xml import X

MOST_SHEETS, MOST_COLS, MOST_ROWS, MOST_MERGED, MOST_FORMAT = 1024, 4096, 1 << 20, 1 << 20, 255
#: Formats with built-in numbers. Fixed values.
BUILTIN = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0", 38: "#,##0", 39: "#,##0.00", 40: "#,##0.00", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 49: "@",
}


@dataclass
class Cell:
    sheet: str
    row: int
    col: int
    type: str
    raw: str
    format: str
    text: str
    colspan: int = 1
    rowspan: int = 1


def shortest(n: float) -> str:
    """Integers plainly; else the fewest digits that read back, with an exponent from a million on and below 1e-4."""
    if n == int(n) and abs(n) < 1e15:
        return str(int(n))
    digits = repr(n)
    sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
    d = Decimal(digits).normalize()
    exp, mantissa = d.adjusted(), "".join(map(str, d.as_tuple().digits))
    if -4 <= exp < 6:
        return sign + format(d, "f")
    return f"{sign}{mantissa[0]}{'.' + mantissa[1:] if mantissa[1:] else ''}e{'-' if exp < 0 else '+'}{abs(exp):02d}"


_TOKEN = re.compile(r'"([^"]*)"?|\[[^\]]*\]?|\\(.?)|(AM/PM)|(y+|d+|h+|s+|m+)|([0#?%Ee])|(.)', re.I | re.S)


def _date_pieces(code: str):
    """strftime-like pieces of a date code, or None for a number code."""
    out, is_date = [], False
    for m in _TOKEN.finditer(code):
        quoted, escaped, half, run, digit, other = m.groups()
        if digit:
            return None
        if run:
            kind, n, is_date = run[0].lower(), len(run), True
            if kind == "m" and _is_minute(code, m.start(), m.end()):
                kind = "minute"
            out.append((kind, n))
        elif half:
            out.append(("half", 0))
        elif quoted is not None or escaped is not None or other is not None:
            out.append(("text", quoted if quoted is not None else escaped if escaped is not None else other))
    return out if is_date else None


def _is_minute(code: str, start: int, end: int) -> bool:
    before = re.search(r"([a-z])[: .]*$", code[:start], re.I)
    if before and not re.search(r"[^: .]", code[before.end(1) : start]) and before[1].lower() == "h":
        return True
    if before and before[1].lower() in "yd":
        return False
    after = re.match(r"[m: .]*([a-z])", code[end:], re.I)
    return bool(after and after[1].lower() == "s")


def _as_date(t: dt.datetime, pieces) -> str:
    out = []
    for kind, n in pieces:
        if kind == "text":
            out.append(n)
        elif kind == "half":
            out.append("PM" if t.hour >= 12 else "AM")
        elif kind == "y":
            out.append(f"{t.year:04d}" if n >= 3 else f"{t.year % 100:02d}")
        elif kind == "d":
            out.append(t.strftime("%A") if n >= 4 else t.strftime("%a") if n == 3 else f"{t.day:02d}" if n == 2 else str(t.day))
        elif kind == "h":
            out.append(f"{t.hour:02d}" if n >= 2 else str(t.hour % 12 or 12))
        elif kind == "s":
            out.append(f"{t.second:02d}" if n >= 2 else str(t.second))
        elif kind == "minute":
            out.append(f"{t.minute:02d}" if n >= 2 else str(t.minute))
        else:
            out.append(t.strftime("%B") if n >= 4 else t.strftime("%b") if n == 3 else f"{t.month:02d}" if n == 2 else str(t.month))
    return "".join(out)


def _prefix(code: str) -> str:
    out = []
    for m in _TOKEN.finditer(code):
        if m[5] and m[5] in "0#?":
            break
        if m[0].startswith("["):
            continue
        out.append(m[1] if m[1] is not None else m[2] if m[2] is not None else m[0].replace(" ", ""))
    return "".join(out)


def number(n: float, code: str, epoch: dt.datetime = dt.datetime(1899, 12, 30)) -> str:
    """A value in its format code; only the section for positive numbers is read."""
    code = code.strip()[:MOST_FORMAT].split(";")[0]
    if code in ("", "General", "@"):
        return shortest(n)
    pieces = _date_pieces(code)
    if pieces is not None:
        try:
            return _as_date(epoch + dt.timedelta(microseconds=round(n * 86400e6)), pieces)
        except OverflowError:
            return shortest(n)
    percent = "%" in code
    n = n * 100 if percent else n
    m = re.search(r"\.([0#?]*)", code)
    digits = len(m[1]) if m else 0 if re.search("[0#?]", code) else -1
    s = shortest(n)
    if digits >= 0:
        s = format(Decimal(repr(n)).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP), "f")
    if "#,#" in code:
        sign, whole = ("-", s[1:]) if s[0] == "-" else ("", s)
        head, dot, tail = whole.partition(".")
        s = f"{sign}{int(head):,}{dot}{tail}"
    return _prefix(code) + s + "%" * percent


def position(ref: str) -> tuple[int, int] | None:
    """1-based (row, column) of an A1-style reference."""
    m = re.fullmatch(r"\$?([A-Za-z]{1,4})\$?([0-9]{1,8})", ref)
    if not m:
        return None
    col = 0
    for c in m[1].upper():
        col = col * 26 + ord(c) - 64
    return int(m[2]), col


def read(tree, rels) -> tuple[list[Cell], list[tuple[str, str]]]:
    """Cells and (name, path) of the sheets; tree(path) parses a part of the archive."""
    book = tree("xl/workbook.xml")
    epoch = dt.datetime(1904, 1, 1) if (p := book.find("workbookPr")) is not None and p.attrs.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
    shared = ["".join(t.text for t in si.find_all("t")) for si in (tree("xl/sharedStrings.xml") or X("s")).children if si.tag == "si"]
    styles = tree("xl/styles.xml") or X("s")
    formats = BUILTIN | {int(x.attrs["numFmtId"]): x.attrs.get("formatCode", "") for x in styles.find_all("numFmt") if x.attrs.get("numFmtId", "").isdigit()}
    xfs = [int(x.attrs.get("numFmtId", "0") or 0) for x in (styles.find("cellXfs") or X("x")).children if x.tag == "xf"]
    cells, sheets = [], []
    for s in list(book.find_all("sheet"))[:MOST_SHEETS]:
        path = rels.get(s.attrs.get("id", ""), ("", True))[0]
        data = tree(path)
        if data is None:
            continue
        name = s.attrs.get("name", "")
        sheets.append((name, path))
        spans, covered = {}, set()
        for m in data.find_all("mergeCell"):
            a, _, b = m.attrs.get("ref", "").partition(":")
            p, q = position(a), position(b)
            if p and q and p[0] <= q[0] <= MOST_ROWS and p[1] <= q[1] <= MOST_COLS and (q[0] - p[0] + 1) * (q[1] - p[1] + 1) + len(covered) <= MOST_MERGED:
                spans[p] = (q[1] - p[1] + 1, q[0] - p[0] + 1)
                covered |= {(r, c) for r in range(p[0], q[0] + 1) for c in range(p[1], q[1] + 1)} - {p}
        row = 0
        for r in data.find_all("row"):
            row = int(r.attrs["r"]) if r.attrs.get("r", "").isdigit() else row + 1
            col = 0
            for c in (x for x in r.children if x.tag == "c"):
                p = position(c.attrs.get("r", ""))
                col = p[1] if p else col + 1
                if row > MOST_ROWS or col > MOST_COLS or (row, col) in covered:
                    continue
                kind, v = c.attrs.get("t", "n"), c.child("v")
                raw = "".join(t.text for t in c.find_all("t")) if kind == "inlineStr" else v.text if v is not None else ""
                style = int(c.attrs["s"]) if c.attrs.get("s", "").isdigit() else 0
                code = formats.get(xfs[style], "") if style < len(xfs) else ""
                text = raw
                if kind == "s":
                    text = shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
                elif kind == "b":
                    text = "TRUE" if raw == "1" else "FALSE"
                elif kind == "n" and raw:
                    try:
                        text = number(float(raw), code, epoch)
                    except ValueError:
                        text = raw
                across, down = spans.get((row, col), (1, 1))
                cells.append(Cell(name, row, col, kind, raw, code, text, across, down))
    return cells, sheets


def to_html(name: str, cells: list[Cell]) -> str:
    """A table: gaps to the left of a cell are filled, missing rows are not."""
    out, rows = [f"<h1>{html.escape(name)}</h1><table>"], {}
    for c in cells:
        rows.setdefault(c.row, []).append(c)
    for r in sorted(rows):
        out.append("<tr>")
        at = 1
        for c in sorted(rows[r], key=lambda c: c.col):
            out.append("<td></td>" * (c.col - at))
            spans = (f' colspan="{c.colspan}"' if c.colspan > 1 else "") + (f' rowspan="{c.rowspan}"' if c.rowspan > 1 else "")
            align = ' align="right"' if c.type == "n" else ""
            out.append(f"<td{spans}{align}>{html.escape(c.text)}</td>")
            at = c.col + c.colspan
        out.append("</tr>")
    return "".join(out) + "</table>"
