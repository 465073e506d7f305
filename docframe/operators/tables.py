"""Tables of markup as grids: which row and column each cell takes, and how wide columns want to be."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docframe.operators.dom import Node, _each, node_text, parse

#: Most columns, span of a cell, and places of a table. Fixed values.
MOST_COLUMNS, MOST_SPAN, MOST_PLACES = 1 << 12, 1000, 1 << 20


def _span(cell: Node, name: str) -> int:
    value = (cell.attrs.get(name) or "").strip()
    return min(max(int(value), 1), MOST_SPAN) if value.isdigit() else 1


def rows_of(table: Node) -> list[list[Node]]:
    """The cells of a table's rows, in order: its own and those of its row groups, not of tables inside."""
    out = []
    for child in table.children:
        if child.tag == "tr":
            out.append([c for c in child.children if c.tag in ("td", "th")])
        elif child.tag in ("thead", "tbody", "tfoot"):
            out += rows_of(child)
    return out


def grid(rows: list[list[Node]]) -> list[tuple[Node, int, int, int, int]]:
    """(cell, row, column, rows, columns) of each cell; a place that a cell above spans is passed over."""
    free_from: dict[int, int] = {}  # first row in which a column is free again
    out, places = [], 0
    for r, cells in enumerate(rows):
        c = 0
        for cell in cells:
            while free_from.get(c, 0) > r:
                c += 1
            if c >= MOST_COLUMNS:
                break
            wide, tall = min(_span(cell, "colspan"), MOST_COLUMNS - c), min(_span(cell, "rowspan"), len(rows) - r)
            places += wide * tall
            if places > MOST_PLACES:
                return out
            for k in range(c, c + wide):
                free_from[k] = max(free_from.get(k, 0), r + tall)
            out.append((cell, r, c, tall, wide))
            c += wide
    return out


def column_widths(cells: list[tuple[float, float, int, int]], available: float) -> list[float]:
    """Widths of columns for cells of (least, most, column, columns).

    Each column gets the least that its cells need, a cell over several columns shares what these lack evenly; then what
    is left goes to the columns by what they could still use, up to their most, and no further than there is.
    """
    n = max((c + k for _, _, c, k in cells), default=0)
    least, most = [0.0] * n, [0.0] * n
    for low, high, c, k in sorted(cells, key=lambda x: x[3]):
        for bound, want in ((least, low), (most, max(low, high))):
            lack = want - sum(bound[c : c + k])
            if lack > 0:
                for i in range(c, c + k):
                    bound[i] += lack / k
    most = [max(a, b) for a, b in zip(least, most, strict=True)]
    room, spare = available - sum(least), sum(most) - sum(least)
    if room <= 0 or spare <= 0:
        return least
    share = min(1.0, room / spare)
    return [a + (b - a) * share for a, b in zip(least, most, strict=True)]


def cells_of(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, table, row, col, rows, cols, text) of the cells of all tables of a document."""

    def found(markup: str):
        return [
            (k, r, c, tall, wide, " ".join(node_text(cell).split()))
            for k, table in enumerate(parse(markup).find("table"))
            for cell, r, c, tall, wide in grid(rows_of(table))
        ]

    return _each(df, id_col, html_col, "table int, row int, col int, rows int, cols int, text string", found)
