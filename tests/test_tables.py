from docframe.operators import tables
from docframe.operators.dom import parse


def test_cells_pass_over_places_that_are_spanned():
    t = parse("<table><thead><tr><th rowspan=2>a<th colspan=2>b<tbody><tr><td>c<td rowspan=9>d<tr><td colspan=2>e<tr><td>f<td>g<table><tr><td>in</table></table>")
    found = [(c.children[0].text, *at) for c, *at in tables.grid(tables.rows_of(next(iter(t.find("table")))))]
    assert found == [("a", 0, 0, 2, 1), ("b", 0, 1, 1, 2), ("c", 1, 1, 1, 1), ("d", 1, 2, 3, 1), ("e", 2, 0, 1, 2), ("f", 3, 0, 1, 1), ("g", 3, 1, 1, 1)]
    assert tables.grid([]) == [] and tables._span(parse("<td colspan=x>").children[0], "colspan") == 1


def test_widths():
    assert tables.column_widths([(10, 20, 0, 1), (10, 60, 1, 1)], 50) == [15, 35] and tables.column_widths([(10, 20, 0, 1), (10, 60, 1, 1)], 500) == [20, 60]
    assert tables.column_widths([(10, 20, 0, 1), (10, 60, 1, 1)], 5) == [10, 10] and tables.column_widths([(10, 10, 0, 1), (40, 40, 0, 2)], 100) == [25, 15]
