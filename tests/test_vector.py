import math

import pytest

from docframe.sources import vector as V


@pytest.mark.parametrize(
    ("d", "want"),
    [
        ("M1 2L3,4Z", [("M", [1, 2]), ("L", [3, 4]), ("Z", [])]), ("m1 2 3 4", [("M", [1, 2]), ("L", [4, 6])]), ("M0 0H5V6h-1v-1", [("M", [0, 0]), ("L", [5, 0]), ("L", [5, 6]), ("L", [4, 6]), ("L", [4, 5])]),
        ("M0,0c1-1.5.5 2 3 3", [("M", [0, 0]), ("C", [1, -1.5, 0.5, 2, 3, 3])]), ("M0 0C1 1 2 2 3 3S5 5 6 6", [("M", [0, 0]), ("C", [1, 1, 2, 2, 3, 3]), ("C", [4, 4, 5, 5, 6, 6])]), ("M0 0Q3 3 6 0", [("M", [0, 0]), ("C", [2, 2, 4, 2, 6, 0])]),
        ("L1 1", []), ("M1 1 L", [("M", [1, 1])]), ("M1 1X2", [("M", [1, 1])]), ("", []), ("M1 1A0 5 0 0 1 3 3", [("M", [1, 1]), ("L", [3, 3])]),
    ],
)
def test_paths(d, want):
    got = V.path_segments(d)
    assert [o for o, _ in got] == [o for o, _ in want] and all(a == pytest.approx(b) for (_, a), (_, b) in zip(got, want, strict=True))


def test_arcs_are_round():
    seg = V.path_segments("M1 0A1 1 0 0 1-1 0A1 1 0 1110-1e-9")
    assert V.bounds(V.path_segments("M1 0A1 1 0 0 1 -1 0")) == pytest.approx((-1, 0, 1, 1), abs=1e-3) and len(seg) >= 3
    assert V.bounds(V.path_segments("M0 0L2 1"), (2, 0, 0, 3, 1, 1)) == (1, 1, 5, 4) and V.bounds([]) is None


def test_transforms():
    assert V.transform("translate(1,2) scale(2)") == (2, 0, 0, 2, 1, 2) and V.transform("rotate(90 1 1)") == pytest.approx((0, 1, -1, 0, 2, 0)) and V.transform("skewX(45) x") == pytest.approx((1, 0, 1, 1, 0, 0))
    assert V.transform("bad(1)") == (1, 0, 0, 1, 0, 0) and V.viewport((0, 0, 10, 20), 100, 100) == (5, 0, 0, 5, 25, 0) and V.viewport((0, 0, 10, 20), 100, 100, "none") == (10, 0, 0, 5, 0, 0)
    assert V.viewport((0, 0, 10, 20), 100, 100, "xMinYMax", True) == (10, 0, 0, 10, 0, -100)


def test_functions():
    two = {"FunctionType": 2, "Domain": [0, 1], "C0": [0, 1], "C1": [1, 0], "N": 2}
    assert V.evaluate(two, [0.5]) == [0.25, 0.75] and V.evaluate(two, [9]) == [1, 0]
    three = {"FunctionType": 3, "Domain": [0, 1], "Bounds": [0.5], "Encode": [0, 1, 1, 0], "Functions": [two, two]}
    assert V.evaluate(three, [0.25]) == [0.25, 0.75] and V.evaluate(three, [1.0]) == [0, 1]
    sampled = {"FunctionType": 0, "Domain": [0, 1], "Range": [0, 1], "Size": [3], "BitsPerSample": 8}
    assert V.evaluate(sampled, [0.25], bytes([0, 255, 0])) == pytest.approx([0.5])
    grid = {"FunctionType": 0, "Domain": [0, 1, 0, 1], "Range": [0, 1], "Size": [2, 2], "BitsPerSample": 4}
    assert V.evaluate(grid, [0.5, 0.5], bytes([0x0F, 0x0F])) == pytest.approx([0.5])


@pytest.mark.parametrize(
    ("text", "x", "want"),
    [("{ 2 mul exch }", [1, 3], [6, 1]), ("{ dup 0 lt { neg } { 1 add } ifelse }", [-4], [4]), ("{ 1 2 3 3 1 roll }", [], [3, 1, 2]), ("{ 5 1 index }", [7], [7, 5, 7]), ("{ 360 sin 1 atan }", [], [0]), ("{ pop pop }", [1], []), ("{ 7 2 idiv 7 2 mod }", [], [3, 1]), ("{ 2 copy }", [1, 2], [1, 2, 1, 2])],
)
def test_calculator(text, x, want):
    assert V.calculator(V.program(text), x) == pytest.approx(want, abs=1e-9)


def test_an_arc_of_a_quarter_keeps_its_radius():
    (op, p), = V.arc(1, 0, 1, 1, 0, False, True, 0, 1)
    mid = [(a + 3 * b + 3 * c + d) / 8 for a, b, c, d in zip((1, 0), p[:2], p[2:4], p[4:], strict=True)]
    assert op == "C" and math.hypot(*mid) == pytest.approx(1, abs=1e-3)
