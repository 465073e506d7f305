import random
import unicodedata

import pytest

from docframe.operators import bidi
from docframe.plans import catalogue

from tests.oracle import SF


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("abc", [0, 0, 0]), ("אבג", [1, 1, 1]), ("a אב b", [0, 0, 1, 1, 0, 0]), ("אב 12 ג", [1, 1, 1, 2, 2, 1, 1]), ("a 1,2", [0] * 5), ("א 1,2", [1, 1, 2, 2, 2]),
        ("ا 12", [1, 1, 2, 2]), ("a ‮b c‬ d", [0, 0, 0, 1, 1, 1, 1, 0, 0]), ("a ⁧b⁩ c", [0, 0, 0, 2, 0, 0, 0]), ("אב ", [1, 1, 1]), ("a אב ", [0, 0, 1, 1, 0]), ("", []), ("a(אב)", [0, 0, 1, 1, 0]),
    ],
)
def test_levels(text, want):
    got = bidi.levels(text)
    assert [g for g, c in zip(got, text, strict=True) if c not in "‮‬"] == [w for w, c in zip(want, text, strict=True) if c not in "‮‬"]


def test_visual_order():
    assert bidi.visual("a אבג b") == "a גבא b" and bidi.visual("אב 12") == "12 בא"


@pytest.mark.parametrize(
    ("text", "want"),
    [("ab cd", [3, 5]), ("a-b", [2, 3]), ("a\nb", [2, 3]), ("a\r\nb", [3, 4]), ("a b", [3]), ("漢字", [1, 2]), ("漢。字", [2, 3]), ("(a) b", [4, 5]), ("a ( b", [2, 5]), ("-1", [2]), ("$1,000", [6]), ("a​b", [2, 3]), ("é x", [3, 4]), ("", []), ("a !b", [3, 4])],
)
def test_breaks(text, want):
    assert [i for i, _ in bidi.line_breaks(text)] == want


def test_patterns_give_the_levels_of_the_rules():
    rng = random.Random(7)
    for _ in range(3000):
        t = "".join(rng.choice("aZ אבلم٣12 ,.+-$%:/\t\nǹ!(") for _ in range(rng.randint(0, 12)))
        base = rng.choice((None, 0, 1))
        assert bidi.levels(t, base) == bidi._general(t, base)


def test_a_class_is_asked_for_once_a_character(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(bidi, "unicodedata", type("U", (), {"bidirectional": staticmethod(lambda c: asked.append(c) or unicodedata.bidirectional(c))}))
    bidi._CLASSES.clear()
    assert bidi.visual("car " * 500 + "שלום") == "car " * 500 + "םולש"
    assert len(asked) == len(set(asked))
    for name in ("visual_order", "bidi_runs"):
        assert "to_json" not in catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
