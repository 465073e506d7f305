import pytest

from docframe.operators import css
from docframe.operators.dom import parse

DOC = parse('<div id=a class="x y"><p id=b>1<p id=c lang=en-US title="Foo bar"><em id=d>2</em></p><span id=e></span><p id=f>3</div><ul id=u><li id=g>a<li id=h>b<li id=i>c</ul>')


@pytest.mark.parametrize(
    ("selector", "ids"),
    [
        ("p", "b c f"), ("*", None), ("div p", "b c f"), ("div > em", ""), ("div em", "d"), ("p + p", "c"), ("p ~ p", "c f"), ("p ~ span", "e"), (".x.y", "a"), (".X", ""), ("#c em", "d"), ("[lang]", "c"),
        ("[lang|=en]", "c"), ("[title~=bar]", "c"), ("[title^='Foo']", "c"), ("[title$=bar]", "c"), ("[title*='o b']", "c"), ("[title^='']", ""), ("[title='foo BAR' i]", "c"), ("li:first-child", "g"), ("li:last-child", "i"),
        ("li:nth-child(2)", "h"), ("li:nth-child(odd)", "g i"), ("li:nth-child(-n+2)", "g h"), ("li:nth-last-child(1)", "i"), ("em:only-child", "d"), ("p:nth-of-type(2)", "c"), ("span:empty", "e"), ("p:not(#c)", "b f"), ("li:not(:first-child):not(.z)", "h i"),
        ("p:last-of-type", "f"), ("p:hover", ""), ("p::before", ""), ("span, em", "d e"), ("P", "b c f"), ("ul|li", "g h i"),
    ],
)
def test_selectors(selector, ids):
    got = " ".join(n.attrs["id"] for n in css.select(DOC, selector) if "id" in n.attrs)
    assert got == ids if ids is not None else len(got.split()) == 10


@pytest.mark.parametrize(("selector", "spec"), [("*", (0, 0, 0)), ("li", (0, 0, 1)), ("ul li", (0, 0, 2)), ("h1 + *[rel=up]", (0, 1, 1)), ("li.red.level", (0, 2, 1)), ("#x34y", (1, 0, 0)), ("#s12:not(foo)", (1, 0, 1)), ("p::before", (0, 0, 2)), ("a:hover", (0, 1, 1))])
def test_specificity(selector, spec):
    assert css.parse_selector(selector).spec == spec


@pytest.mark.parametrize("bad", ["", ">p", "p >", "p,,q", "..x", "[", "[a=]", "p:nth-child(x)", "p::before em#", ":not()", "p#", "1p"])
def test_invalid_lists_fail_whole(bad):
    assert css.parse_selectors(f"ok, {bad}" if bad else "ok,") == []


def test_sheets_and_media():
    rules = css.parse_sheet("/* c */ a{color:red;;x;top : 1px !important} @import 'x'; @media screen and (min-width: 100px) { b, i{left:0} } @font-face{f:g} bad..{x:y} c{k:';}'}")
    assert [(r.text, r.declarations, r.media) for r in rules] == [("a", [("color", "red", False), ("top", "1px", True)], ""), ("b, i", [("left", "0", False)], "screen and (min-width: 100px)"), ("c", [("k", "';}'", False)], "")]
    assert css.media_matches("print, screen") and not css.media_matches("print") and not css.media_matches("(max-width: 10px)") and css.media_matches("not print") and css.media_matches("(orientation: portrait)")


def test_cascade():
    root = parse('<style></style><p id=x class=k style="left: 9px">a')
    sheets = [(css.UA, "p{color:black; top: 1px !important}"), (css.AUTHOR, "p{color:red} .k{color:green} p{color:blue; margin: 1px 2px; top: 3px !important; left: 1px}")]
    best = {}
    for _, prop, value, rank, spec, order in css.declared(root, sheets):
        best[prop] = max(best.get(prop, ((-1,), "")), ((rank, spec, order), value))
    assert {k: v for k, (_, v) in best.items()} == {"color": "green", "top": "1px", "margin-top": "1px", "margin-right": "2px", "margin-bottom": "1px", "margin-left": "2px", "left": "9px"}


@pytest.mark.parametrize(("s", "px"), [("12pt", 16.0), ("1in", 96.0), ("2em", 32.0), ("0", 0.0), ("5", None), ("1ex", 8.0), ("x", None)])
def test_lengths(s, px):
    assert css.to_px(s) == px


def test_computed_styles():
    sheet = "body { font-size: 20px; color: teal } p { margin: 1em 10%; color: inherit } p.x { font-size: 50%; text-indent: 2em } b { font-weight: bolder; color: #abc } div { border: 1px solid currentcolor; color: initial }"
    root = parse("<body><p class=x>a<b>b</b></p><div style='padding: 1pc'><h2>c</h2></div></body>")
    got = {}
    for _, tag, name, value in css.computed(root, [(css.AUTHOR, sheet)]):
        got.setdefault(tag, {})[name] = value
    assert got["p"]["font-size"] == "10px" and got["p"]["margin-top"] == "10px" and got["p"]["margin-left"] == "10%" and got["p"]["color"] == "rgb(0, 128, 128)" and got["p"]["text-indent"] == "20px"
    assert got["b"]["font-weight"] == "700" and got["b"]["font-size"] == "10px" and got["b"]["color"] == "rgb(170, 187, 204)" and got["b"]["text-indent"] == "20px" and "margin-top" not in got["b"]
    assert got["div"]["border-top-color"] == "rgb(0, 0, 0)" and got["div"]["padding-left"] == "16px" and got["h2"]["font-size"] == "30px" and got["h2"]["margin-top"] == "24.9px"


def test_sheets_and_coverage():
    texts = {"a.css": ("@import 'b.css'; p { color: red }", "a.css"), "b.css": ("@import 'a.css'; @import 'c.css' print; p { color: blue }", "b.css")}
    root = parse("<link rel=stylesheet href=a.css><link rel='alternate stylesheet' href=b.css><style media=print>x{}</style><style>q { color: green }</style>")
    found = [t.strip() for _, t in css.sheets_of(root, lambda href, base: texts.get(href))]
    assert found == ["p { color: red }", "p { color: blue }", "p { color: red }", "q { color: green }"]
    assert css.coverage("p { margin: 0; foo: bar; color: red }") == (2, 1)
