"""Style sheets: rules, selectors with specificity, media, the cascade.

Parsing and matching are kernels over one document; the cascade itself is a
choice of the heaviest declaration of each element and property, which is a
max_by over a struct when the declarations are rows (see `winners`).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.operators.dom import Node, _each, node_text, parse

UA, USER, AUTHOR = 0, 1, 2
#: Rank of an origin, and of its important declarations. Fixed values.
RANK = {(UA, False): 0, (USER, False): 1, (AUTHOR, False): 2, (AUTHOR, True): 3, (USER, True): 4, (UA, True): 5}
INHERITED = frozenset(
    "color font-family font-size font-style font-weight line-height text-align text-indent text-transform white-space letter-spacing word-spacing list-style-type list-style-position direction visibility orphans widows".split()
)
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
_PIECE = re.compile(r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|url\([^)]*\))|(.)""", re.S | re.I)


@dataclass
class Rule:
    order: int
    selectors: list[Selector]
    text: str
    declarations: list[tuple[str, str, bool]]
    media: str = ""


@dataclass
class Compound:
    how: str = ""  # the combinator to the left
    tag: str = ""
    ids: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    attrs: list[tuple[str, str, str, bool]] = field(default_factory=list)
    pseudos: list[tuple[str, object]] = field(default_factory=list)


@dataclass
class Selector:
    parts: list[Compound]
    pseudo: str = ""
    spec: tuple[int, int, int] = (0, 0, 0)


def _split(s: str, at: str) -> list[str]:
    """At a character outside brackets and strings."""
    out, now, depth = [], [], 0
    for m in _PIECE.finditer(s):
        c = m[2]
        if c and c in "([{":
            depth += 1
        elif c and c in ")]}":
            depth = max(0, depth - 1)
        if c == at and not depth:
            out.append("".join(now))
            now = []
        else:
            now.append(m[0])
    return [*out, "".join(now)]


def _block(s: str, i: int) -> int:
    """The end of the block that opens before i."""
    depth, end = 1, len(s)
    for m in _PIECE.finditer(s, i):
        if m[2] == "{":
            depth += 1
        elif m[2] == "}":
            depth -= 1
            if not depth:
                return m.start()
    return end


def declarations(body: str) -> list[tuple[str, str, bool]]:
    out = []
    for d in _split(body, ";"):
        name, colon, value = d.partition(":")
        name, value = name.strip(), value.strip()
        if not colon or not value or not re.fullmatch(r"-{0,2}[A-Za-z_][\w-]*", name):
            continue
        plain = re.sub(r"\s*!\s*important\s*$", "", value, flags=re.I)
        out.append((name if name.startswith("--") else name.lower(), plain, plain != value))
    return out


#: Sheets up to so many characters are kept once parsed: every document has the defaults, and books share theirs.
_KEPT = 1 << 15


def parse_sheet(css: str, media: str = "", start: int = 0) -> list[Rule]:
    """Rules in order; what can't be read is skipped up to the end of its block."""
    return list(_kept_sheet(css, media, start)) if len(css) <= _KEPT else _parse_sheet(css, media, start)


@lru_cache(maxsize=64)
def _kept_sheet(css: str, media: str, start: int) -> tuple[Rule, ...]:
    return tuple(_parse_sheet(css, media, start))


def _parse_sheet(css: str, media: str, start: int) -> list[Rule]:
    css = _COMMENT.sub(" ", css.replace("\r\n", "\n").replace("<!--", " ").replace("-->", " "))
    out, i = [], 0
    while i < len(css):
        m = next((m for m in _PIECE.finditer(css, i) if m[2] in (";", "{")), None)
        if m is None:
            break
        prelude = css[i : m.start()].strip()
        if m[2] == ";":
            i = m.end() if prelude.startswith("@") else m.end()
            continue
        end = _block(css, m.end())
        body, i = css[m.end() : end], end + 1
        if prelude.startswith("@"):
            name, _, rest = prelude[1:].partition(" ")
            if name.lower() == "media" and media.count("{") < 8:
                both = rest.strip() if not media else f"{media} and ({rest.strip()})"
                out += parse_sheet(body, both, start + len(out))
            continue
        selectors = parse_selectors(prelude)
        if selectors:
            out.append(Rule(start + len(out), selectors, prelude, declarations(body), media))
    return out


# -- selectors --------------------------------------------------------------------------------

_NAME = r"(?:[A-Za-z_\u0080-\U0010ffff-]|\\.)(?:[\w\u0080-\U0010ffff-]|\\.)*"
_SIMPLE = re.compile(
    rf"""(?P<space>\s*[>+~]\s*|\s+)|(?P<ns>(?:{_NAME}|\*)?\|(?!=))?(?:(?P<tag>{_NAME}|\*)|\#(?P<id>(?:[\w\u0080-\U0010ffff-]|\\.)+)|\.(?P<class>{_NAME})
    |\[\s*(?:[\w*-]*\|(?!=))?(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|{_NAME})\s*(?P<fold>[iI])?\s*)?\]|(?P<pseudo>::?{_NAME})(?P<args>\((?:[^()]|\([^()]*\))*\))?)""",
    re.X,
)
_ALONE = {"root", "empty", "first-child", "last-child", "only-child", "first-of-type", "last-of-type", "only-of-type"}
_NTH = {"nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"}


def _name(s: str) -> str:
    return re.sub(r"\\([0-9A-Fa-f]{1,6}\s?|.)", lambda m: chr(int(m[1], 16)) if re.match("[0-9A-Fa-f]", m[1]) else m[1], s)


def parse_nth(s: str) -> tuple[int, int] | None:
    s = s.strip().lower()
    if s in ("odd", "even"):
        return 2, int(s == "odd")
    m = re.fullmatch(r"([+-]?\d*)n(?:\s*([+-])\s*(\d+))?|([+-]?\d+)", s)
    if not m:
        return None
    if m[4]:
        return 0, int(m[4])
    a = {"": 1, "+": 1, "-": -1}.get(m[1])
    return int(m[1]) if a is None else a, int((m[2] or "+") + (m[3] or "0"))


def parse_selectors(text: str) -> list[Selector]:
    """All selectors of a list; empty if any of them is invalid."""
    out = []
    for s in _split(text, ","):
        one = parse_selector(s.strip())
        if one is None:
            return []
        out.append(one)
    return out


def parse_selector(s: str) -> Selector | None:
    parts, i, a, b, c, pseudo = [Compound()], 0, 0, 0, 0, ""
    empty = True
    while i < len(s):
        m = _SIMPLE.match(s, i)
        if not m or m.end() == i:
            return None
        i = m.end()
        if m["space"] is not None:
            if empty:
                return None
            parts.append(Compound(how=m["space"].strip() or " "))
            empty = True
            continue
        if pseudo:
            return None
        now = parts[-1]
        if m["tag"]:
            if not empty:
                return None
            now.tag = "" if m["tag"] == "*" else _name(m["tag"]).lower()
            c += m["tag"] != "*"
        elif m["id"]:
            now.ids.append(_name(m["id"]))
            a += 1
        elif m["class"]:
            now.classes.append(_name(m["class"]))
            b += 1
        elif m["attr"]:
            v = m["val"] or ""
            now.attrs.append((m["attr"].lower(), m["op"] or "", _name(v[1:-1] if v[:1] in "\"'" and v else v), bool(m["fold"])))
            b += 1
        else:
            name, args = m["pseudo"].lower(), (m["args"] or "")[1:-1]
            if name.startswith("::") or name in (":before", ":after", ":first-line", ":first-letter"):
                pseudo, c = name.lstrip(":"), c + 1
            elif name == ":not":
                inner = parse_selectors(args)
                if not inner or any(len(x.parts) > 1 or x.pseudo for x in inner):
                    return None
                now.pseudos.append(("not", inner))
                sa, sb, sc = max(x.spec for x in inner)
                a, b, c = a + sa, b + sb, c + sc
            else:
                key, arg = name[1:], None
                if key in _NTH:
                    arg = parse_nth(args)
                    if arg is None:
                        return None
                now.pseudos.append((key, arg))
                b += 1
        empty = False
    return None if empty else Selector(parts, pseudo, (min(a, 1023), min(b, 1023), min(c, 1023)))


class Tree:
    """Parents and element siblings of a tree, for matching."""

    def __init__(self, root: Node):
        self.parent, self.place, self.kids = {}, {}, {}
        stack = [root]
        while stack:
            n = stack.pop()
            kids = [c for c in n.children if not c.tag.startswith("#")]
            self.kids[id(n)] = kids
            for k, c in enumerate(kids):
                self.parent[id(c)], self.place[id(c)] = n, k
            stack.extend(kids)

    def index(self, n: Node, last: bool, typed: bool) -> int:
        kids = [k for k in self.kids[id(self.parent[id(n)])] if not typed or k.tag == n.tag]
        at = next(i for i, k in enumerate(kids) if k is n)
        return len(kids) - at if last else at + 1

    def compound(self, p: Compound, n: Node) -> bool:
        if p.tag and p.tag != n.tag:
            return False
        if p.ids and any(n.attrs.get("id") != i for i in p.ids):
            return False
        words = n.attrs.get("class", "").split() if p.classes else ()
        return all(c in words for c in p.classes) and all(self.attr(n, *x) for x in p.attrs) and all(self.pseudo(n, *x) for x in p.pseudos)

    def attr(self, n: Node, name: str, op: str, want: str, fold: bool) -> bool:
        got = n.attrs.get(name)
        if got is None or not op:
            return got is not None
        if fold:
            got, want = got.lower(), want.lower()
        if op == "=":
            return got == want
        if op == "|=":
            return got == want or got.startswith(want + "-")
        return bool(want) and {"~=": want in got.split(), "^=": got.startswith(want), "$=": got.endswith(want), "*=": want in got}[op]

    def pseudo(self, n: Node, name: str, arg) -> bool:
        if name == "not":
            return not any(self.compound(s.parts[0], n) for s in arg)
        if name == "root":
            return self.parent[id(n)].tag == "#document"
        if name == "empty":
            return not any(c.tag != "#comment" and (c.tag != "#text" or c.text) for c in n.children)
        if name not in _ALONE | _NTH:
            return False
        typed, last = name.endswith("of-type"), "last" in name
        if name.startswith("only"):
            return self.index(n, False, typed) == 1 == self.index(n, True, typed)
        if name in _NTH:
            a, b = arg
            d = self.index(n, last, typed) - b
            return d == 0 if a == 0 else d % a == 0 and d // a >= 0
        return self.index(n, last, typed) == 1

    def matches(self, s: Selector, n: Node) -> bool:
        """Whether a selector selects an element; one with a pseudo-element selects none."""
        return not s.pseudo and self._from(s.parts, len(s.parts) - 1, n)

    def _from(self, parts, k: int, n: Node) -> bool:
        if not self.compound(parts[k], n):
            return False
        if not k:
            return True
        how = parts[k].how
        if how in (" ", ">"):
            up = self.parent.get(id(n))
            while up is not None and up.tag != "#document":
                if self._from(parts, k - 1, up):
                    return True
                if how == ">":
                    return False
                up = self.parent.get(id(up))
            return False
        kids, at = self.kids[id(self.parent[id(n)])], self.place[id(n)]
        return any(self._from(parts, k - 1, s) for s in (kids[at - 1 : at] if how == "+" else kids[:at]))


def select(root: Node, text: str) -> list[Node]:
    """Elements of a tree that a selector list selects, in order."""
    t, found = Tree(root), parse_selectors(text)
    return [n for n in root.walk() if not n.tag.startswith("#") and any(t.matches(s, n) for s in found)]


# -- media ------------------------------------------------------------------------------------


def media_matches(query: str, width: float = 800, height: float = 1200) -> bool:
    """Any query of a list; the types all, screen and none count as this medium."""
    if not query.strip():
        return True
    return any(_one(q.strip().lower(), width, height) for q in _split(query, ","))


def _one(q: str, width: float, height: float) -> bool:
    negate = q.startswith("not ")
    q = q.removeprefix("not ").removeprefix("only ")
    ok = True
    for part in (p.strip() for p in q.split(" and ")):
        m = re.fullmatch(r"\(\s*([a-z-]+)\s*(?::\s*([^)]+?)\s*)?\)", part)
        if not m:
            ok &= part in ("all", "screen")
            continue
        name, value = m.groups()
        if name == "orientation":
            ok &= value == ("portrait" if height >= width else "landscape")
            continue
        base = re.sub("^(min-|max-)?(device-)?", "", name)
        if base not in ("width", "height"):
            return False
        now, want = width if base == "width" else height, to_px(value or "")
        ok &= bool(now) if value is None else want is not None and (now >= want if name.startswith("min-") else now <= want if name.startswith("max-") else now == want)
    return ok != negate


#: Pixels of a unit. Fixed values.
UNITS = {"px": 1.0, "pt": 96 / 72, "pc": 16.0, "in": 96.0, "cm": 96 / 2.54, "mm": 9.6 / 2.54, "q": 2.4 / 2.54}


def to_px(s: str, em: float = 16.0, root: float = 16.0) -> float | None:
    m = re.fullmatch(r"([+-]?(?:\d+\.?\d*|\.\d+))(px|pt|pc|in|cm|mm|q|em|rem|ex|ch)?", s.strip().lower())
    if not m or (not m[2] and float(m[1])):
        return None
    n = float(m[1])
    if m[2] in UNITS or not m[2]:
        return n * UNITS[m[2] or "px"]
    return n * ({"em": em, "rem": root, "ex": em / 2, "ch": em / 2} | UNITS).get(m[2] or "px")


_SIDES = ("top", "right", "bottom", "left")


def longhands(name: str, value: str) -> list[tuple[str, str]]:
    """A shorthand's longhands; what is none stays as it is."""
    return list(_kept_longhands(name, value)) if len(value) <= 256 else _longhands(name, value)


@lru_cache(maxsize=2048)
def _kept_longhands(name: str, value: str) -> tuple[tuple[str, str], ...]:
    return tuple(_longhands(name, value))


def _longhands(name: str, value: str) -> list[tuple[str, str]]:
    words = [w for w in _split(re.sub(r"\s+", " ", value), " ") if w]
    if name in ("margin", "padding") and 1 <= len(words) <= 4:
        t, r = words[0], words[1] if len(words) > 1 else words[0]
        return [(f"{name}-{s}", v) for s, v in zip(_SIDES, (t, r, words[2] if len(words) > 2 else t, words[3] if len(words) > 3 else r), strict=True)]
    if name in ("border", *(f"border-{s}" for s in _SIDES)):
        out = {"width": "medium", "style": "none", "color": "currentcolor"}
        for w in words:
            kind = "style" if w.lower() in "none hidden dotted dashed solid double groove ridge inset outset".split() else "width" if w.lower() in ("thin", "medium", "thick") or to_px(w) is not None else "color"
            out[kind] = w
        sides = _SIDES if name == "border" else (name[7:],)
        return [(f"border-{s}-{k}", v) for s in sides for k, v in out.items()]
    if name == "list-style":
        out = []
        for w in words:
            out.append(("list-style-position" if w in ("inside", "outside") else "list-style-image" if w.lower().startswith("url(") else "list-style-type", w))
        return out
    return [(name, value)]


# -- the cascade ------------------------------------------------------------------------------


def _index(origin: int, css: str, start: int, width: float, height: float) -> tuple[dict[str, list], int]:
    """A sheet's rules by their subject's id, class or tag, so few are tried on an element; and the next number of a rule."""
    rules = [r for r in parse_sheet(css, start=start) if media_matches(r.media, width, height)]
    by_key: dict[str, list] = {}
    for r in rules:
        for s in r.selectors:
            p = s.parts[-1]
            by_key.setdefault("#" + p.ids[0] if p.ids else "." + p.classes[0] if p.classes else p.tag, []).append((origin, r, s))
    return by_key, max([start, *(r.order + 1 for r in rules)])


_kept_index = lru_cache(maxsize=64)(_index)


def declared(root: Node, sheets: list[tuple[int, str]], width: float = 800, height: float = 1200):
    """(pre, property, value, rank, spec, order) of every declaration that applies to an element."""
    t, number, n = Tree(root), {}, 0
    for k, x in enumerate(root.walk()):
        number[id(x)] = k
    indexes = []
    for origin, css in sheets:
        index, n = (_kept_index if len(css) <= _KEPT else _index)(origin, css, n, width, height)
        indexes.append(index)
    for x in root.walk():
        if x.tag.startswith("#"):
            continue
        best: dict[int, tuple] = {}
        keys = [x.tag, "", "#" + x.attrs.get("id", ""), *("." + c for c in x.attrs.get("class", "").split())]
        for origin, r, s in (c for k in dict.fromkeys(keys) for index in indexes if k in index for c in index[k]):
            if t.matches(s, x) and (r.order not in best or best[r.order][2] < s.spec):
                best[r.order] = (origin, r, s.spec)
        for origin, r, spec in best.values():
            for name, value, important in r.declarations:
                for p, v in longhands(name, value):
                    yield number[id(x)], p, v, RANK[origin, important], spec[0] << 20 | spec[1] << 10 | spec[2], r.order
        for name, value, important in declarations(x.attrs.get("style", "")):
            for p, v in longhands(name, value):
                yield number[id(x)], p, v, RANK[AUTHOR, important], (1 << 30) - 1, (1 << 31) - 1


def _style(root: Node) -> str:
    return "\n".join("".join(c.text for c in s.children) for s in root.find("style"))


RULES = "rule int, selector string, spec int, media string, property string, value string, important boolean"


def rules_of(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Declarations of the documents' style elements: a row a selector and declaration."""

    def rows(m):
        return [
            (r.order, text.strip(), s.spec[0] << 20 | s.spec[1] << 10 | s.spec[2], r.media, name, value, important)
            for r in parse_sheet(_style(parse(m)))
            for s, text in zip(r.selectors, _split(r.text, ","), strict=True)
            for name, value, important in r.declarations
        ]

    return _each(df, id_col, html_col, RULES, rows)


def declared_of(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Every declaration that applies to an element of a document."""

    def rows(m):
        root = parse(m)
        tags = [n.tag for n in root.walk()]
        return [(pre, tags[pre], *rest) for pre, *rest in declared(root, [(AUTHOR, _style(root))])]

    return _each(df, id_col, html_col, "pre int, tag string, property string, value string, rank int, spec int, ord long", rows)


def winners(found: DataFrame, keys: list[str]) -> DataFrame:
    """The heaviest declaration of each element and property: rank, then specificity, then order; later wins."""
    return found.groupBy(*keys, "property").agg(F.max_by("value", F.struct("rank", "spec", "ord")).alias("value"))


def selected_of(df: DataFrame, selector: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, ord, tag, attrs, text) of the elements that a selector picks, matched within the document: nothing is shuffled."""

    def rows(markup: str):
        return [(k, n.tag, {a: v or "" for a, v in n.attrs.items()}, " ".join(node_text(n).split())) for k, n in enumerate(select(parse(markup), selector))]

    return _each(df, id_col, html_col, "ord int, tag string, attrs map<string,string>, text string", rows)


# -- computed styles --------------------------------------------------------------------------

#: What a page looks like without any sheet of its own: the defaults that HTML suggests. Fixed values.
DEFAULTS = """
html, address, article, aside, blockquote, body, center, dd, details, dialog, dir, div, dl, dt, fieldset, figcaption, figure, footer, form, h1, h2, h3, h4, h5, h6, header, hgroup, hr, main, menu, nav, ol, p, pre, section, summary, ul { display: block }
head, script, style, title, template, link, meta, base, rp { display: none }
li { display: list-item } table { display: table } tr { display: table-row } td, th { display: table-cell } thead { display: table-header-group } tbody { display: table-row-group } caption { display: table-caption }
body { margin: 8px } p, blockquote, figure, dl, ul, ol, menu, pre { margin-top: 1em; margin-bottom: 1em } blockquote, figure { margin-left: 40px; margin-right: 40px } dd { margin-left: 40px } ul, ol, menu { padding-left: 40px }
h1 { font-size: 2em; margin-top: .67em; margin-bottom: .67em } h2 { font-size: 1.5em; margin-top: .83em; margin-bottom: .83em } h3 { font-size: 1.17em; margin-top: 1em; margin-bottom: 1em }
h4 { margin-top: 1.33em; margin-bottom: 1.33em } h5 { font-size: .83em; margin-top: 1.67em; margin-bottom: 1.67em } h6 { font-size: .67em; margin-top: 2.33em; margin-bottom: 2.33em }
h1, h2, h3, h4, h5, h6, b, strong, th { font-weight: bold } i, em, cite, var, dfn, address { font-style: italic } code, kbd, samp, tt, pre { font-family: monospace } pre { white-space: pre }
small { font-size: smaller } big { font-size: larger } sub { vertical-align: sub; font-size: smaller } sup { vertical-align: super; font-size: smaller } u, ins { text-decoration: underline } s, strike, del { text-decoration: line-through }
ul { list-style-type: disc } ol { list-style-type: decimal } ul ul, ol ul { list-style-type: circle } th, center, caption { text-align: center } a[href] { color: #0000ee; text-decoration: underline }
"""
#: Sizes of font keywords in pixels, medium at 16. Fixed values.
FONT_SIZES = {"xx-small": 9.6, "x-small": 12.0, "small": 128 / 9, "medium": 16.0, "large": 19.2, "x-large": 24.0, "xx-large": 32.0, "xxx-large": 48.0}
_IMPORT = re.compile(r"""@import\s+(?:url\(\s*)?["']?([^"')\s;]+)["']?\s*\)?\s*([^;{]*);""", re.I)


def _number(n: float) -> str:
    return f"{round(n, 4):g}px"


def _font_size(value: str, parent: float) -> float:
    v = value.strip().lower()
    if v in FONT_SIZES:
        return FONT_SIZES[v]
    if v in ("smaller", "larger"):
        return parent / 1.2 if v == "smaller" else parent * 1.2
    if m := re.fullmatch(r"([+-]?[\d.]+)%", v):
        return max(0.0, float(m[1]) * parent / 100)
    px = to_px(v, parent)
    return parent if px is None else max(0.0, px)


def _font_weight(value: str, parent: int) -> int:
    v = value.strip().lower()
    if v == "bolder":
        return 400 if parent < 400 else 700 if parent < 600 else 900
    if v == "lighter":
        return 700 if parent > 700 else 400 if parent > 500 else 100
    n = {"normal": 400, "bold": 700}.get(v, int(v) if v.isdigit() else 0)
    return n if 1 <= n <= 1000 else parent


@lru_cache(maxsize=1)
def _names(colors: str) -> dict[str, str]:
    words = colors.split()
    return dict(zip(words[::2], words[1::2], strict=True))


def _color(value: str, current: str) -> str:
    """rgb() of a hexadecimal or named colour; anything else as it stands."""
    from docframe.functions.cssvalues import COLORS

    v = value.strip().lower()
    if v == "currentcolor":
        return current
    digits = _names(COLORS).get(v) or (v[1:] if re.fullmatch("#([0-9a-f]{3}|[0-9a-f]{6})", v) else "")
    digits = "".join(c * 2 for c in digits) if len(digits) == 3 else digits
    return f"rgb({int(digits[:2], 16)}, {int(digits[2:4], 16)}, {int(digits[4:], 16)})" if digits else v


def computed(root: Node, sheets: list[tuple[int, str]], width: float = 800, height: float = 1200):
    """(pre, tag, property, value) of every element: the winning declarations with lengths in pixels, and what it inherits."""
    best: dict[int, dict[str, tuple]] = {}
    for pre, name, value, *weight in declared(root, [(UA, DEFAULTS), *sheets], width, height):
        mine = best.setdefault(pre, {})
        if name not in mine or mine[name][0] <= weight:
            mine[name] = weight, value
    number = {id(x): k for k, x in enumerate(root.walk())}
    start = {"font-size": 16.0, "font-weight": 400, "color": "rgb(0, 0, 0)"}
    stack = [(root, start)]
    while stack:
        x, above = stack.pop()
        style = above
        if not x.tag.startswith("#"):
            own = {}
            for k, (_, v) in best.get(number[id(x)], {}).items():
                word = v.strip().lower()
                if word == "inherit" or (word == "unset" and k in INHERITED):
                    if k in above:
                        own[k] = above[k]
                elif word not in ("initial", "unset"):
                    own[k] = v
                elif k in start:
                    own[k] = start[k]
            style = {k: v for k, v in above.items() if k in INHERITED} | own
            em = style["font-size"] = _font_size(own["font-size"], above["font-size"]) if isinstance(own.get("font-size"), str) else style["font-size"]
            if isinstance(own.get("font-weight"), str):
                style["font-weight"] = _font_weight(own["font-weight"], above["font-weight"])
            if isinstance(own.get("color"), str):
                style["color"] = _color(own["color"], above["color"])
            for k, v in own.items():
                if k in ("font-size", "font-weight", "color") or not isinstance(v, str):
                    continue
                px = to_px(v, em) if k != "line-height" else None
                style[k] = _number(px) if px is not None else _color(v, style["color"]) if k.endswith("color") else v
            for k, v in style.items():
                yield number[id(x)], x.tag, k, _number(v) if k == "font-size" else str(v)
        stack.extend((c, style) for c in reversed(x.children))


def sheets_of(root: Node, load=lambda href, base: None, width: float = 800, height: float = 1200) -> list[tuple[int, str]]:
    """The author's sheets in document order: style elements, linked sheets, and what these import. load(href, from) gives a sheet's text."""
    out: list[tuple[int, str]] = []

    def add(text: str, base, depth: int, seen: frozenset):
        rest = _COMMENT.sub("", text)
        while m := _IMPORT.match(rest.lstrip()):
            rest = rest.lstrip()[m.end() :]
            key = (base, m[1])
            if depth < 16 and key not in seen and media_matches(m[2].strip(), width, height):
                found = load(m[1], base)
                if found is not None:
                    add(found[0], found[1], depth + 1, seen | {key})
        out.append((AUTHOR, rest))

    for x in root.walk():
        if not media_matches(x.attrs.get("media") or "", width, height):
            continue
        if x.tag == "style":
            add("".join(c.text for c in x.children), None, 0, frozenset())
        elif x.tag == "link" and "stylesheet" in (x.attrs.get("rel") or "").lower().split() and "alternate" not in (x.attrs.get("rel") or "").lower().split() and x.attrs.get("href"):
            found = load(x.attrs["href"], None)
            if found is not None:
                add(found[0], found[1], 0, frozenset())
    return out


#: Properties that computed styles have a use for.
KNOWN = INHERITED | frozenset(
    "display position float clear width height min-width max-width min-height max-height top right bottom left overflow vertical-align text-decoration background-color list-style-image page-break-before page-break-after border-collapse border-spacing table-layout".split()
) | {f"{p}-{s}" for p in ("margin", "padding") for s in _SIDES} | {f"border-{s}-{k}" for s in _SIDES for k in ("width", "style", "color")}


def coverage(css: str) -> tuple[int, int]:
    """Declarations of a sheet with a known property, and the others."""
    names = [k for r in parse_sheet(css) for name, value, _ in r.declarations for k, _ in longhands(name, value)[:1]]
    known = sum(n in KNOWN for n in names)
    return known, len(names) - known


def computed_of(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pre, tag, property, value): computed styles of every element of a document."""

    def rows(m):
        root = parse(m)
        return list(computed(root, sheets_of(root)))

    return _each(df, id_col, html_col, "pre int, tag string, property string, value string", rows)
