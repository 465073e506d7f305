"""Markup as a relation of nodes, and what is read from a tree: text, Markdown, headings.

The parser is a kernel over one document: a tokenizer feeding a tree builder
with implied end tags and reopened formatting elements. Nodes carry a pre/post
interval, so descendants are an interval join and children an equi-join.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.batches import small
from docframe.functions.text import BLOCKS, SILENT

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEAD_ONLY = frozenset("base link meta title style script".split())
_BLOCKS = frozenset(BLOCKS)
#: An open element that a start tag ends, and where the search for it stops.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
_HOLDS_P = {"table", "td", "th", "caption", "button", "html", "body", "object", "template"}
WIDE = re.compile("[ᄀ-ᇿ⺀-〾ぁ-㏿㐀-䶿一-鿿ꀀ-꓏가-힣豈-﫿︰-﹏＀-｠￠-￦\U00020000-\U0003fffd]")
SPACE, _SPACES = re.compile("[ \t\n\r\f\v]+"), " \t\n\r\f\v"
MOST_DEPTH = 512


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    text: str = ""
    children: list[Node] = field(default_factory=list)

    def walk(self):
        """Pre-order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def find(self, *tags: str):
        return (n for n in self.walk() if n.tag in tags)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.html = Node("html")
        self.head, self.body = Node("head"), Node("body")
        self.root.children.append(self.html)
        self.html.children += [self.head, self.body]
        self.open, self.in_head, self.formats = [self.body], True, []

    def handle_decl(self, decl):
        pass

    def handle_comment(self, data):
        self.place.children.append(Node("#comment", text=data))

    @property
    def place(self) -> Node:
        return self.head if self.in_head else self.open[-1]

    def handle_data(self, data):
        if self.in_head and self.open[-1] is self.body:
            if not data.strip(" \t\n\r\f\v"):
                return
            self.in_head = False
        at = self.open[-1]
        if at.tag not in ("script", "style", "title", "textarea"):
            if data.strip(" \t\n\r\f\v"):
                self.reopen()
            at = self.open[-1]
        if at.children and at.children[-1].tag == "#text":
            at.children[-1].text += data
        else:
            at.children.append(Node("#text", text=data))

    def reopen(self):
        for n in self.formats:
            if not any(n is o for o in self.open) and len(self.open) < MOST_DEPTH:
                again = Node(n.tag, dict(n.attrs))
                self.open[-1].children.append(again)
                self.open.append(again)
                self.formats[next(i for i, x in enumerate(self.formats) if x is n)] = again

    def close_to(self, tags, stops=frozenset()):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return True
            if self.open[i].tag in stops:
                return False
        return False

    def handle_starttag(self, tag, attrs):
        given = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        if tag in ("html", "head", "body"):
            target = {"html": self.html, "head": self.head, "body": self.body}[tag]
            for k, v in given.items():
                target.attrs.setdefault(k, v)
            if tag == "body":
                self.in_head = False
            return
        if self.in_head and self.open[-1] is self.body and tag not in HEAD_ONLY:
            self.in_head = False
        if not self.in_head:
            if tag in _BLOCKS and tag not in ("td", "th", "tr", "thead", "tfoot", "body"):
                self.close_to({"p"}, _HOLDS_P)
            if tag in _ENDS:
                ends, stops = _ENDS[tag]
                while self.close_to(ends, stops | (_BLOCKS - {"div", "address", "p"} - ends if tag in ("li", "dt", "dd") else set())):
                    pass
            if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", self.open[-1].tag):
                self.open.pop()
            if tag == "a":
                self.end_format("a")
            if tag not in _BLOCKS and tag not in HEAD_ONLY and tag not in _ENDS:
                self.reopen()
        node = Node(tag, given)
        self.place.children.append(node) if self.in_head and self.open[-1] is self.body else self.open[-1].children.append(node)
        if tag in VOID or len(self.open) >= MOST_DEPTH:
            return
        self.open.append(node)
        if tag in FORMATTING:
            self.formats.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def end_format(self, tag):
        last = next((n for n in reversed(self.formats) if n.tag == tag), None)
        if last is None:
            return
        self.formats = [n for n in self.formats if n is not last]
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i] is last:
                if any(n.tag in _BLOCKS for n in self.open[i + 1 :]):
                    return  # stays around the block; what follows is not reopened
                del self.open[i:]
                return

    def handle_endtag(self, tag):
        if tag == "head":
            self.in_head = False
        elif tag in ("html", "body") or tag in VOID - {"br"}:
            return
        elif tag == "br":
            self.handle_starttag("br", [])
        elif tag in FORMATTING:
            self.end_format(tag)
        elif tag == "p":
            if not self.close_to({"p"}, _HOLDS_P):
                self.handle_starttag("p", [])
                self.close_to({"p"})
        elif re.fullmatch("h[1-6]", tag):
            self.close_to({f"h{k}" for k in range(1, 7)}, _HOLDS_P)
        else:
            self.close_to({tag}, {"table", "td", "th"} - {tag} if tag not in ("tr", "tbody", "thead", "tfoot", "table") else frozenset({"table"}) - {tag})


_REFERENCE = re.compile("&(#?[0-9A-Za-z]+)(;?)")


def ended(markup: str, unended: Collection[str] | None) -> str:
    """Markup in which a character reference without its semicolon is text, unless it begins with a name of unended.

    None leaves the markup as it is: all names that HTML reads without a semicolon count.
    """
    if unended is None:
        return markup
    names = tuple(unended)

    def kept(m):
        whole = m[2] and (m[1][0] == "#" or m[1] + ";" in html5)
        return m[0] if whole or m[1].startswith(names) else "&amp;" + m[0][1:]

    return _REFERENCE.sub(kept, markup)


def parse(markup: str, unended: Collection[str] | None = None) -> Node:
    """The tree of a document; whatever is wrong with the markup, a tree. For unended see `ended`."""
    b = _Builder()
    b.feed(ended(markup, unended))
    b.close()
    return b.root


def node_text(node: Node) -> str:
    """Block-aware text: lines end at blocks and br, white space collapses, none stands between two wide characters."""
    out: list[str] = []
    state = {"space": False, "breaks": 0, "last": ""}

    def newline():
        if out or state["breaks"]:
            state["breaks"], state["space"] = 1, False

    def flush(nxt: str):
        if state["breaks"]:
            out.append("\n" * state["breaks"])
            state["last"] = "\n"
        elif state["space"] and not (WIDE.match(state["last"]) and WIDE.match(nxt)):
            out.append(" ")
            state["last"] = " "
        state["breaks"], state["space"] = 0, False

    def visit(n: Node, pre: bool):
        if n.tag == "#text":
            if pre:
                flush("")
                out.append(n.text)
                state["last"] = n.text[-1:] or state["last"]
                return
            if n.text.isascii() or not WIDE.search(n.text):  # a space stands between any two words
                body = n.text.strip(_SPACES)
                if body:
                    state["space"] |= bool(out) and n.text[0] in _SPACES
                    flush(body[0])
                    out.append(SPACE.sub(" ", body))
                    state["last"] = body[-1]
                    state["space"] = n.text[-1] in _SPACES
                elif n.text and out:
                    state["space"] = True
                return
            at = 0
            for m in SPACE.finditer(n.text + " "):
                word = n.text[at : m.start()]
                if word:
                    flush(word[0])
                    out.append(word)
                    state["last"] = word[-1]
                at = m.end()
                if out and m.start() < len(n.text):
                    state["space"] = True
            return
        if n.tag in SILENT or n.tag in ("img", "#comment"):
            return
        if n.tag == "br":
            newline()
            return
        inside = n.tag in _BLOCKS
        if inside:
            newline()
        for c in n.children:
            visit(c, pre or n.tag == "pre")
        if inside:
            newline()

    visit(node, False)
    return "".join(out).lstrip("\n")


def headings(node: Node):
    """(level, title, id) of h1..h6 in order; a heading's inside is not searched, empty titles are dropped."""
    stack = [node]
    while stack:
        n = stack.pop()
        if re.fullmatch("h[1-6]", n.tag):
            title = " ".join(node_text(n).split())
            if title:
                yield int(n.tag[1]), title, n.attrs.get("id", "")
            continue
        stack.extend(reversed(n.children))


NODES = "pre int, post int, parent int, ord int, depth int, type string, tag string, attrs map<string,string>, text string"


def node_rows(markup: str) -> list[tuple]:
    """Rows of NODES: pre and post order numbers; a descendant has a greater pre and a smaller post."""
    rows: list[list] = []
    counter = [0]
    stack: list = [(parse(markup), -1, 0, 0)]
    while stack:
        item = stack.pop()
        if isinstance(item, int):
            rows[item][1] = counter[0]
            counter[0] += 1
            continue
        n, parent, order, depth = item
        pre = len(rows)
        kind = {"#text": "text", "#comment": "comment", "#document": "document"}.get(n.tag, "element")
        rows.append([pre, 0, parent, order, depth, kind, n.tag if kind == "element" else None, n.attrs or None, n.text if kind in ("text", "comment") else None])
        stack.append(pre)
        stack.extend((c, pre, k, depth + 1) for k, c in reversed(list(enumerate(n.children))))
    return [tuple(r) for r in rows]


#: Rows and characters of markup at which a kernel hands on a record batch.
_ROWS, _CHARS = 16_384, 1 << 20


def _each(df: DataFrame, id_col: str, html_col: str, schema: str, rows_of) -> DataFrame:
    """rows_of(markup) over all rows, Arrow batches in and out."""
    kind = dict(df.dtypes)[id_col]
    full = f"{id_col} {kind}, {schema}"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at, cols, size = [], [[] for _ in arrow.names[1:]], 0
            for k, markup in enumerate(b.column(1)):
                markup = markup.as_py() or ""
                for r in rows_of(markup):
                    at.append(k)
                    for c, v in zip(cols, r, strict=True):
                        c.append(v)
                size += len(markup)
                if len(at) >= _ROWS or size >= _CHARS:
                    yield made(pa, b.column(0), at, cols)
                    at, cols, size = [], [[] for _ in cols], 0
            if at:
                yield made(pa, b.column(0), at, cols)

    def made(pa, ids, at, cols):
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(c, f.type) for c, f in zip(cols, list(arrow)[1:], strict=True))], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], full).schema)
    small(df.sparkSession)
    return df.select(id_col, html_col).mapInArrow(run, full)


def nodes(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row a node of every document."""
    return _each(df, id_col, html_col, NODES, node_rows)


def text_of(df: DataFrame, id_col: str = "page_id", html_col: str = "html", unended: Collection[str] | None = None) -> DataFrame:
    return _each(df, id_col, html_col, "text string", lambda m: [(node_text(parse(m, unended)),)])


def text_by_either(df: DataFrame, id_col: str = "page_id", html_col: str = "html", unended: Collection[str] | None = None) -> DataFrame:
    """The same as text_of, by native expressions for the rows whose markup these read alike."""
    from docframe.functions import text

    html = F.col(html_col)
    plain = df.where(~text.needs_kernel(html)).select(id_col, text.node_text(html).alias("text"))
    return plain.union(text_of(df.where(text.needs_kernel(html)), id_col, html_col, unended))


def headings_of(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    return _each(df, id_col, html_col, "ord int, level int, title string, fragment string", lambda m: [(i, *h) for i, h in enumerate(headings(parse(m)))])


def select(found: DataFrame, id_col: str, *steps: tuple[str, str]) -> DataFrame:
    """Nodes that a chain of (combinator, SQL condition on a node) selects: ' ' descendant, '>' child, '+' next, '~' later sibling.

    The first step's combinator is not read. Descendants are an interval join
    within a document, the others equi-joins; siblings count elements only.
    """
    element = F.row_number().over(_siblings(id_col))
    all_ = found.where("type = 'element'").withColumn("sib", element)
    out = all_.where(steps[0][1])
    for how, condition in steps[1:]:
        left = out.select(F.col(id_col).alias("_d"), F.col("pre").alias("_pre"), F.col("post").alias("_post"), F.col("parent").alias("_parent"), F.col("sib").alias("_sib"))
        near = {
            " ": (F.col("pre") > F.col("_pre")) & (F.col("post") < F.col("_post")),
            ">": F.col("parent") == F.col("_pre"),
            "+": (F.col("parent") == F.col("_parent")) & (F.col("sib") == F.col("_sib") + 1),
            "~": (F.col("parent") == F.col("_parent")) & (F.col("sib") > F.col("_sib")),
        }[how]
        out = all_.where(condition).join(left, (F.col(id_col) == F.col("_d")) & near, "left_semi")
    return out


def _siblings(id_col: str):
    from pyspark.sql import Window

    return Window.partitionBy(id_col, "parent").orderBy("ord")


def inner_text(found: DataFrame, chosen: DataFrame, id_col: str) -> DataFrame:
    """Text of each chosen node, white space squashed: its text descendants in order."""
    text = found.where("type = 'text'").select(F.col(id_col).alias("_d"), F.col("pre").alias("_p"), F.col("post").alias("_q"), F.col("text").alias("_t"))
    inside = (F.col(id_col) == F.col("_d")) & (F.col("_p") > F.col("pre")) & (F.col("_q") < F.col("post"))
    joined = chosen.select(id_col, "pre", "post").join(text, inside, "left").groupBy(id_col, "pre").agg(F.array_sort(F.collect_list(F.struct("_p", "_t"))).alias("_ts"))
    return joined.select(id_col, "pre", F.trim(F.regexp_replace(F.array_join(F.transform("_ts", lambda t: t["_t"]), ""), r"\s+", " ")).alias("text"))
