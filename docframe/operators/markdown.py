"""Markdown of a tree of markup.

A block writer over the nodes of dom.parse: headings, paragraphs, rules, fenced
code, quotes, nested lists, definition lists and pipe tables. A table with
spans, nested tables or blocks in its cells is left as markup.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from docframe.functions.text import BLOCKS
from docframe.operators.dom import Node, _each, node_text, parse

DEEPEST, MOST_CELLS = 256, 1 << 20
_SKIP = {"head", "script", "style", "title", "template", "noscript", "#comment"}
_BLOCKS = frozenset(BLOCKS) - {"td", "th", "tr", "thead", "tfoot"} | {"tbody", "html"}
_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "strike": "~~"}
_RAW = {"sup", "sub", "mark", "abbr"}


def escape(s: str) -> str:
    s = re.sub(r"([\\`*\[\]<])", r"\\\1", s)
    return re.sub(r"(?<![0-9A-Za-z\x80-\U0010ffff])_|_(?![0-9A-Za-z\x80-\U0010ffff])", r"\\_", s)


def lead(s: str) -> str:
    if s[:1] in tuple("#>-+=|"):
        return "\\" + s
    return re.sub(r"^([0-9]+)([.)])", r"\1\\\2", s)


def url(s: str) -> str:
    return f"<{s}>" if re.search(r"[ ()]", s) else s


def code(s: str) -> str:
    """In the fewest backticks that the text itself does not hold in a row."""
    runs = {len(r) for r in re.findall("`+", s)}
    n = next(k for k in range(1, len(runs) + 2) if k not in runs)
    pad = " " if s[:1] == "`" or s[-1:] == "`" else ""
    return f"{'`' * n}{pad}{s}{pad}{'`' * n}"


def inline(node: Node, depth: int = 0) -> str:
    out = []
    for c in node.children if depth < DEEPEST else []:
        if c.tag == "#text":
            out.append(escape(re.sub(r"[ \t\n\r\f\v]+", " ", c.text)))
        elif c.tag in _SKIP:
            continue
        elif c.tag == "br":
            out.append("  \n")
        elif c.tag == "img":
            if c.attrs.get("src"):
                out.append(f"![{escape(c.attrs.get('alt', ''))}]({url(c.attrs['src'])})")
        elif c.tag == "a" and c.attrs.get("href"):
            label = squeeze(inline(c, depth + 1))
            if label:
                out.append(f"[{label}]({url(c.attrs['href'])})")
        elif c.tag in _MARKS:
            body = inline(c, depth + 1)
            word = body.strip()
            if word:
                at = body.index(word)
                out.append(f"{body[:at]}{_MARKS[c.tag]}{word}{_MARKS[c.tag]}{body[at + len(word):]}")
        elif c.tag in ("code", "kbd", "samp", "tt"):
            text = node_text(c)
            if text:
                out.append(code(text))
        elif c.tag in _RAW:
            out.append(f"<{c.tag}>{inline(c, depth + 1)}</{c.tag}>")
        else:
            out.append(inline(c, depth + 1))
    return "".join(out)


def squeeze(s: str) -> str:
    """White space collapsed, hard breaks kept."""
    lines = [re.sub(r"[ \t\n\r\f\v]+", " ", x).strip() for x in s.split("  \n")]
    return "  \n".join(lines).strip()


def markup(node: Node) -> str:
    if node.tag == "#text":
        return html.escape(node.text, quote=False)
    if node.tag.startswith("#"):
        return ""
    attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attrs}>" + "".join(map(markup, node.children)) + f"</{node.tag}>"


def table(node: Node) -> str:
    rows = []
    stack = list(reversed(node.children))
    while stack:
        n = stack.pop()
        if n.tag in ("thead", "tbody", "tfoot"):
            stack.extend(reversed(n.children))
        elif n.tag == "tr":
            rows.append([c for c in n.children if c.tag in ("td", "th")])
    cells = [c for r in rows for c in r]
    wide = max((len(r) for r in rows), default=0)
    plain = all(c.attrs.get("colspan", "1") == "1" and c.attrs.get("rowspan", "1") == "1" and not any(x.tag in _BLOCKS and x.tag not in ("p", "div") for x in c.walk() if x is not c) for c in cells)
    if not cells or not plain or wide * len(rows) > MOST_CELLS:
        return markup(node) if cells else ""

    def cell(c: Node) -> str:
        parts = [squeeze(inline(x)) for x in c.children if x.tag in ("p", "div")] if any(x.tag in ("p", "div") for x in c.children) else [squeeze(inline(c))]
        return "<br>".join(p for p in parts if p).replace("|", "\\|").replace("  \n", "<br>")

    lines = ["| " + " | ".join([*map(cell, r), *[""] * (wide - len(r))]) + " |" for r in rows]
    lines.insert(1, "|" + " --- |" * wide)
    return "\n".join(lines)


def items(node: Node, depth: int) -> str:
    start = node.attrs.get("start", "1")
    number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    lis = [c for c in node.children if c.tag == "li"]
    loose = any(sum(x.tag in _BLOCKS and x.tag not in ("ul", "ol") for x in li.children) > 1 for li in lis)
    out = []
    for k, li in enumerate(lis):
        mark = f"{number + k}. " if node.tag == "ol" else "- "
        body = blocks(li, depth + 1, tight=not loose)
        out.append(mark + body.replace("\n", "\n" + " " * len(mark)) if body else mark.rstrip())
    return ("\n\n" if loose else "\n").join(re.sub(r"\n +(?=\n)", "\n", x) for x in out)


def blocks(node: Node, depth: int = 0, tight: bool = False) -> str:
    if depth > DEEPEST:
        return ""
    out: list[str] = []
    run: list[Node] = []

    def flush():
        text = squeeze(inline(Node("#run", children=list(run))))
        run.clear()
        if text:
            out.append("\n".join(map(lead, text.split("\n"))))

    for c in node.children:
        if c.tag in _SKIP:
            continue
        if c.tag not in _BLOCKS:
            run.append(c)
            continue
        flush()
        if re.fullmatch("h[1-6]", c.tag):
            text = squeeze(inline(c)).replace("  \n", " ")
            new = f"{'#' * int(c.tag[1])} {text}" if text else ""
        elif c.tag == "hr":
            new = "---"
        elif c.tag == "pre":
            body = node_text(c).strip("\n")
            fence = "`" * max(3, 1 + max((len(r) for r in re.findall("`+", body)), default=0))
            new = f"{fence}\n{body}\n{fence}"
        elif c.tag == "blockquote":
            new = "\n".join(("> " + x).rstrip() for x in blocks(c, depth + 1).split("\n"))
        elif c.tag in ("ul", "ol"):
            new = items(c, depth + 1)
        elif c.tag == "table":
            new = table(c)
        elif c.tag == "dt":
            text = squeeze(inline(c))
            new = f"**{text}**" if text else ""
        elif c.tag == "dd":
            new = "  " + blocks(c, depth + 1).replace("\n", "\n  ")
        else:
            new = blocks(c, depth + 1)
        if new.strip():
            out.append(new)
    flush()
    return ("\n" if tight else "\n\n").join(out)


def to_markdown(source: str) -> str:
    """Markdown of a document of markup."""
    return blocks(parse(source))


def markdown_of(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    return _each(df, id_col, html_col, "markdown string", lambda m: [(to_markdown(m),)])
