"""SVG: title, description, text and links of a drawing."""

from __future__ import annotations

import gzip
import re

from docframe.functions.sniff import ROOT
from docframe.sources.xml import X, tree


def is_svg(b: bytes) -> bool:
    head = (_plain(b) if b[:2] == b"\x1f\x8b" else b)[:1024].decode("latin-1")
    m = re.search(ROOT, head)
    return bool(m) and m[1].lower().split(":")[-1] == "svg"


def _plain(b: bytes) -> bytes:
    if b[:2] != b"\x1f\x8b":
        return b
    with gzip.open(__import__("io").BytesIO(b)) as z:
        return z.read(64 << 20)


def text_lines(x: X):
    """A line for each text element that is drawn; white space collapsed."""
    hidden = {"defs", "symbol", "clipPath", "mask", "pattern", "marker", "title", "desc", "style", "script", "metadata"}
    if x.tag in hidden or x.attrs.get("display") == "none":
        return
    if x.tag == "text":
        t = " ".join(x.all_text().split())
        if t:
            yield t
        return
    if x.tag == "switch":
        chosen = next((c for c in x.children if "requiredExtensions" not in c.attrs and c.attrs.get("systemLanguage", "en").split("-")[0] == "en"), None)
        if chosen is not None:
            yield from text_lines(chosen)
        return
    for c in x.children:
        yield from text_lines(c)


def links(x: X):
    for a in x.find_all("a"):
        if a.attrs.get("href"):
            yield a.attrs["href"], " ".join(a.all_text().split())


def open_svg(b: bytes):
    from docframe.sources.containers import Book, Part

    root = tree(_plain(b))
    one = lambda tag: " ".join(c.all_text().strip() for c in root.children[:] if c.tag == tag)
    book = Book("svg", metadata={"title": one("title"), "description": one("desc")})
    book.parts = [Part("drawing", "text/plain", "\n".join(text_lines(root)).encode(), spine=0)]
    return book
