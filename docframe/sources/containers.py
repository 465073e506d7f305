"""Book and office containers: their parts, metadata, reading order, outline and text.

Kernels over the bytes of one document. `open_book` gives a Book whatever the
container; damaged input gives what could be read and a list of errors.
"""

from __future__ import annotations

import hashlib
import html
import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Collection
from dataclasses import dataclass, field
from urllib.parse import unquote
from xml.etree import ElementTree

from docframe.functions.sniff import READS_AS_MARKUP, TITLE
from docframe.operators import dom
from docframe.sources import spreadsheet
from docframe.sources.huff import Huff
from docframe.sources.xml import X, tree

MOST_PART = 64 << 20
CHAPTERS = ("application/xhtml+xml", "text/html", "application/x-dtbook+xml", "text/plain")


@dataclass
class Part:
    path: str
    media_type: str
    data: bytes
    item_id: str = ""
    spine: int | None = None
    linear: bool = True


@dataclass
class Book:
    kind: str
    parts: list[Part] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)
    outline: list[tuple[int, str, str, str]] = field(default_factory=list)  # depth, title, path, fragment
    errors: list[str] = field(default_factory=list)
    cells: list[spreadsheet.Cell] = field(default_factory=list)

    def spine(self) -> list[Part]:
        return sorted((p for p in self.parts if p.spine is not None), key=lambda p: p.spine)

    def toc(self, unended: Collection[str] | None = None):
        """The container's outline, or else the headings of its parts."""
        if self.outline:
            return self.outline
        return [(level, title, p.path, frag) for p in self.spine() for level, title, frag in dom.headings(dom.parse(as_markup(p), unended))]


def decode(b: bytes) -> str:
    if b[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return b.decode("utf-16", "replace")
    m = re.match(rb"""\s*<\?xml[^>]*encoding=["']([A-Za-z0-9._-]+)""", b[:200])
    try:
        return b.decode(m[1].decode() if m else "utf-8-sig", "replace").removeprefix("﻿")
    except LookupError:
        return b.decode("utf-8", "replace")


def as_markup(p: Part) -> str:
    text = decode(p.data)
    return f"<pre>{html.escape(text, quote=False)}</pre>" if p.media_type == "text/plain" else text


def open_book(b: bytes, unended: Collection[str] | None = None) -> Book:
    """A book of any container; unknown bytes are a book without parts and an error. For unended see `dom.ended`."""
    try:
        if b[:4] == b"PK\x03\x04":
            return _zip(b)
        if b[60:68] in (b"BOOKMOBI", b"TEXtREAd"):
            return _mobi(b)
        if b"<FictionBook" in b[:512].replace(b"\0", b""):
            return _fb2(b)
        if re.match(READS_AS_MARKUP.encode(), b):
            book = Book("html", [Part("index.html", "text/html", b, spine=0)])
            m = re.search(TITLE, decode(b))
            book.metadata["title"] = html.unescape(dom.ended(m[1], unended)).strip() if m else ""
            return book
        if b and not re.search(rb"[\x00-\x08\x0b\x0e-\x1f]", b[:4096]):
            return Book("text", [Part("index.txt", "text/plain", b, spine=0)])
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, zlib.error, RecursionError, struct.error) as e:
        return Book("unknown", errors=[f"{type(e).__name__}: {e}"])
    return Book("unknown", errors=["unsupported"])


def text_of(book: Book, unended: Collection[str] | None = None) -> str:
    """Parts in reading order, joined by line ends."""
    return "\n".join(dom.node_text(dom.parse(as_markup(p), unended)) for p in book.spine())


# -- zip --------------------------------------------------------------------------------------


class Files:
    """Members of an archive: the first of a name, no larger than a part may be."""

    def __init__(self, b: bytes):
        self.b, self.zip, self.info = b, zipfile.ZipFile(io.BytesIO(b)), {}
        for i in self.zip.infolist():
            self.info.setdefault(i.filename, i)

    def __contains__(self, name):
        return name in self.info

    def get(self, name: str) -> bytes:
        if self.info[name].file_size > MOST_PART:
            raise ValueError(f"{name} is larger than {MOST_PART} bytes")
        i = self.info[name]
        at = i.header_offset
        head = self.b[at : at + 30]
        if i.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) and not i.flag_bits & 0x61 and head[:4] == b"PK\x03\x04":
            n = int.from_bytes(head[26:28], "little")
            if self.b[at + 30 : at + 30 + n] == i.orig_filename.encode("utf-8" if i.flag_bits & 0x800 else "cp437", "replace"):
                at += 30 + n + int.from_bytes(head[28:30], "little")
                if (end := getattr(i, "_end_offset", None)) is not None and at + i.compress_size > end:
                    return self.zip.read(i)  # which refuses entries that overlap
                data = self.b[at : at + i.compress_size]
                try:
                    data = data if i.compress_type == zipfile.ZIP_STORED else zlib.decompressobj(-15).decompress(data, MOST_PART + 1)
                except zlib.error:
                    data = b""
                if len(data) == i.file_size and zlib.crc32(data) == i.CRC:
                    return data
        return self.zip.read(i)  # anything else, and what is wrong with it

    def tree(self, name: str) -> X | None:
        return tree(self.get(name)) if name in self.info else None


def _zip(b: bytes) -> Book:
    f = Files(b)
    if "word/document.xml" in f:
        return _docx(f)
    if "ppt/presentation.xml" in f:
        return _pptx(f)
    if "xl/workbook.xml" in f:
        return _xlsx(f)
    fb2 = next((n for n in f.info if n.lower().endswith(".fb2")), None)
    if fb2 and "META-INF/container.xml" not in f:
        return _fb2(f.get(fb2))
    return _epub(f)


def rel(base: str, href: str) -> str:
    href = unquote(href.split("#")[0].split("?")[0])
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), href)).lstrip("/") if href else base


# -- EPUB -------------------------------------------------------------------------------------


def _epub(f: Files) -> Book:
    book = Book("epub")
    root = next((r.attrs["full-path"] for r in f.tree("META-INF/container.xml").find_all("rootfile") if r.attrs.get("full-path")), None)
    if root is None or root not in f:
        raise ValueError("no package")
    opf = f.tree(root)
    meta = opf.first("metadata") or X("metadata")
    ids = {x.attrs.get("id"): x.all_text().strip() for x in meta.children if x.tag == "identifier"}
    one = lambda tag: next((x.all_text().strip() for x in meta.children if x.tag == tag and x.all_text().strip()), "")
    book.metadata = {
        "title": one("title"), "author": ", ".join(t for x in meta.children if x.tag == "creator" and (t := x.all_text().strip())), "language": one("language"), "publisher": one("publisher"),
        "description": one("description"), "identifier": ids.get(opf.attrs.get("unique-identifier")) or one("identifier"), "created": one("date"),
        "modified": next((x.all_text().strip() for x in meta.children if x.tag == "meta" and x.attrs.get("property") == "dcterms:modified"), ""),
        "subjects": "; ".join(t for x in meta.children if x.tag == "subject" and (t := x.all_text().strip())),
    }
    keys, items, nav, ncx = _obfuscated(f, book.metadata["identifier"]), {}, None, None
    for x in (opf.first("manifest") or X("m")).children:
        if x.tag != "item" or not x.attrs.get("href"):
            continue
        path = rel(root, x.attrs["href"])
        try:
            data = f.get(path)
        except (KeyError, ValueError, zipfile.BadZipFile) as e:
            book.errors.append(f"{path}: {e}")
            continue
        if path in keys:
            data = unmasked(data, *keys[path])
        p = Part(path, x.attrs.get("media-type", ""), data, x.attrs.get("id", ""))
        if p.item_id not in items:
            items[p.item_id] = p
            book.parts.append(p)
        if "nav" in x.attrs.get("properties", "").split():
            nav = nav or p
        if p.media_type == "application/x-dtbncx+xml":
            ncx = ncx or p
    n, spine = 0, opf.first("spine") or X("spine")
    for x in spine.children:
        p = items.get(x.attrs.get("idref"))
        if x.tag == "itemref" and p is not None and p.spine is None:
            p.spine, p.linear, n = n, x.attrs.get("linear") != "no", n + 1
    if not n:
        for p in book.parts:
            if p.media_type in CHAPTERS and p is not nav:
                p.spine, n = n, n + 1
    ncx = items.get(spine.attrs.get("toc")) or ncx
    if nav is not None:
        book.outline = _nav(nav)
    if not book.outline and ncx is not None:
        book.outline = _ncx(ncx)
    return book


#: How embedded fonts are masked: the algorithm's name, and so many bytes at the head. Fixed values.
MASKS = {"http://www.idpf.org/2008/embedding": 1040, "http://ns.adobe.com/pdf/enc#RC": 1024}


def mask_key(algorithm: str, identifier: str) -> bytes:
    """The key that a book's identifier gives; empty if it gives none."""
    if algorithm.startswith("http://www.idpf.org"):
        packed = "".join(identifier.split())
        return hashlib.sha1(packed.encode()).digest() if packed else b""
    digits = "".join(re.findall("[0-9A-Fa-f]", identifier.rpartition("urn:uuid:")[2]))[:32]
    return bytes.fromhex(digits) if len(digits) == 32 else b""


def unmasked(data: bytes, key: bytes, head: int) -> bytes:
    n = min(head, len(data))
    mask = (key * (n // len(key) + 1))[:n]
    return (int.from_bytes(data[:n], "big") ^ int.from_bytes(mask, "big")).to_bytes(n, "big") + data[n:]


def _obfuscated(f: Files, identifier: str) -> dict[str, tuple[bytes, int]]:
    """Paths of masked parts, their keys and how much of them is masked."""
    try:
        doc = f.tree("META-INF/encryption.xml")
    except (ValueError, zipfile.BadZipFile, ElementTree.ParseError):
        doc = None
    out = {}
    for x in doc.find_all("EncryptedData") if doc is not None else ():
        method, where = x.first("EncryptionMethod"), x.first("CipherReference")
        algorithm = method.attrs.get("Algorithm", "") if method is not None else ""
        key = mask_key(algorithm, identifier) if algorithm in MASKS else b""
        if key and where is not None and where.attrs.get("URI"):
            out[unquote(where.attrs["URI"])] = key, MASKS[algorithm]
    return out


def _nav(p: Part):
    navs = list(dom.parse(decode(p.data)).find("nav"))
    chosen = next((n for n in navs if "toc" in n.attrs.get("epub:type", "").split()), navs[0] if navs else None)
    out = []

    def walk(ol, depth):
        for li in (c for c in ol.children if c.tag == "li") if depth <= 32 else ():
            label = next((c for c in li.children if c.tag in ("a", "span")), None)
            if label is not None:
                href = label.attrs.get("href", "")
                title = " ".join(dom.node_text(label).split())
                out.append((depth, title, rel(p.path, href) if href else "", href.partition("#")[2]))
            for sub in (c for c in li.children if c.tag == "ol"):
                walk(sub, depth + 1)

    for ol in (c for c in chosen.children if c.tag == "ol") if chosen else ():
        walk(ol, 1)
    return out


def _ncx(p: Part):
    out = []

    def walk(node, depth):
        for x in (c for c in node.children if c.tag == "navPoint") if depth <= 32 else ():
            label, content = x.first("text"), next((c for c in x.children if c.tag == "content"), X("c"))
            href = content.attrs.get("src", "")
            out.append((depth, " ".join((label or X("t")).all_text().split()), rel(p.path, href) if href else "", href.partition("#")[2]))
            walk(x, depth + 1)

    points = tree(p.data).first("navMap")
    if points is not None:
        walk(points, 1)
    return out


# -- office -----------------------------------------------------------------------------------


def _rels(f: Files, part: str) -> dict[str, tuple[str, bool]]:
    """Relationship id to (target, external)."""
    t = f.tree(posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels"))
    out = {}
    for r in t.children if t else ():
        target, outside = r.attrs.get("Target", ""), r.attrs.get("TargetMode") == "External"
        out[r.attrs.get("Id", "")] = (target if outside else posixpath.normpath(posixpath.join(posixpath.dirname(part), target)).lstrip("/"), outside)
    return out


def _core(f: Files) -> dict[str, str]:
    t = f.tree("docProps/core.xml")
    names = {"title": "title", "creator": "author", "description": "description", "language": "language", "identifier": "identifier", "created": "created", "modified": "modified"}
    return {names[x.tag]: x.all_text().strip() for x in (t.children if t else ()) if x.tag in names}


def _page(title: str, body: str) -> bytes:
    return f"<html><head><title>{html.escape(title)}</title></head><body>{body}</body></html>".encode()


def _docx(f: Files) -> Book:
    book = Book("docx", metadata=_core(f))
    rels = _rels(f, "word/document.xml")
    styles = {}
    for s in (f.tree("word/styles.xml") or X("s")).find_all("style"):
        name, based, level = s.child("name"), s.child("basedOn"), s.find("outlineLvl")
        styles[s.attrs.get("styleId", "")] = ((name.attrs.get("val", "") if name else "").lower(), based.attrs.get("val", "") if based else "", level.attrs.get("val") if level else None)
    kinds = {}
    numbering = f.tree("word/numbering.xml")
    if numbering is not None:
        abstract = {a.attrs.get("abstractNumId"): {lv.attrs.get("ilvl"): lv.child("numFmt").attrs.get("val", "") if lv.child("numFmt") else "" for lv in a.children if lv.tag == "lvl"} for a in numbering.children if a.tag == "abstractNum"}
        for n in numbering.children:
            if n.tag == "num" and n.child("abstractNumId"):
                kinds[n.attrs.get("numId")] = abstract.get(n.child("abstractNumId").attrs.get("val"), {})
    notes = {}
    for part, kind in (("word/footnotes.xml", "footnote"), ("word/endnotes.xml", "endnote")):
        for n in (f.tree(part) or X("n")).children:
            if n.tag == kind and n.attrs.get("type") not in ("separator", "continuationSeparator", "continuationNotice"):
                notes[kind, n.attrs.get("id")] = n

    def heading(style: str, depth=0) -> int:
        name, based, level = styles.get(style, ("", "", None))
        m = re.fullmatch(r"heading ([1-6])", name)
        if m:
            return int(m[1])
        if name == "title":
            return 1
        if level is not None and level.isdigit() and int(level) < 6:
            return int(level) + 1
        return heading(based, depth + 1) if based and depth < 16 else 0

    on = lambda p, tag: (x := p.child(tag)) is not None and x.attrs.get("val", "on") not in ("0", "false", "off", "none")

    def runs(node: X, depth=0) -> str:
        out = []
        for r in node.children if depth < 32 else ():
            if r.tag == "hyperlink":
                target, _ = rels.get(r.attrs.get("id", ""), ("", True))
                href = target + ("#" + r.attrs["anchor"] if r.attrs.get("anchor") else "")
                out.append(f'<a href="{html.escape(href)}">{runs(r, depth + 1)}</a>' if href else runs(r, depth + 1))
            elif r.tag in ("ins", "smartTag", "sdt", "sdtContent", "fldSimple"):
                out.append(runs(r, depth + 1))
            elif r.tag == "r":
                text = []
                for c in r.children:
                    if c.tag == "t":
                        text.append(html.escape(c.all_text(), quote=False))
                    elif c.tag in ("br", "cr"):
                        text.append("<br/>")
                    elif c.tag == "tab":
                        text.append("\t")
                    elif c.tag == "noBreakHyphen":
                        text.append("‑")
                    elif c.tag == "sym" and re.fullmatch("[0-9A-Fa-f]{1,6}", c.attrs.get("char", "")):
                        text.append(f"&#x{c.attrs['char']};")
                    elif c.tag in ("footnoteReference", "endnoteReference"):
                        note = notes.get((c.tag.removesuffix("Reference"), c.attrs.get("id")))
                        text.append(f"<small>{' '.join(runs(p, depth + 1) for p in note.children if p.tag == 'p')}</small>" if note else "")
                s, p = "".join(text), r.child("rPr")
                if s and p is not None:
                    for tag, mark in (("b", "b"), ("i", "i"), ("strike", "s"), ("u", "u")):
                        if on(p, tag):
                            s = f"<{mark}>{s}</{mark}>"
                    v = p.child("vertAlign")
                    if v is not None and v.attrs.get("val") in ("superscript", "subscript"):
                        s = f"<{v.attrs['val'][:3]}>{s}</{v.attrs['val'][:3]}>"
                out.append(s)
        return "".join(out)

    def body(node: X, depth=0) -> str:
        out, lists = [], []

        def close(to=0):
            while len(lists) > to:
                out.append(f"</li></{lists.pop()}>")

        for x in node.children if depth < 64 else ():
            if x.tag == "p":
                p = x.child("pPr") or X("p")
                style = p.child("pStyle").attrs.get("val", "") if p.child("pStyle") else ""
                num = p.child("numPr")
                n = num.child("numId").attrs.get("val") if num is not None and num.child("numId") else None
                text = runs(x)
                if n and n != "0" and n in kinds:
                    level = int(num.child("ilvl").attrs.get("val", "0")) if num.child("ilvl") else 0
                    tag = "ul" if kinds[n].get(str(level)) in ("bullet", "") else "ol"
                    if len(lists) > level + 1:
                        close(level + 1)
                    elif len(lists) == level + 1:
                        out.append("</li>")
                    while len(lists) < level + 1:
                        lists.append(tag)
                        out.append(f"<{tag}>" if len(lists) == level + 1 else f"<{tag}><li>")
                    out.append(f"<li>{text}")
                    continue
                close()
                h = heading(style)
                out.append(f"<h{h}>{text}</h{h}>" if h else f"<p>{text}</p>")
            elif x.tag == "tbl":
                close()
                out.append("<table>")
                for tr in (c for c in x.children if c.tag == "tr"):
                    out.append("<tr>")
                    for tc in (c for c in tr.children if c.tag == "tc"):
                        pr = tc.child("tcPr")
                        span = pr.child("gridSpan").attrs.get("val", "1") if pr is not None and pr.child("gridSpan") else "1"
                        out.append(f'<td colspan="{span}">' if span.isdigit() and int(span) > 1 else "<td>")
                        out.append(body(tc, depth + 1) + "</td>")
                    out.append("</tr>")
                out.append("</table>")
            elif x.tag in ("sdt", "sdtContent"):
                close()
                out.append(body(x, depth + 1))
        close()
        return "".join(out)

    doc = f.tree("word/document.xml").first("body") or X("body")
    book.parts = [Part("body", "application/xhtml+xml", _page(book.metadata.get("title", ""), body(doc)), spine=0)]
    return book


def _pptx(f: Files) -> Book:
    book = Book("pptx", metadata=_core(f))
    rels = _rels(f, "ppt/presentation.xml")
    for n, s in enumerate(f.tree("ppt/presentation.xml").find_all("sldId")):
        path = rels.get(s.attrs.get("id", "") if s.attrs.get("id", "") in rels else s.attrs.get("r:id", ""), ("", True))[0]
        if path not in f:
            book.errors.append(f"slide {n}: no part")
            continue
        out, links = [], _rels(f, path)
        slide = f.tree(path)
        for sp in slide.find_all("sp"):
            ph = sp.find("ph")
            title = ph is not None and ph.attrs.get("type") in ("title", "ctrTitle")
            for p in sp.find_all("p"):
                text = ""
                for r in p.children:
                    if r.tag == "br":
                        text += "<br/>"
                    if r.tag not in ("r", "fld"):
                        continue
                    part = html.escape("".join(t.all_text() for t in r.children if t.tag == "t"), quote=False)
                    click = r.find("hlinkClick")
                    target = links.get(click.attrs.get("id", ""), ("", True))[0] if click is not None else ""
                    text += f'<a href="{html.escape(target)}">{part}</a>' if target else part
                if text:
                    out.append(f"<h1>{text}</h1>" if title else f"<p>{text}</p>")
        for t in slide.find_all("tbl"):
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{html.escape(' '.join(x.all_text() for x in tc.find_all('t')))}</td>" for tc in tr.children if tc.tag == "tc") + "</tr>" for tr in t.find_all("tr")) + "</table>")
        book.parts.append(Part(path, "application/xhtml+xml", _page(f"Slide {n + 1}", "".join(out)), spine=n))
    return book


def _xlsx(f: Files) -> Book:
    book = Book("xlsx", metadata=_core(f))
    book.cells, sheets = spreadsheet.read(f.tree, _rels(f, "xl/workbook.xml"))
    for n, (name, path) in enumerate(sheets):
        book.parts.append(Part(path, "application/xhtml+xml", _page(name, spreadsheet.to_html(name, [c for c in book.cells if c.sheet == name])), spine=n))
    return book


# -- FB2 and MOBI -----------------------------------------------------------------------------

_FB2 = {"p": "p", "v": "p", "subtitle": "h3", "text-author": "p", "emphasis": "i", "strong": "b", "strikethrough": "s", "code": "code", "sub": "sub", "sup": "sup", "table": "table", "tr": "tr", "td": "td", "th": "th", "cite": "blockquote", "epigraph": "blockquote", "poem": "div", "stanza": "div"}


def _fb2(b: bytes) -> Book:
    doc = tree(b, mixed=True)
    info = doc.first("title-info") or X("t")
    name = lambda a: " ".join(t for k in ("first-name", "middle-name", "last-name") for x in a.children if x.tag == k and (t := x.all_text().strip()))
    text = lambda tag: (x.all_text().strip() if (x := info.first(tag)) else "")
    book = Book("fb2", metadata={"title": text("book-title"), "author": ", ".join(n for a in info.children if a.tag == "author" and (n := name(a))), "language": text("lang"), "description": " ".join(text("annotation").split())})

    def out(x: X, depth: int) -> str:
        if x.tag == "#text":
            return html.escape(x.text, quote=False)
        inner = "".join(out(c, depth + (x.tag == "section")) for c in x.children)
        if x.tag == "title":
            return f"<h{min(6, max(1, depth))}>{' '.join(re.sub('<[^>]*>', ' ', inner).split())}</h{min(6, max(1, depth))}>"
        if x.tag == "empty-line":
            return "<br/>"
        if x.tag == "a":
            return f'<a href="{html.escape(x.attrs.get("href", ""))}">{inner}</a>'
        tag = _FB2.get(x.tag)
        return f"<{tag}>{inner}</{tag}>" if tag else inner

    for n, body in enumerate(x for x in doc.children if x.tag == "body"):
        book.parts.append(Part("index.xhtml" if not n else f"body{n}.xhtml", "application/xhtml+xml", _page(book.metadata["title"], out(body, 1)), spine=n))
    return book


_LITERALS = re.compile(rb"[\x00\x09-\x7f]+")


def _palmdoc(b: bytes) -> bytes:
    out, i, most = bytearray(), 0, len(b)
    while i < most:
        c = b[i]
        i += 1
        if c >= 0xC0:
            out.append(32)
            out.append(c ^ 0x80)
        elif c >= 0x80:
            if i < most:
                pair = c << 8 | b[i]
                i += 1
                size, start = (pair & 7) + 3, len(out) - (pair >> 3 & 0x7FF)
                if 0 <= start < len(out):
                    again = out[start : start + size]
                    out += again if len(again) == size else (again * (size // len(again) + 1))[:size]
        elif 1 <= c <= 8:
            out += b[i : i + c]
            i += c
        else:
            end = _LITERALS.match(b, i - 1).end()
            out += b[i - 1 : end]
            i = end
    return bytes(out)


def _mobi(b: bytes) -> Book:
    u16, u32 = (lambda at: int.from_bytes(b[at : at + 2], "big")), (lambda at: int.from_bytes(b[at : at + 4], "big"))
    at = [u32(78 + 8 * k) for k in range(u16(76))] + [len(b)]
    rec = lambda k: b[at[k] : at[k + 1]]
    head = rec(0)
    scheme, size, count = int.from_bytes(head[:2], "big"), int.from_bytes(head[4:8], "big"), int.from_bytes(head[8:10], "big")
    if int.from_bytes(head[12:14], "big"):
        return Book("mobi", errors=["encrypted"])
    unpack = {1: lambda r: r, 2: _palmdoc}.get(scheme)
    if scheme == 17480:
        first, n = int.from_bytes(head[112:116], "big"), int.from_bytes(head[116:120], "big")
        unpack = Huff(rec(first), [rec(first + k) for k in range(1, n)]).unpack
    if unpack is None:
        return Book("mobi", errors=[f"compression {scheme} is not supported"])
    encoding, extra = "utf-8", 0
    book = Book("mobi")
    if head[16:20] == b"MOBI":
        encoding = "cp1252" if int.from_bytes(head[28:32], "big") == 1252 else "utf-8"
        length = int.from_bytes(head[20:24], "big")
        extra = int.from_bytes(head[242:244], "big") if length >= 228 else 0
        name = int.from_bytes(head[84:88], "big")
        book.metadata["title"] = head[name : name + int.from_bytes(head[88:92], "big")].decode(encoding, "replace")
        exth = 16 + length
        if head[exth : exth + 4] == b"EXTH":
            p = exth + 12
            for _ in range(int.from_bytes(head[exth + 8 : exth + 12], "big")):
                kind, n = int.from_bytes(head[p : p + 4], "big"), int.from_bytes(head[p + 4 : p + 8], "big")
                key = {100: "author", 101: "publisher", 103: "description", 105: "subjects", 106: "created", 503: "title", 524: "language"}.get(kind)
                value = head[p + 8 : p + n].decode(encoding, "replace")
                if key:
                    book.metadata[key] = f"{book.metadata[key]}, {value}" if key in ("author", "subjects") and book.metadata.get(key) else value
                p += max(8, n)
    text = bytearray()
    for k in range(1, min(count, len(at) - 2) + 1):
        r = rec(k)
        for bit in range(15, 0, -1):  # trailing entries, each with its size at the end
            if extra >> bit & 1 and r:
                n = shift = 0
                for c in reversed(r[-4:]):
                    n |= (c & 0x7F) << shift
                    shift += 7
                    if c & 0x80:
                        break
                r = r[: len(r) - n] if n <= len(r) else b""
        if extra & 1 and r:
            r = r[: -((r[-1] & 3) + 1)]
        text += unpack(r)
    markup = bytes(text[:size]).decode(encoding, "replace")
    kind = "text/html" if "<" in markup else "text/plain"
    book.parts = [Part("index.html" if kind == "text/html" else "index.txt", kind, markup.encode(), spine=0)]
    return book
