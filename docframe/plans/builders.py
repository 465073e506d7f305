"""Documents made from table rows, so that the readers can be run over whole tables.

Each builder turns lines of text and a few fields into the bytes of one file
format, always the same bytes for the same row. They write what writers of the
format write (compression, indirections, encodings picked by the row), not what
the readers find easiest.
"""

from __future__ import annotations

import html
import io
import re
import struct
import zipfile
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.sources.documents import Made

_SPACE = re.compile(r"[ \t\r\f\v]+")
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_DC = "http://purl.org/dc/elements/1.1/"


def lines_of(text: str | None) -> list[str]:
    return [t for x in (text or "").split("\n") if (t := _SPACE.sub(" ", x).strip(" "))]


def esc(s: str) -> str:
    return html.escape(s, quote=True)


def archive(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED if name != "mimetype" else zipfile.ZIP_STORED)
    return out.getvalue()


def halves(lines: list[str]) -> tuple[list[str], list[str]]:
    return lines[: (len(lines) + 1) // 2], lines[(len(lines) + 1) // 2 :]


def epub(key: int, text: str, lang: str, source: str) -> bytes:
    """Two chapters under the second of two folders, a third part that is not in the spine, the contents as nav or NCX."""
    head = '<head><link rel="stylesheet" href="css/main.css"/></head>'
    body = lambda part: f"<html>{head}<body>" + "".join(f"<p>{esc(x)}</p>" for x in part) + "</body></html>"
    first, second = halves(lines_of(text))
    toc = {"OPS/nav.xhtml": '<html><body><nav epub:type="toc"><ol><li><a href="c%20one.xhtml#top">Part 1</a><ol><li><a href="c2.xhtml">Part 2</a></li></ol></li></ol></nav></body></html>'}
    item = '<item id="toc" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
    if key % 2:
        toc = {"OPS/toc.ncx": '<ncx><navMap><navPoint><navLabel><text>Part 1</text></navLabel><content src="c%20one.xhtml#top"/><navPoint><navLabel><text>Part 2</text></navLabel><content src="c2.xhtml"/></navPoint></navPoint></navMap></ncx>'}
        item = '<item id="toc" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
    package = f"""<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="{_DC}" unique-identifier="uid"><metadata><dc:title>Document {key}</dc:title><dc:creator>{esc(source)}</dc:creator>
      <dc:creator>Second Author</dc:creator><dc:identifier>other</dc:identifier><dc:identifier id="uid">urn:doc:{key}</dc:identifier><dc:language>{esc(lang)}</dc:language></metadata>
      <manifest>{item}<item id="two" href="c2.xhtml" media-type="application/xhtml+xml"/><item id="one" href="c%20one.xhtml" media-type="application/xhtml+xml"/>
      <item id="aside" href="aside.xhtml" media-type="application/xhtml+xml"/><item id="main" href="css/main.css" media-type="text/css"/><item id="base" href="css/base.css" media-type="text/css"/></manifest><spine{' toc="toc"' if key % 2 else ""}><itemref idref="one"/><itemref idref="two"/></spine></package>"""
    return archive({
        "mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/package.opf"/></rootfiles></container>',
        "OPS/package.opf": package, "OPS/c one.xhtml": body(first), "OPS/c2.xhtml": body(second), "OPS/aside.xhtml": body(["aside"]), "OPS/css/main.css": '@import "base.css"; @import url(print.css) print; body { font-size: 20px } p { text-indent: 2em }',
        "OPS/css/base.css": f"p {{ color: #{key * 7919 % 16777216:06x}; text-indent: 9px; margin: 0 }}", **toc,
    })


def docx(key: int, text: str, lang: str, source: str) -> bytes:
    """The first line a heading by an inherited style, the others paragraphs in several runs; every third one a list item, the last one linked."""
    w = f'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="{_REL}"'
    run = lambda t, p="": f'<w:r>{p}<w:t xml:space="preserve">{esc(t)}</w:t></w:r>'
    lines, body = lines_of(text), []
    for k, x in enumerate(lines):
        mid = len(x) // 2
        runs = run(x[:mid], "<w:rPr><w:b/></w:rPr>" if k % 4 == 1 else "") + run(x[mid:])
        if k == len(lines) - 1 and k:
            runs = f'<w:hyperlink r:id="r1">{run(x)}</w:hyperlink>'
        style = '<w:pPr><w:pStyle w:val="Top"/></w:pPr>' if k == 0 else '<w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="4"/></w:numPr></w:pPr>' if k % 3 == 0 and k < len(lines) - 1 else ""
        body.append(f"<w:p>{style}{runs}</w:p>")
    return archive({
        "[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document {w}><w:body>{''.join(body)}</w:body></w:document>",
        "word/_rels/document.xml.rels": f'<Relationships xmlns="x"><Relationship Id="r1" Target="http://example.org/{key}" TargetMode="External"/></Relationships>',
        "word/styles.xml": f'<w:styles {w}><w:style w:styleId="Top"><w:name w:val="Own"/><w:basedOn w:val="H"/></w:style><w:style w:styleId="H"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {w}><w:abstractNum w:abstractNumId="2"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="4"><w:abstractNumId w:val="2"/></w:num></w:numbering>',
        "docProps/core.xml": f'<c xmlns:dc="{_DC}"><dc:title>Document {key}</dc:title><dc:creator>{esc(source)}</dc:creator></c>',
    })


def pptx(key: int, text: str, lang: str, source: str) -> bytes:
    """A slide for each half, its first line the title; the slides' files are in the other order."""
    slides, members = halves(lines_of(text)), {}
    for n, part in enumerate(slides):
        title = f'<sp><nvSpPr><nvPr><ph type="title"/></nvPr></nvSpPr><txBody><p><r><t>{esc(part[0])}</t></r></p></txBody></sp>' if part else ""
        rest = "".join(f"<p><r><t>{esc(x[: len(x) // 2])}</t></r><r><t>{esc(x[len(x) // 2 :])}</t></r></p>" for x in part[1:])
        members[f"ppt/slides/slide{2 - n}.xml"] = f"<sld><cSld><spTree>{title}<sp><txBody>{rest}</txBody></sp></spTree></cSld></sld>"
    return archive({
        "ppt/presentation.xml": f'<p xmlns:r="{_REL}"><sldIdLst><sldId r:id="r1"/><sldId r:id="r2"/></sldIdLst></p>',
        "ppt/_rels/presentation.xml.rels": '<R><Relationship Id="r1" Target="slides/slide2.xml"/><Relationship Id="r2" Target="slides/slide1.xml"/></R>', **members,
    })


def fb2(key: int, text: str, lang: str, source: str) -> bytes:
    """A section for each half with its first line as title; in UTF-8 or UTF-16."""
    sections = "".join(f"<section><title><p>{esc(part[0])}</p></title>{''.join(f'<p>{esc(x)}</p>' for x in part[1:])}</section>" for part in halves(lines_of(text)) if part)
    coding = "utf-16" if key % 2 else "utf-8"
    names = f"<author><first-name>{esc(source)}</first-name><last-name>Writer</last-name></author><author><last-name>Second</last-name></author>"
    return f'<?xml version="1.0" encoding="{coding}"?><FictionBook><description><title-info><book-title>Document {key}</book-title>{names}<lang>{esc(lang)}</lang></title-info></description><body>{sections}</body></FictionBook>'.encode(coding)


def _palm(b: bytes) -> bytes:
    """PalmDOC: literals, spaces folded into letters, and copies of what stood shortly before."""
    out, i = bytearray(), 0
    while i < len(b):
        size = 0
        if i >= 3 and i + 3 <= len(b):
            at = b.rfind(b[i : i + 3], max(0, i - 2047), i + 2)
            if 0 <= at < i:
                size = 3
                while size < 10 and i + size < len(b) and b[at + size] == b[i + size]:
                    size += 1
                out += struct.pack(">H", 0x8000 | (i - at) << 3 | size - 3)
                i += size
                continue
        c = b[i]
        if c == 32 and i + 1 < len(b) and 0x40 <= b[i + 1] < 0x80:
            out.append(b[i + 1] ^ 0x80)
            i += 2
        elif c == 0 or 9 <= c < 0x80:
            out.append(c)
            i += 1
        else:
            n = 1
            while n < 8 and i + n < len(b) and not (b[i + n] == 0 or 9 <= b[i + n] < 0x80):
                n += 1
            out.append(n)
            out += b[i : i + n]
            i += n
    return bytes(out)


def mobi(key: int, text: str, lang: str, source: str) -> bytes:
    """Records of 4,096 bytes, plain or PalmDOC-compressed, with a trailing entry on some; author and title in EXTH."""
    markup = ("<html><body>" + "".join(f"<p>{html.escape(x, quote=False)}</p>" for x in lines_of(text)) + "</body></html>").encode()
    scheme, extra = (2, 2) if key % 2 else (1, 0)
    pieces = [markup[i : i + 4096] for i in range(0, len(markup), 4096)]
    records = [(_palm(p) if scheme == 2 else p) + (b"x\x82" if extra else b"") for p in pieces]
    exth = [(100, source), (100, "Second Author"), (503, f"Document {key}"), (524, lang)]
    packed = b"".join(struct.pack(">LL", n, 8 + len(v.encode())) + v.encode() for n, v in exth)
    head = bytearray(16 + 232)
    head[0:2], head[4:8], head[8:12] = struct.pack(">H", scheme), struct.pack(">L", len(markup)), struct.pack(">HH", len(records), 4096)
    head[16:24], head[28:32], head[242:244] = b"MOBI" + struct.pack(">L", 232), struct.pack(">L", 65001), struct.pack(">H", extra)
    records = [bytes(head) + b"EXTH" + struct.pack(">LL", 12 + len(packed), len(exth)) + packed, *records, b"\xe9\x8e\r\n"]
    at = 78 + 8 * len(records) + 2
    out = b"name".ljust(32, b"\0") + b"\0" * 28 + b"BOOKMOBI" + b"\0" * 8 + struct.pack(">H", len(records))
    for r in records:
        out, at = out + struct.pack(">LL", at, 0), at + len(r)
    return out + b"\0\0" + b"".join(records)


def svg(key: int, text: str, lang: str, source: str) -> bytes:
    """A text element a line, some in a group or with spans, every fourth one a link; compressed or not."""
    body = []
    for k, x in enumerate(lines_of(text)):
        mid = x.find(" ") + 1
        t = f'<text x="10" y="{20 + 14 * k}">{esc(x[:mid])}<tspan>{esc(x[mid:])}</tspan></text>'
        body.append(f'<a href="http://example.org/{key}/{k}">{t}</a>' if k % 4 == 3 else f"<g>{t}</g>" if k % 2 else t)
    b = f'<?xml version="1.0"?><svg xmlns="http://www.w3.org/2000/svg"><title>Document {key}</title><desc>{esc(source)}</desc><defs><text>unseen</text></defs>{"".join(body)}</svg>'.encode()
    if key % 2:
        z = zlib.compressobj(9, zlib.DEFLATED, 31)
        return z.compress(b) + z.flush()
    return b


def _ascii85(b: bytes) -> bytes:
    import base64

    return base64.a85encode(b) + b"~>"


def _runs(b: bytes) -> bytes:
    return b"".join(bytes([len(b[i : i + 128]) - 1]) + b[i : i + 128] for i in range(0, len(b), 128)) + b"\x80"


def _up(b: bytes, columns: int = 16) -> bytes:
    """PNG rows with the predictor that takes the byte above."""
    b += b"\n" * (-len(b) % columns)
    rows = [bytes(columns), *(b[i : i + columns] for i in range(0, len(b), columns))]
    return b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True)) for above, row in zip(rows, rows[1:], strict=False))


def pdf(key: int, text: str, lang: str, source: str, per_page: int = 40) -> bytes:
    """Pages of lines in WinAnsi, the content's filters by the key; outline, labels, links, layers, boxes and dates."""
    quote = lambda s: s.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    lines = lines_of(text)
    pages = [lines[i : i + per_page] for i in range(0, len(lines), per_page)] or [[]]
    n, objects = len(pages), {}
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(n))
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R /Outlines 4 0 R /PageLabels << /Nums [0 << /S /r >> 1 << /P (p. ) /S /D /St 2 >>] >> /OCProperties << /OCGs [7 0 R 8 0 R] /D << /BaseState /ON /OFF [8 0 R] >> >> >>"
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 %d 792] /Resources << /Font << /F 3 0 R >> >> >>" % (kids, n, 500 + key % 200)
    objects[3] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding /FirstChar 32 /LastChar 255 /Widths [" + b"500 " * 224 + b"] >>"
    objects[4] = b"<< /First 5 0 R /Last 6 0 R >>"
    objects[5] = b"<< /Title (First page) /Dest [10 0 R /Fit] /Next 6 0 R >>"
    objects[6] = b"<< /Title <%s> /Dest [%d 0 R /Fit] >>" % (b"feff" + "Últimas páginas".encode("utf-16-be").hex().encode(), 8 + 2 * n)
    objects[7], objects[8] = b"<< /Type /OCG /Name (Shown) >>", b"<< /Type /OCG /Name (Hidden) >>"
    objects[9] = b"<< /Title (Document %d) /Author (%s) /CreationDate (D:2020%02d%02d030405+02'00') >>" % (key, quote(source), 1 + key % 12, 1 + key % 28)
    for k, part in enumerate(pages):
        body = b"BT /F 10 Tf 1 0 0 1 40 740 Tm 14 TL\n"
        for j, x in enumerate(part):
            words = x.split(" ")
            body += (b"[" + b"-500".join(b"(" + quote(w) + b")" for w in words) + b"] TJ T*\n") if j % 2 else b"(" + quote(x) + b") Tj T*\n"
        body += b"ET"
        kind = key % 5
        data, how = {
            0: lambda: (body, b""), 1: lambda: (zlib.compress(body), b"/Filter /FlateDecode"), 2: lambda: (_ascii85(zlib.compress(body)), b"/Filter [/ASCII85Decode /FlateDecode]"),
            3: lambda: (_runs(body), b"/Filter /RunLengthDecode"), 4: lambda: (zlib.compress(_up(body)), b"/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 16 >>"),
        }[kind]()
        notes = b"/Annots [<< /Subtype /Link /Rect [40 %d 140 %d] /A << /S /URI /URI (http://example.org/%d/%d) >> >> << /Subtype /Link /Rect [0 0 9 9] /Dest [10 0 R /Fit] >>]" % (700 - k, 714 - k, key, k)
        objects[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Rotate %d /CropBox [10 20 %d 780] %s >>" % (11 + 2 * k, 90 * ((key + k) % 4), 400 + key % 50, notes)
        objects[11 + 2 * k] = b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), how, data)
    out, at = bytearray(b"%PDF-1.7\n"), {}
    for i in sorted(objects):
        at[i] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (i, objects[i])
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % at[i] for i in sorted(objects))
    return bytes(out + b"trailer << /Root 1 0 R /Info 9 0 R /Size %d >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, start))


def xlsx(rows: list[dict]) -> bytes:
    """A sheet of an order's lines: shared and inline strings, numbers, currency, percentages, dates and booleans."""
    s = f'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{_REL}"'
    shared = sorted({r["flag"] for r in rows})
    body = []
    for n, r in enumerate(rows, start=1):
        cells = [
            f'<c r="A{n}" t="s"><v>{shared.index(r["flag"])}</v></c>', f'<c r="B{n}" t="inlineStr"><is><t>{esc(r["status"])}</t></is></c>', f'<c r="C{n}"><v>{r["quantity"]!r}</v></c>',
            f'<c r="D{n}" s="1"><v>{r["price"]!r}</v></c>', f'<c r="E{n}" s="2"><v>{r["discount"]!r}</v></c>', f'<c r="F{n}" s="3"><v>{r["day"]}</v></c>', f'<c r="H{n}" t="b"><v>{int(r["quantity"] > 25)}</v></c>',
        ]
        body.append(f'<row r="{n}">{"".join(cells)}</row>')
    return archive({
        "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="Lines" r:id="r7"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r7" Target="worksheets/one.xml"/></R>',
        "xl/sharedStrings.xml": f"<sst {s}>{''.join(f'<si><t>{esc(x)}</t></si>' for x in shared)}</sst>",
        "xl/styles.xml": f'<styleSheet {s}><numFmts><numFmt numFmtId="170" formatCode="$#,##0.00"/><numFmt numFmtId="171" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="9"/><xf numFmtId="171"/></cellXfs></styleSheet>',
        "xl/worksheets/one.xml": f"<worksheet {s}><sheetData>{''.join(body)}</sheetData></worksheet>",
    })


#: Rows and bytes at which a batch of files is handed on.
_ROWS, _BYTES = 64, 1 << 20


def _batches(files, key: str):
    """Record batches of (key, content) pairs: a few small files or one large."""
    import pyarrow as pa

    keys, data, size = [], [], 0
    for k, b in files:
        keys.append(k)
        data.append(b)
        size += len(b)
        if len(keys) >= _ROWS or size >= _BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], names=[key, "content"])
            keys, data, size = [], [], 0
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], names=[key, "content"])


def files(documents: DataFrame, builder) -> Made:
    """documents(doc_id, text, lang, source) as files for the readers, each made where it is read."""

    def of(key, text, lang, source):
        return builder(key, text, lang or "", source or "")

    return Made(documents.select("doc_id", F.col("doc_id").alias("_key"), "text", "lang", "source"), ("_key", "text", "lang", "source"), of)


def built(documents: DataFrame, builder) -> DataFrame:
    """documents(doc_id, text, lang, source) to (doc_id, content), a document at a time."""

    def run(batches):
        def files():
            for b in batches:
                for row in zip(*(b.column(c) for c in ("doc_id", "text", "lang", "source")), strict=True):
                    key, text, lang, source = (x.as_py() for x in row)
                    yield key, builder(key, text, lang or "", source or "")

        yield from _batches(files(), "doc_id")

    return documents.select("doc_id", "text", "lang", "source").mapInArrow(run, "doc_id bigint, content binary")


def workbooks(orders: DataFrame) -> DataFrame:
    """orders(key, lines: an array of structs) to (key, content)."""

    def run(batches):
        yield from _batches(((k, xlsx(lines.as_py())) for b in batches for k, lines in zip(b.column("key").to_pylist(), b.column("lines"), strict=True)), "key")

    return orders.select("key", "lines").mapInArrow(run, "key bigint, content binary")
