import hashlib
import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from docframe.functions import numbers, sniff, text, urls
from docframe.operators import dom, markdown
from docframe.plans import catalogue
from docframe.sources import containers, crypt, documents, huff, pdf, spreadsheet, stext, svg
from docframe.streaming import ingest

from tests.oracle import compare


def archive(**members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/"), data)
    return b.getvalue()


def zipped(members):
    return archive(**{k.replace("/", "__"): v for k, v in members.items()})


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
EPUB = zipped({
    "mimetype": "application/epub+zip",
    "META-INF/container.xml": '<container xmlns="urn:x"><rootfiles><rootfile full-path="EPUB/package.opf"/></rootfiles></container>',
    "EPUB/package.opf": """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" unique-identifier="id"><metadata><dc:title>The Title</dc:title>
      <dc:creator>A One</dc:creator><dc:creator>B Two</dc:creator><dc:identifier>other</dc:identifier><dc:identifier id="id">urn:1</dc:identifier><dc:language>en</dc:language></metadata>
      <manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="a" href="text/a.xhtml" media-type="application/xhtml+xml"/>
      <item id="b" href="text/b.xhtml" media-type="application/xhtml+xml"/><item id="gone" href="gone.xhtml" media-type="application/xhtml+xml"/></manifest>
      <spine><itemref idref="b"/><itemref idref="a" linear="no"/><itemref idref="b"/></spine></package>""",
    "EPUB/nav.xhtml": '<html><body><nav epub:type="toc"><ol><li><a href="text/b.xhtml#x">One</a><ol><li><a href="text/a.xhtml">Deeper</a></li></ol></li><li><span>Two</span></li></ol></nav></body></html>',
    "EPUB/text/a.xhtml": "<html><body><h1>Alpha</h1><p>first</p></body></html>",
    "EPUB/text/b.xhtml": "<html><body><p>second <b>bold</b></p></body></html>",
})
DOCX = zipped({
    "word/document.xml": f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>
      <w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:rPr><w:i w:val="false"/></w:rPr><w:t xml:space="preserve"> plain </w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:footnoteReference w:id="2"/></w:r></w:p>
      <w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="5"/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="5"/></w:numPr></w:pPr><w:r><w:t>sub</w:t></w:r></w:p>
      <w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>""",
    "word/_rels/document.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="http://x.y/" TargetMode="External"/></Relationships>',
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H"><w:name w:val="My"/><w:basedOn w:val="H2"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>',
    "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="1"/></w:num></w:numbering>',
    "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="0" w:type="separator"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>',
    "docProps/core.xml": '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Doc</dc:title><dc:creator>Me</dc:creator></c>',
})
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX = zipped({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>sh</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>",
    "xl/styles.xml": f'<styleSheet {S}><numFmts><numFmt numFmtId="164" formatCode="$#,##0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="9"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": f"""<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>
      <row r="2"><c r="A2" s="1"><v>45000</v></c><c r="B2" s="2"><v>1234.5</v></c><c r="C2" s="3"><v>0.125</v></c><c r="D2" t="b"><v>1</v></c></row><row r="4"><c r="A4"><v>7</v></c><c r="B4"><v>8</v></c></row></sheetData>
      <mergeCells><mergeCell ref="A4:C4"/></mergeCells></worksheet>""",
})
PPTX = zipped({
    "ppt/presentation.xml": '<p xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sldIdLst><sldId id="256" r:id="r1"/></sldIdLst></p>'.replace('id="256" ', ""),
    "ppt/_rels/presentation.xml.rels": '<R><Relationship Id="r1" Target="slides/slide1.xml"/></R>',
    "ppt/slides/slide1.xml": '<sld><sp><nvPr><ph type="title"/></nvPr><txBody><p><r><t>Slide title</t></r></p></txBody></sp><sp><txBody><p><r><t>body</t></r></p></txBody></sp></sld>',
})
FB2 = """<?xml version="1.0" encoding="windows-1251"?><FictionBook><description><title-info><book-title>Книга</book-title><author><first-name>Имя</first-name><last-name>Фам</last-name></author></title-info></description>
<body><section><title><p>Глава</p></title><p>текст <emphasis>курсив</emphasis></p></section></body></FictionBook>""".encode("cp1251")


def build_pdf(objects, extra=b""):
    out = b"%PDF-1.7\n"
    for n, o in enumerate(objects, 1):
        out += b"%d 0 obj\n" % n + (o if isinstance(o, bytes) else o.encode()) + b"\nendobj\n"
    return out + b"trailer << /Root 1 0 R /Info 8 0 R %s>>\n" % extra


CONTENT = zlib.compress(b"BT /F 10 Tf 20 100 Td (Hel) Tj (lo) Tj 28 0 Td (wor\\154d) Tj 0 -12 TD [(s)-20(econd)-600( x)] TJ (third) ' ET BT /F 10 Tf 20 20 Td (far) Tj ET")
PDF = build_pdf([
    "<< /Type /Catalog /Pages 2 0 R /Outlines 6 0 R /PageLabels << /Nums [0 << /S /r >> 1 << /P (App ) /S /A >>] >> >>",
    "<< /Type /Pages /Kids [3 0 R 9 0 R] /Count 2 /MediaBox [0 0 200 200] /Resources << /Font << /F 5 0 R >> >> >>",
    "<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Annots [<< /Subtype /Link /Rect [20 25 60 50] /A << /S /URI /URI (http://x.y) >> >> << /Subtype /Link /Rect [0 0 1 1] /Dest [9 0 R /Fit] >>] >>",
    b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(CONTENT) + CONTENT + b"\nendstream",
    "<< /Type /Font /Subtype /Type1 /FirstChar 32 /Widths [" + "500 " * 100 + "] >>",
    "<< /First 7 0 R >>",
    "<< /Title <FEFF0041> /Dest [9 0 R /Fit] /Next 7 0 R >>",
    "<< /Title (A \\(b\\)) /Author (Me) /CreationDate (D:20200102030405+02'00') >>",
    "<< /Type /Page /Parent 2 0 R >>",
])


def test_epub():
    b = containers.open_book(EPUB)
    assert b.kind == "epub" and b.metadata["title"] == "The Title" and b.metadata["author"] == "A One, B Two" and b.metadata["identifier"] == "urn:1"
    assert [(p.item_id, p.linear) for p in b.spine()] == [("b", True), ("a", False)] and len(b.errors) == 1
    assert b.outline == [(1, "One", "EPUB/text/b.xhtml", "x"), (2, "Deeper", "EPUB/text/a.xhtml", ""), (1, "Two", "", "")]
    assert containers.text_of(b) == "second bold\nAlpha\nfirst"


def test_docx():
    b = containers.open_book(DOCX)
    markup = containers.as_markup(b.spine()[0])
    assert b.metadata["title"] == "Doc" and "<h2>Head</h2>" in markup and "<b>bold</b> plain " in markup and '<a href="http://x.y/">link</a><small>note</small>' in markup
    assert "<ol><li>item<ul><li>sub</li></ul></li></ol>" in markup and '<td colspan="2"><p>wide</p></td>' in markup


def test_xlsx():
    b = containers.open_book(XLSX)
    assert [(c.row, c.col, c.text) for c in b.cells] == [(1, 1, "sh"), (1, 3, "rich"), (2, 1, "03-15-23"), (2, 2, "$1,234.50"), (2, 3, "13%"), (2, 4, "TRUE"), (4, 1, "7")]
    assert b.cells[-1].colspan == 3 and "<td>sh</td><td></td><td>rich</td>" in containers.as_markup(b.spine()[0])


@pytest.mark.parametrize(
    ("n", "code", "want"),
    [(45000, "yyyy-mm-dd", "2023-03-15"), (0.5, "h:mm AM/PM", "12:00 PM"), (45000.75, "hh:mm:ss", "18:00:00"), (-1234.567, "#,##0.0", "-1,234.6"), (0.125, "0%", "13%"), (12, "0.00E+00", "12.00"), (1234567.5, "", "1.2345675e+06"), (3.0, "General", "3"), (5, '"x"0', "x5"), (2.5, "0;[Red]-0", "3")],
)
def test_number_formats(n, code, want):
    assert spreadsheet.number(n, code) == want


def test_pptx_and_fb2():
    assert containers.text_of(containers.open_book(PPTX)) == "Slide title\nbody"
    b = containers.open_book(FB2)
    assert b.metadata == {"title": "Книга", "author": "Имя Фам", "language": "", "description": ""} and containers.text_of(b) == "Глава\nтекст курсив" and b.toc() == [(2, "Глава", "index.xhtml", "")]


def test_mobi():
    text = b"<html><body><p>Hello hello hello</p></body></html>"
    head = (2).to_bytes(2, "big") + b"\0\0" + len(text).to_bytes(4, "big") + (1).to_bytes(2, "big") + (4096).to_bytes(2, "big") + b"\0" * 4
    packed = b"".join(bytes([c]) if c >= 9 or c == 0 else bytes([1, c]) for c in text)
    at, records = 78 + 16 + 2, [head, packed]
    out = b"name".ljust(32, b"\0") + b"\0" * 28 + b"BOOKMOBI" + b"\0" * 8 + (2).to_bytes(2, "big")
    for r in records:
        out += at.to_bytes(4, "big") + b"\0" * 4
        at += len(r)
    assert containers.text_of(containers.open_book(out + b"\0\0" + b"".join(records))) == "Hello hello hello"
    assert containers._palmdoc(b"ab\x80\x10\xe1") == b"abababa"[:2] + containers._palmdoc(b"ab\x80\x10")[2:] + b" a"


def huff_tables(phrases):
    """Eight-bit codes for all: code 255 - k is phrase k; a phrase given as codes is compressed itself."""
    huff = b"HUFF" + struct.pack(">LLL", 24, 24, 24 + 1024) + bytes(8) + struct.pack(">256L", *[255 << 8 | 0x80 | 8] * 256) + struct.pack(">64L", *[0] * 64)
    body, offsets = b"", []
    for p in phrases:
        offsets.append(2 * len(phrases) + len(body))
        body += struct.pack(">H", len(p) | 0x8000) + p if isinstance(p, bytes) else struct.pack(">H", len(p)) + bytes(255 - k for k in p)
    return huff, b"CDIC" + struct.pack(">LLL", 16, len(phrases), 8) + b"".join(struct.pack(">H", o) for o in offsets) + body


def test_phrase_compression():
    tables = huff_tables([b"hello", b" world", [0, 1], [3]])
    assert huff.Huff(tables[0], [tables[1]]).unpack(bytes([255, 253, 252, 254])) == b"hellohello world world"
    text = bytes([255, 253, 254])
    head = bytearray(300)
    head[0:2], head[4:8], head[8:10] = (17480).to_bytes(2, "big"), (100).to_bytes(4, "big"), (1).to_bytes(2, "big")
    head[16:24], head[28:32], head[112:120] = b"MOBI" + (200).to_bytes(4, "big"), (65001).to_bytes(4, "big"), struct.pack(">LL", 2, 2)
    records, at = [bytes(head), text, *tables], 78 + 8 * 4 + 2
    out = b"name".ljust(32, b"\0") + b"\0" * 28 + b"BOOKMOBI" + b"\0" * 8 + (4).to_bytes(2, "big")
    for r in records:
        out, at = out + at.to_bytes(4, "big") + b"\0" * 4, at + len(r)
    assert containers.text_of(containers.open_book(out + b"\0\0" + b"".join(records))) == "hellohello world world"


def test_damaged_documents_are_errors_not_failures():
    assert containers.open_book(b"PK\x03\x04 nonsense").errors and containers.open_book(b"\0\1\2").errors == ["unsupported"] and containers.open_book(b"").errors
    assert documents._book(b"%PDF-1.4 nothing").spine() == [] and documents._book(EPUB[:200]).errors


def test_pdf():
    b = pdf.open_pdf(PDF)
    assert b.metadata["title"] == "A (b)" and b.metadata["author"] == "Me" and b.metadata["created"] == "2020-01-02T03:04:05+02:00"
    assert b.spine()[0].data.decode() == "Hello world\nsecond x\nthird\n\nfar" and [p.item_id for p in b.spine()] == ["i", "App A"]
    assert b.outline == [(1, "A", "page1", "")]
    f = pdf.File(PDF)
    assert pdf.links(f, f.pages()[0], {3: 0, 9: 1}) == [([20.0, 25.0, 60.0, 50.0], "http://x.y", None), ([0.0, 0.0, 1.0, 1.0], "", 1)]


def test_pdf_filters_and_strings():
    assert pdf.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert pdf.run_length(b"\x02abc\xfez\x80") == b"abczzz" and pdf.ascii85(b"87cURD]~>") == b"Hello"
    assert pdf.predict(b"\x01\x01\x01\x01\x02\x01\x01\x01", {"Predictor": 12, "Columns": 3}) == b"\x01\x02\x03\x02\x03\x04"
    assert pdf.Lexer(b"(a\\(b\\)(c)\\\n\\101) <48 6> /A#20b [1 -.5 true null 3 0 R]").value() == b"a(b)(c)A"
    m, w = pdf.cmap(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0001> <0003> <0041> endbfrange 1 beginbfchar <0009> <00660069> endbfchar")
    assert m == {1: "A", 2: "B", 3: "C", 9: "fi"} and w == {2}


def test_ciphers():
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    key, plain = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert bytes(crypt._encrypt_block(plain, crypt._schedule(key))).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    key = bytes(range(32))
    assert bytes(crypt._encrypt_block(plain, crypt._schedule(key))).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert crypt.aes_cbc(key, crypt.aes_cbc_encrypt(key, b"hello".ljust(16, b"\x0b"), bytes(16)), bytes(16)) == b"hello"


@pytest.mark.parametrize("password", ["user", "owner"])
def test_encrypted_pdf_opens_with_either_password(password):
    """A file of revision 3, encrypted here by the published steps."""
    pad = lambda p: (p + crypt.PADDING)[:32]
    h = hashlib.md5(pad(b"owner")).digest()
    for _ in range(50):
        h = hashlib.md5(h).digest()
    o = pad(b"user")
    for k in range(20):
        o = crypt.rc4(bytes(c ^ k for c in h), o)
    d = {"V": 2, "R": 3, "Length": 128, "P": -4, "O": o, "U": b""}
    s = crypt.Security.__new__(crypt.Security)
    s.v, s.r, s.length, s.meta, s.method = 2, 3, 16, True, "rc4"
    s.key = s._from_user(d, b"id", b"user")
    u = crypt.rc4(s.key, hashlib.md5(crypt.PADDING + b"id").digest())
    for k in range(1, 20):
        u = crypt.rc4(bytes(c ^ k for c in s.key), u)
    content, title = s.decrypt(4, 0, b"BT /F 10 Tf (secret) Tj ET"), s.decrypt(8, 0, b"T")
    file = build_pdf([
        "<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] >>", "<< /Type /Page /Contents 4 0 R /Resources << /Font << /F 5 0 R >> >> >>",
        b"<< /Length %d >>\nstream\n" % len(content) + content + b"\nendstream", "<< /Type /Font >>", "<< >>", b"<< /Filter /Standard /V 2 /R 3 /Length 128 /P -4 /O <%s> /U <%s> >>" % (o.hex().encode(), u.ljust(32, b"\0").hex().encode()),
        b"<< /Title <%s> >>" % title.hex().encode(),
    ], b"/Encrypt 7 0 R /ID [(id) (id)] ")
    assert pdf.open_pdf(file).errors == ["encrypted"]
    b = pdf.open_pdf(file, password)
    assert b.spine()[0].data == b"secret" and b.metadata["title"] == "T"


def test_encrypted_pdf_is_reported():
    assert pdf.open_pdf(build_pdf(["<< /Type /Catalog >>"], b"/Encrypt 3 0 R ")).errors == ["encrypted"]


@pytest.mark.parametrize(
    ("chars", "want"),
    [([("a", 0), ("b", 5), ("c", 12), ("d", 17)], "ab cd"), ([("a", 0), ("b", 30)], "a\n\nb"), ([("a", 0), ("a", 1), ("b", 5)], "ab"), ([("a", 0), (" ", 5), ("b", 12)], "a b")],
)
def test_characters_to_words(chars, want):
    assert stext.text([stext.Char(c, x, 0.0, 1.0, 0.0, 10.0, 5.0) for c, x in chars]) == want


def test_svg():
    b = b'<?xml version="1.0"?><svg xmlns="http://www.w3.org/2000/svg"><title>T</title><defs><text>no</text></defs><g><text>a <tspan>b</tspan> c</text><a href="u"><text>l</text></a></g></svg>'
    assert svg.is_svg(b) and svg.open_svg(b).spine()[0].data == b"a b c\nl" and svg.open_svg(b).metadata["title"] == "T"
    assert not svg.is_svg(b"<html><svg/></html>")


@pytest.mark.parametrize(
    ("source", "want"),
    [("<p>a<p>b", "a\nb"), ("a<br>b", "a\nb"), (" a  b ", "a b"), ("<ruby>漢<rp>(</rp><rt>k</rt></ruby>", "漢k"), ("漢 字 a", "漢字 a"), ("<pre>a\n  b</pre>c", "a\n  b\nc"), ("<ul><li>x<li>y</ul>", "x\ny"), ("<table><tr><td>1<td>2</table>", "1\n2"), ("a&nbsp;b &lt;", "a\xa0b <"), ("<title>t</title>x<script>y</script>", "x"), ("<div></div>", "")],
)
def test_node_text(source, want):
    assert dom.node_text(dom.parse(source)) == want


@pytest.mark.parametrize(
    ("source", "want"),
    [("<h2>A</h2><p>b", "## A\n\nb"), ("<p># x", "\\# x"), ("<p>1. x", "1\\. x"), ("<ul><li>a<li>b</ul>", "- a\n- b"), ("<ol start=3><li>a</ol>", "3. a"), ("<a href='u v'>t</a>", "[t](<u v>)"), ("<b>x</b> a_b _c_", "**x** a_b \\_c\\_"), ("<pre>a`b</pre>", "```\na`b\n```"), ("<blockquote>q</blockquote>", "> q"), ("<table><tr><th>a<tr><td>b</table>", "| a |\n| --- |\n| b |"), ("<code>`</code>", "`` ` ``"), ("<hr>", "---"), ("a<br>b", "a  \nb"), ("<dl><dt>t<dd>d</dl>", "**t**\n\n  d")],
)
def test_markdown(source, want):
    assert markdown.to_markdown(source) == want


def test_kinds(spark):
    cases = [(b"", "unknown", "unknown"), (b"x %PDF-1.4", "pdf", "unknown"), (b"PK\x03\x04", "book", "zip"), (b"\0" * 60 + b"BOOKMOBI", "book", "mobi"), (b"ITSF", "book", "chm"), (b"<?xml?><!-- c --><svg>", "svg", "unknown"),
             (b"<html><svg>", "book", "html"), (b"word <svg>", "book", "text"), (b"\0\1", "unknown", "unknown"), ("é".encode() * 600, "book", "text"), (b"<FictionBook>", "book", "fb2"), (b"<!-- c -->", "book", "html"), (b"\xff\xfe\x01", "unknown", "unknown")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, content binary")
    got = df.select("i", sniff.kind_of(F.col("content")), sniff.container_kind(F.col("content"))).orderBy("i").collect()
    assert [(r[1], r[2]) for r in got] == [c[1:] for c in cases]


def test_columns(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    s = F.lit
    assert [one(urls.resolve(s(b), s(r))) for b, r in (("a/b.html", "c.html"), ("a/b.html", "../c#x"), ("a", "/x/./y?q"), ("a/b", "#f"), ("a/b", "http://x/y"), ("a/b", "../../z"))] == ["a/c.html", "c", "x/y", "a/b", "http://x/y", "../z"]
    assert [one(urls.is_external(s(x))) for x in ("http://a", "://a", "mailto:x", "a/b")] == [True, False, True, False]
    assert [one(numbers.roman(s(n))) for n in (4, 1999, 4000)] == ["iv", "mcmxcix", "4000"] and [one(numbers.letters_repeat(s(n))) for n in (1, 27, 53)] == ["A", "AA", "AAA"]
    assert [one(numbers.letters_bijective(s(n))) for n in (1, 26, 27, 703)] == ["a", "z", "aa", "aaa"] and one(numbers.cell_col(s("AB12"))) == 28
    assert one(text.md_escape(s("a_b _c_ [x]"))) == "a_b \\_c\\_ \\[x\\]"


def test_relations_of_files(spark, tmp_path):
    for name, data in {"a.epub": EPUB, "b.docx": DOCX, "c.xlsx": XLSX, "d.pdf": PDF, "e.txt": b"plain text", "f.bin": b"\0\1"}.items():
        (tmp_path / name).write_bytes(data)
    found = documents.files(spark, str(tmp_path))
    kinds = {r.path.rsplit("/")[-1]: (r.kind, r.container) for r in found.collect()}
    assert kinds["a.epub"] == ("book", "zip") and kinds["d.pdf"][0] == "pdf" and kinds["f.bin"] == ("unknown", "unknown")
    got = {r.path.rsplit("/")[-1]: r for r in documents.metadata(found).collect()}
    assert got["a.epub"].title == "The Title" and got["b.docx"].container == "docx" and got["d.pdf"].n_parts == 2 and got["f.bin"].errors == ["unsupported"]
    assert {r.path.rsplit("/")[-1]: r.text for r in documents.text(found).collect()}["e.txt"] == "plain text"
    assert documents.cells(found).count() == 7 and documents.parts(found).where("spine = 0").count() == 5 and documents.outline(found).count() == 6
    assert "## Head" in {r.path.rsplit("/")[-1]: r.markdown for r in documents.markdown(found).collect()}["b.docx"]
    assert "length" in documents.files(spark, str(tmp_path), most_bytes=100)._jdf.queryExecution().toString().split("PushedFilters")[1]


def test_streams_equal_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.html").write_text(f"<p>page {k}")
    q = documents.text(ingest.file_stream(spark, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName("texts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.text for r in spark.table("texts").collect()) == ["page 0", "page 1", "page 2"]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(300)
    events.repartition(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = ingest.sessions(stream, "ts", ["user_id"], "1 hour", "1 day").writeStream.format("memory").queryName("runs").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("runs").collect())) == sorted(map(tuple, ingest.sessions(spark.read.parquet(str(tmp_path / "ev")), "ts", ["user_id"], "1 hour").collect()))


def test_rows_that_native_expressions_misread_go_to_the_kernel(spark):
    cases = ["<p>a<p>b &amp; c", "<pre>a\n  b</pre>c", "漢 字 a", "<p>caf&eacute; x", "<p>&#65;", "<ruby>漢<rp>(</rp><rt>k</rt></ruby>", "<p>x&nbsp;y", "plain <b>text", ""]
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, html string")
    got = {r.page_id: r.text for r in dom.text_by_either(df).collect()}
    assert got == {i: dom.node_text(dom.parse(c)) for i, c in enumerate(cases)}


def test_references_without_a_semicolon_count_as_asked_for(spark):
    page = "<html><head><title>a&amp</title></head><body><h1>b &amp &quot</h1><p>c &copy 1 &copy; &quot; &unknown; &#65 &#65; &ampx"
    assert dom.node_text(dom.parse(page)) == 'b & "\nc © 1 © " &unknown; A A &x'
    assert dom.node_text(dom.parse(page, ("amp",))) == 'b & &quot\nc &copy 1 © " &unknown; &#65 A &x'
    rows = spark.createDataFrame([(1, page.encode())], "k long, content binary")
    assert documents.metadata(rows, "k").first().title == "a&" and documents.metadata(rows, "k", unended=()).first().title == "a&amp"
    assert documents.outline(rows, "k", unended=("amp",)).first().title == "b & &quot"
    assert documents.text(rows, "k").first().text == dom.node_text(dom.parse(page)) and documents.text(rows, "k", unended=("amp",)).first().text == dom.node_text(dom.parse(page, ("amp",)))
    html = spark.createDataFrame([(1, page)], "k long, html string")
    assert dom.text_by_either(html, "k", unended=("amp",)).first().text == dom.text_of(html, "k", unended=("amp",)).first().text == dom.node_text(dom.parse(page, ("amp",)))


@pytest.mark.parametrize("name", ["page_text", "page_text_kernel", "content_text", "content_outline", "content_metadata"])
def test_cut_references_are_read_as_the_sql_reads_them(spark, tmp_path, name):
    pages = ["<html><head><title>x&amp</title></head><body><h1>a &quot</h1><p>b &amp", "<html><head><title>y</title></head><body><h1>a &copy</h1><p>b &quot; &am"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit("http://a/")).write.parquet(str(tmp_path / "pages.parquet"))
    compare(spark, lambda s, _: catalogue.QUERIES[name](s, str(tmp_path)), catalogue.ORACLE_SQL[name].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'"))


@pytest.mark.parametrize("name", ["epub_text", "pptx_text", "docx_text", "fb2_text", "mobi_text", "svg_text", "script_of", "pdf_text", "pdf_lines", "pdf_blocks"])
def test_empty_texts_are_read_as_the_sql_reads_them(spark, tmp_path, name):
    rows = [(0, ""), (1, None), (2, " \n \n"), (3, "one"), (4, "a b\n\nc\nd"), (5, "\n")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")}).write.parquet(str(tmp_path / "documents.parquet"))
    compare(spark, lambda s, _: catalogue.QUERIES[name](s, str(tmp_path)), catalogue.ORACLE_SQL[name].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'"))


def test_a_title_far_into_a_page_is_found(spark):
    page = " " * 3000 + "<!DOCTYPE html><html><head><script>" + "x" * 70000 + "</script><title>Far</title></head><body>a"
    book = containers.open_book(page.encode())
    assert (book.kind, book.metadata["title"]) == ("html", "Far")


def test_masked_fonts_are_unmasked():
    font, key = bytes(range(256)) * 8, hashlib.sha1(b"urn:1").digest()
    masked = bytes(c ^ key[i % 20] if i < 1040 else c for i, c in enumerate(font))
    members = {i.filename: zipfile.ZipFile(io.BytesIO(EPUB)).read(i) for i in zipfile.ZipFile(io.BytesIO(EPUB)).infolist()}
    members["EPUB/package.opf"] = members["EPUB/package.opf"].replace(b"<item id=\"gone\"", b'<item id="f" href="f%20x.otf" media-type="font/otf"/><item id="gone"')
    members["EPUB/f x.otf"] = masked
    members["META-INF/encryption.xml"] = b'<encryption><EncryptedData><EncryptionMethod Algorithm="http://www.idpf.org/2008/embedding"/><CipherData><CipherReference URI="EPUB/f%20x.otf"/></CipherData></EncryptedData></encryption>'
    book = containers.open_book(zipped(members))
    assert next(p.data for p in book.parts if p.item_id == "f") == font
    assert containers.mask_key("http://ns.adobe.com/pdf/enc#RC", "x urn:uuid:00112233-4455-6677-8899-aabbccddeeff") == bytes.fromhex("00112233445566778899aabbccddeeff")


def test_layers_annotations_and_boxes():
    from docframe.sources import pdf_pages

    stream = "<< /Length 0 >>\nstream\n\nendstream"
    file = build_pdf([
        "<< /Type /Catalog /Pages 2 0 R /OCProperties << /OCGs [4 0 R 5 0 R] /D << /BaseState /OFF /ON [4 0 R] /AS [<< /Event /Print /OCGs [5 0 R] /Category [/Print] >>] >> >> >>",
        "<< /Type /Pages /Kids [3 0 R] >>",
        "<< /Type /Page /Rotate -90 /UserUnit 2 /MediaBox [100 200 0 0] /Annots [<< /Subtype /Widget /Rect [0 0 9 9] /AP << /N 6 0 R >> >> << /Subtype /Link >> << /Subtype /Text /F 2 /Rect [0 0 9 9] /AP << /N 6 0 R >> >> << /Subtype /Stamp /Rect [0 0 9 9] /OC 5 0 R /AP << /N << /On 6 0 R /Off 6 0 R >> >> /AS /On >>] >>",
        "<< /Type /OCG /Name (One) >>", "<< /Type /OCG /Name (Two) /Usage << /Print << /PrintState /ON >> >> >>", stream, "<< /Type /OCMD /OCGs [4 0 R 5 0 R] /P /AllOn >>",
    ])
    f = pdf.File(file)
    page = f.pages()[0]
    assert pdf_pages.Layers(f).rows() == [(0, "One", True), (1, "Two", False)] and pdf_pages.Layers(f, "print").rows()[1][2]
    assert pdf_pages.Layers(f).switch({"One": False, "Two": True}).rows() == [(0, "One", False), (1, "Two", True)]
    assert not pdf_pages.Layers(f).shows(pdf.Ref(7)) and pdf_pages.Layers(f, "print").shows(pdf.Ref(7)) and pdf_pages.Layers(f).shows(None)
    assert [(kind, drawn) for _, kind, _, drawn in pdf_pages.annotations(f, page, pdf_pages.Layers(f))] == [("Text", False), ("Stamp", False), ("Widget", True)]
    (_, _, media, seen, turned, unit, m), = pdf_pages.pages(f)
    assert (media, seen, turned, unit) == ([0, 0, 100, 200], [0, 0, 100, 200], 270, 2.0) and m == [0, -2, -2, 0, 400, 200]
    assert pdf_pages.fitted((0, 0, 10, 20), (1, 0, 0, 1, 5, 5), (100, 100, 120, 140)) == (2, 0, 0, 2, 90, 90)
