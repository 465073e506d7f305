"""Documents as relations: any BINARY column, or files, to metadata, parts, text, outline and cells.

`binaryFile` prunes `content` and pushes filters on length and time; each
function here reads `content` once and explodes in the same pass. Documents
are independent rows, so nothing is shuffled. Errors are a column, and never
fail a task.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe import batches
from docframe.functions.sniff import container_kind, kind_of

MOST_BYTES = 1 << 30
METADATA = ("title", "author", "language", "publisher", "description", "identifier", "created", "modified", "subjects")


def files(spark: SparkSession, path: str, pattern: str = "*", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files under a path with their kind; of larger ones only the row, without content and with an error: the scan does not read them."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    read = df.where(F.col("length") <= most_bytes).select("path", "length", "content", kind_of(F.col("content")).alias("kind"), container_kind(F.col("content")).alias("container"), F.lit(None).cast("string").alias("error"))
    left = df.where(F.col("length") > most_bytes).select("path", "length", F.lit(None).cast("binary"), F.lit("unknown"), F.lit("unknown"), F.lit(f"larger than {most_bytes} bytes"))
    return read.union(left)


@dataclass(frozen=True)
class Made:
    """Files that a function makes of the columns of a row, in the kernel that reads them: they are never a column, so one is held at a time."""

    rows: DataFrame
    columns: tuple[str, ...]
    of: Callable[..., bytes]


#: Rows, and bytes read, at which a kernel hands on a record batch.
_ROWS, _BYTES = 4096, 4 << 20


def _explode(df: DataFrame | Made, key: str, content: str, schema: str, rows_of) -> DataFrame:
    rows, columns, of = (df.rows, df.columns, df.of) if isinstance(df, Made) else (df, (content,), lambda data: data or b"")
    full = f"{key} {dict(rows.dtypes)[key]}, {schema}"
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    batches.small(spark)
    arrow = to_arrow_schema(spark.createDataFrame([], full).schema)

    def run(given):
        import pyarrow as pa

        def emit(keys, at, held):
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *(pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), list(arrow)[1:], strict=True))], schema=arrow)

        for b in given:
            at, held, size = [], [], 0
            for k, row in enumerate(zip(*b.columns[1:], strict=True)):
                data = of(*(x.as_py() for x in row))
                size += len(data)
                found = rows_of(data)
                held += found
                at += [k] * (len(held) - len(at))
                if len(held) >= _ROWS or held and size >= _BYTES:
                    yield emit(b.column(0), at, held)
                    at, held, size = [], [], 0
            if held:
                yield emit(b.column(0), at, held)

    return rows.select(key, *columns).mapInArrow(run, full)


def _book(data: bytes, unended: Collection[str] | None = None, texts: bool = True):
    from docframe.sources.containers import Book, open_book
    from docframe.sources.pdf import is_pdf, open_pdf
    from docframe.sources.svg import is_svg, open_svg

    try:
        if is_pdf(data):
            return open_pdf(data, texts=texts)
        if is_svg(data):
            return open_svg(data)
        return open_book(data, unended)
    except Exception as e:  # damaged input is data
        return Book("unknown", errors=[f"{type(e).__name__}: {e}"])


def metadata(df: DataFrame, key: str = "path", content: str = "content", unended: Collection[str] | None = None, columns: Collection[str] | None = None) -> DataFrame:
    """One row a document: its container, nine common fields (null if absent), number of parts, errors.

    Here and below, unended names the character references of HTML that count without a semicolon: all that the standard has, if None.
    columns names the fields asked for: without errors the pages of PDF files are not run.
    """
    kinds = {"container": "string", **dict.fromkeys(METADATA, "string"), "n_parts": "int", "errors": "array<string>"}
    asked = [c for c in kinds if columns is None or c in columns]

    def rows(data):
        b = _book(data, unended, "errors" in asked)
        every = {"container": b.kind, **{m: b.metadata.get(m) or None for m in METADATA}, "n_parts": len(b.spine()), "errors": b.errors}
        return [tuple(every[c] for c in asked)]

    return _explode(df, key, content, ", ".join(f"{c} {kinds[c]}" for c in asked), rows)


def parts(df: DataFrame, key: str = "path", content: str = "content", data: bool = True) -> DataFrame:
    """One row a part, with its place in the reading order. Without data, that column is not there, and the pages of PDF files are not run."""
    schema = "part string, item_id string, media_type string, spine int, linear boolean" + ", data binary" * data
    return _explode(df, key, content, schema, lambda d: [(p.path, p.item_id, p.media_type, p.spine, p.linear, p.data)[: 5 + data] for p in _book(d, texts=data).parts])


def text(df: DataFrame, key: str = "path", content: str = "content", unended: Collection[str] | None = None) -> DataFrame:
    from docframe.sources.containers import text_of

    return _explode(df, key, content, "text string", lambda d: [(text_of(_book(d), unended),)])


def markdown(df: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Parts in reading order as Markdown, blank ones dropped."""
    from docframe.operators.markdown import to_markdown
    from docframe.sources.containers import as_markup

    return _explode(df, key, content, "markdown string", lambda d: [("\n".join(m for p in _book(d).spine() if (m := to_markdown(as_markup(p))).strip()),)])


def outline(df: DataFrame, key: str = "path", content: str = "content", unended: Collection[str] | None = None) -> DataFrame:
    """The container's table of contents, or the headings of its parts."""
    return _explode(df, key, content, "ord int, level int, title string, part string, fragment string", lambda d: [(i, *e) for i, e in enumerate(_book(d, texts=False).toc(unended))])


def cells(df: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Worksheet cells of spreadsheets."""
    schema = "sheet string, row int, col int, type string, raw string, format string, text string, colspan int, rowspan int"
    return _explode(df, key, content, schema, lambda d: [(c.sheet, c.row, c.col, c.type, c.raw, c.format, c.text, c.colspan, c.rowspan) for c in _book(d).cells])


def _file(data: bytes):
    from docframe.sources import pdf

    f = pdf.File(data) if pdf.is_pdf(data) else None
    return None if f is None or "Encrypt" in f.trailer and f.security is None else f


def _pdf(data: bytes):
    f = _file(data)
    return (None, []) if f is None else (f, f.pages())


def chars(df: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Placed characters of PDF pages, in drawing order: see operators.stext for lines and blocks of them."""
    from docframe.operators.stext import CHARS

    def rows(data):
        from docframe.sources import pdf

        f, pages = _pdf(data)
        out, fonts = [], {}
        for n, page in enumerate(pages):
            c = f.get(page.get("Contents"))
            stream = b"\n".join(f.data(f.get(x)) for x in (c if isinstance(c, list) else [c]))
            try:
                out += [(n, k, x.c, x.x, x.y, x.dx, x.dy, x.size, x.advance) for k, x in enumerate(pdf.chars_of(f, f.dict(page.get("Resources")), stream, fonts=fonts))]
            except (ValueError, TypeError, KeyError, IndexError):
                continue  # what was read of the page stays unread; metadata() tells
        return out

    return _explode(df, key, content, CHARS, rows)


def lines(df: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Lines of PDF pages, numbered from 1 on each: what operators.stext.lines makes of the placed characters, document by document and without a shuffle."""
    schema = "page int, line int, text string, size double, x0 double, y0 double, x1 double, y1 double, dx double, dy double, first_x double, first_y double"

    def rows(data):
        from docframe.sources import pdf, stext

        f, pages = _pdf(data)
        out, fonts = [], {}
        for n, page in enumerate(pages):
            c = f.get(page.get("Contents"))
            stream = b"\n".join(f.data(f.get(x)) for x in (c if isinstance(c, list) else [c]))
            try:
                found = stext.lines(pdf.runs_of(f, f.dict(page.get("Resources")), stream, fonts=fonts))
            except (ValueError, TypeError, KeyError, IndexError):
                continue  # as in chars
            for k, x in enumerate(found, start=1):
                a = x.chars[0]
                out.append((n, k, x.text, x.size, *x.box, a.dx, a.dy, a.x, a.y))
        return out

    return _explode(df, key, content, schema, rows)


def links(df: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Links of any document: the part they are in, target part, fragment or uri, label, and the rectangle on PDF pages."""

    def rows(data):
        from docframe.operators.dom import node_text, parse
        from docframe.sources import pdf, svg
        from docframe.sources.containers import as_markup, rel
        from docframe.sources.xml import tree

        if pdf.is_pdf(data):
            f, pages = _pdf(data)
            number = {p["#ref"].num: n for n, p in enumerate(pages) if isinstance(p["#ref"], pdf.Ref)}
            return [(f"page{n}", k, uri or None, f"page{to}" if to is not None else None, "", "", r if len(r) == 4 else None) for n, p in enumerate(pages) for k, (r, uri, to) in enumerate(pdf.links(f, p, number))]
        if svg.is_svg(data):
            return [("drawing", k, href, None, "", label, None) for k, (href, label) in enumerate(svg.links(tree(svg._plain(data))))]
        out = []
        for p in _book(data).spine():
            for k, a in enumerate(x for x in parse(as_markup(p)).find("a") if x.attrs.get("href")):
                href, label = a.attrs["href"], " ".join(node_text(a).split())
                outside = href.find("://") > 0 or href.startswith(("mailto:", "tel:", "data:"))
                out.append((p.path, k, href if outside else None, None if outside else rel(p.path, href), "" if outside else href.partition("#")[2], label, None))
        return out

    return _explode(df, key, content, "part string, ord int, uri string, target string, fragment string, label string, rect array<double>", rows)


def pages(df: DataFrame, key: str = "path", content: str = "content", dpi: float = 72.0) -> DataFrame:
    """Pages of PDF files: label, media box, visible box, rotation, unit, and the matrix to pixels at a resolution."""
    schema = "page int, label string, media array<double>, bounds array<double>, rotate int, user_unit double, matrix array<double>"

    def rows(data):
        from docframe.sources import pdf_pages

        f = _file(data)
        return pdf_pages.pages(f, dpi) if f is not None else []

    return _explode(df, key, content, schema, rows)


def layers(df: DataFrame, key: str = "path", content: str = "content", event: str = "view", switch: dict[str, bool] | None = None, after: dict[str, dict[str, bool]] | None = None) -> DataFrame:
    """Optional content groups of PDF files and whether they are on, for an event and after switching some by name.

    after: columns of their own, which say the same after further switches, from one reading of the file.
    """
    after = after or {}

    def rows(data):
        from docframe.sources import pdf_pages

        f = _file(data)
        if f is None:
            return []
        found = [pdf_pages.Layers(f, event).switch(switch or {}).switch(more).rows() for more in ({}, *after.values())]
        return [(*first, *(shown for *_, shown in others)) for first, *others in zip(*found, strict=True)]

    return _explode(df, key, content, ", ".join(("ord int, name string, shown boolean", *(f"{c} boolean" for c in after))), rows)


def annotations(df: DataFrame, key: str = "path", content: str = "content", event: str = "view") -> DataFrame:
    """Annotations of PDF pages in drawing order, and which are drawn."""

    def rows(data):
        from docframe.sources import pdf_pages

        f, found = _pdf(data)
        return [(n, *a) for n, p in enumerate(found) for a in pdf_pages.annotations(f, p, pdf_pages.Layers(f, event), event)]

    return _explode(df, key, content, "page int, ord int, subtype string, rect array<double>, drawn boolean", rows)


def styles(df: DataFrame, key: str = "path", content: str = "content", tags: Collection[str] | None = None, properties: Collection[str] | None = None) -> DataFrame:
    """Computed styles of the parts of a book, with the sheets that they link and that these import; all, or those of some tags and properties."""
    asked = None if properties is None else frozenset(properties)
    of = None if tags is None else frozenset(tags)

    def rows(data):
        from docframe.operators import css, dom
        from docframe.sources.containers import as_markup, decode, rel

        book = _book(data)
        found = {p.path: p for p in book.parts}
        out = []
        for part in book.spine():
            root = dom.parse(as_markup(part))

            def load(href, base, at=part.path):
                path = rel(base or at, href)
                return (decode(found[path].data), path) if path in found else None

            out += [(part.path, *r) for r in css.computed(root, css.sheets_of(root, load)) if (of is None or r[1] in of) and (asked is None or r[2] in asked)]
        return out

    return _explode(df, key, content, "part string, pre int, tag string, property string, value string", rows)
