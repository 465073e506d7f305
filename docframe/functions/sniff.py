"""What a document is, from its first bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD = 1024
#: Tags that begin a file of markup, from the WHATWG sniffing rules. Fixed values.
MARKUP = ("!doctype html", "html", "head", "script", "iframe", "h1", "div", "font", "table", "a", "style", "title", "b", "body", "br", "p")
ROOT = r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<![^>]*>|\s)*<([^\s/>]+)"
READS_AS_MARKUP = r"(?i)^[\t\n\f\r ]*(?:<(?:" + "|".join(MARKUP) + r")[\t\n\f\r />]|<!--)"
CONTROL = r"[\x00-\x08\x0b\x0e-\x1f\x7f]"
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LANG = r'(?is)<html[^>]*\blang="([^"]*)"'


def kind_of(content: Column) -> Column:
    """pdf, svg, book or unknown for a BINARY column."""
    head = F.decode(F.substring(content, 1, HEAD), "ISO-8859-1")
    # a character that the head's end cuts is no fault
    whole = F.is_valid_utf8(F.substring(content, 1, HEAD).cast("string"))
    for cut in (1, 2, 3):
        whole = whole | ((F.length(content) > HEAD) & F.is_valid_utf8(F.substring(content, 1, HEAD - cut).cast("string")))
    text = whole & ~head.rlike(CONTROL)
    book = head.startswith("PK\x03\x04") | F.substring(head, 61, 8).isin("BOOKMOBI", "TEXtREAd") | head.startswith("ITSF") | head.contains("<FictionBook")
    return (
        F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "unknown")
        .when(head.contains("%PDF-"), "pdf")
        .when(book, "book")
        .when(F.lower(F.regexp_extract(head, ROOT, 1)) == "svg", "svg")
        .when(text, "book")
        .otherwise("unknown")
    )


def container_kind(content: Column) -> Column:
    """zip, mobi, chm, fb2, html, text or unknown for a BINARY column; zip members tell EPUB and Office apart."""
    head = F.decode(F.substring(content, 1, HEAD), "ISO-8859-1")
    return (
        F.when(head.startswith("PK\x03\x04"), "zip")
        .when(F.substring(head, 61, 8).isin("BOOKMOBI", "TEXtREAd"), "mobi")
        .when(head.startswith("ITSF"), "chm")
        .when(F.translate(head, "\x00", "").contains("<FictionBook"), "fb2")
        .when(head.rlike(READS_AS_MARKUP), "html")
        .when(kind_of(content) == "book", "text")
        .otherwise("unknown")
    )


def markup_title(html: Column) -> Column:
    title = F.regexp_extract(F.substring(html, 1, 65536), TITLE, 1)
    return F.trim(F.replace(F.replace(F.replace(title, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&")))


def html_lang(html: Column) -> Column:
    return F.regexp_extract(html, LANG, 1)
