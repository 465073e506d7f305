import random

import pytest

from docframe.operators import stext as windows
from docframe.plans import builders, catalogue
from docframe.sources import documents, pdf, stext
from tests.test_documents import EPUB, PDF


def test_windows_equal_the_kernel(spark):
    rng, pages = random.Random(4), []
    for _ in range(40):
        chars, x, y = [], 0.0, 700.0
        for _ in range(60):
            c = rng.choice("abcdef  ")
            chars.append(stext.Char(c, x, y, 1.0, 0.0, 10.0, 5.0))
            x += 5 + rng.choice([0, 0, 0, 0, 1, 2, 7, 20])
            if rng.random() < 0.1:
                x, y = rng.choice([0.0, 0.0, 400.0]), y - rng.choice([12, 12, 15, 30, -5])
            elif rng.random() < 0.05:
                chars.append(stext.Char(c, chars[-1].x + 1, y, 1.0, 0.0, 10.0, 5.0))
        pages.append(chars)
    rows = [(p, 0, k, c.c, c.x, c.y, c.dx, c.dy, c.size, c.advance) for p, cs in enumerate(pages) for k, c in enumerate(cs)]
    got = {r.doc: r.text for r in windows.page_texts(spark.createDataFrame(rows, f"doc int, {windows.CHARS}"), "doc").collect()}
    assert [got[p] for p in range(len(pages))] == [stext.text(cs) for cs in pages]


def test_pdf_characters_lines_and_links(spark):
    df = spark.createDataFrame([("p", bytearray(PDF)), ("e", bytearray(EPUB)), ("h", bytearray(b"<p><a href='x.html#y'>l</a><a href='http://z'>m"))], "path string, content binary")
    assert [r.text for r in windows.page_texts(documents.chars(df), "path").collect()] == ["Hello world\nsecond x\nthird\n\nfar"]
    lines = windows.blocks(windows.lines(documents.chars(df), "path"), "path").orderBy("line").collect()
    assert [(r.text, r.block) for r in lines] == [("Hello world", 1), ("second x", 1), ("third", 1), ("far", 2)] and abs(lines[0].x0 - 20) < 1e-6
    got = {(r.path, r.part, r.ord): (r.uri, r.target, r.fragment, r.label) for r in documents.links(df).collect()}
    assert got[("p", "page0", 0)] == ("http://x.y", None, "", "") and got[("p", "page0", 1)][1] == "page1"
    assert got[("h", "index.html", 0)] == (None, "x.html", "y", "l") and got[("h", "index.html", 1)] == ("http://z", None, "", "m")


def test_lines_of_the_kernel_are_those_of_the_windows_and_shuffle_nothing(spark):
    files = [(k, bytearray(builders.pdf(k, "aa b  (c) \\\\ d\nxx\n\nlast line é" * (30 * k % 47), "en", "s"))) for k in range(6)]
    df = spark.createDataFrame(files, "path long, content binary")
    shown = lambda found: sorted((r.path, r.page, r.text, *(round(r[c], 6) for c in ("size", "x0", "y0", "x1", "y1", "dx", "dy", "first_x", "first_y"))) for r in found.collect())
    assert shown(documents.lines(df)) == shown(windows.lines(documents.chars(df), "path"))
    for name in ("pdf_lines", "pdf_blocks"):
        assert "Exchange" not in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_a_run_is_read_as_its_characters():
    run = stext.Run("aab", 0.0, 0.0, 1.0, 0.0, 10.0, [5.0, 5.0, 5.0], 10.0)
    for first in ([], [stext.Char("a", 0.5, 0.0, 1.0, 0.0, 10.0, 5.0)], [stext.Char("z", -9.0, 0.0, 1.0, 0.0, 10.0, 5.0)]):
        assert stext.text([*first, run, run]) == stext.text([*first, *run, *run])
    assert run.last == [*run][-1] and run.end() == [*run][-1].end()


def test_metadata_labels_and_outlines_run_no_page(monkeypatch):
    monkeypatch.setattr(pdf, "page_text", lambda *a: pytest.fail("a page was run"))
    b = builders.pdf(7, "a\n" * 90, "en", "s")
    book = documents._book(b, texts=False)
    assert book.metadata["title"] == "Document 7" and [p.item_id for p in book.spine()] == ["i", "p. 2", "p. 3"] and len(book.toc()) == 2


def test_small_files_are_handed_on_together():
    sizes = [b.num_rows for b in builders._batches(((k, b"x" * (2 << 20 if k == 3 else 9)) for k in range(100)), "key")]
    assert sizes == [4, 64, 32]
