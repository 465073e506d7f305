from docframe.operators import bidi, css, dom, relations
from docframe.plans import builders, catalogue
from docframe.sources import containers, documents, pdf

from tests.oracle import SF


def _plan(spark, name):
    return catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_pages_are_counted_in_one_pass_over_a_sorted_partition(spark):
    plan = _plan(spark, "paginate_relation")
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "FlatMapGroups" not in plan and "Window" not in plan


def test_pages_go_on_from_batch_to_batch(spark):
    spans = spark.createDataFrame([(1, k, 40.0) for k in range(25_000)] + [(2, 0, 95.0), (2, 1, 1.0), (2, 2, None), (None, 0, 1.0)], "d long, k long, h double")
    got = {(r.d, r.k): r.page for r in relations.paginate(spans, "d", "k", "h", 90.0).collect()}
    assert len(got) == spans.count() and all(got[1, k] == k // 2 for k in range(25_000))
    assert [got[2, 0], got[2, 1], got[2, 2], got[None, 0]] == [0, 1, 1, 0]


def test_intervals_are_merged_in_one_pass_over_a_sorted_partition(spark):
    plan = _plan(spark, "island_merge")
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "Window" not in plan and "l_orderkey" not in plan and "Aggregate" not in plan


def test_islands_go_on_from_batch_to_batch(spark):
    rows = [(1, 2 * k, 2 * k + 2) for k in range(25_000)] + [(2, 9, 11), (2, 1, 4), (2, 5, 6), (2, 4, 5), (2, None, 8)]
    got = sorted(map(tuple, relations.merged_intervals(spark.createDataFrame(rows, "p long, a long, b long"), "p", "a", "b").collect()))
    assert got == [(1, 1, 0, 50_000, 25_000), (2, 1, 1, 8, 4), (2, 2, 9, 11, 1)]


def test_files_are_made_where_they_are_read(spark):
    for name in ("pdf_layers", "pdf_pages", "pdf_links", "svg_metadata", "fb2_metadata", "epub_metadata"):
        plan = _plan(spark, name)
        assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Exchange" not in plan


def test_batches_to_kernels_are_bounded(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    catalogue.QUERIES["page_markdown"](spark, SF)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"


def test_objects_of_a_file_without_object_streams_wait_until_asked_for():
    data = builders.pdf(1, "a line\n" * 100, "en", "s")
    f = pdf.File(data)
    assert not f.cache and len(f.pages()) == 3
    assert pdf.File(data.replace(b"/Type /OCG", b"/Type /Obj#53tm", 1)).cache


def test_a_sheet_is_parsed_once():
    before = css._kept_sheet.cache_info().misses
    for k in range(20):
        root = dom.parse(f"<p id=x{k}>a</p>")
        assert ("p", "display", "block") in [r[1:] for r in css.computed(root, [(css.AUTHOR, "p { color: red }")])]
    assert css._kept_sheet.cache_info().misses - before <= 2


def test_styles_that_are_not_asked_for_stay_in_the_kernel(spark):
    files = builders.files(spark.createDataFrame([(1, "a\nb", "en", "s")], "doc_id long, text string, lang string, source string"), builders.epub)
    got = documents.styles(files, "doc_id", tags=("p",), properties=("color",)).collect()
    assert {(r.tag, r.property) for r in got} == {("p", "color")} and len(got) == 2
    assert "Filter (" not in _plan(spark, "epub_styles")


def test_palmdoc_copies_are_slices():
    assert containers._palmdoc(b"ab\x80\x17" + b"c\xc1\x02\xe9\x8e\x80\x08") == b"ab" + b"ab" * 5 + b"c A\xe9\x8e" + b"\x8e" * 3
    assert containers._LITERALS.match(b"plain text\x80")[0] == b"plain text"


def test_breaks_are_counted_before_rows_leave_the_kernel(spark):
    for name in ("line_breaks", "break_opportunities"):
        assert "offset" not in _plan(spark, name)
    for t in ("", "a", "a b", "12 a,b", "x\n\ny ", " lead", "日本 語", "a-1 b/c (d) \"e\"!", "\r\n", "a\rb́ c"):
        assert bidi.line_breaks(t) == bidi._breaks(t)
