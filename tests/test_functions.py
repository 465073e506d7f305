import datetime as dt

import pytest
from pyspark.sql import functions as F

from docframe import session
from docframe.functions import dates
from docframe.functions import geometry as G


def one(spark, *cols):
    r = spark.range(1).select(*cols).first()
    return r[0] if len(cols) == 1 else tuple(r)


def test_matrices(spark):
    m, n = G.matrix(2, 0, 0, 3, 5, 7), G.matrix(0, 1, -1, 0, 1, 1)
    assert tuple(one(spark, G.concat(m, n))) == (0.0, 2.0, -3.0, 0.0, -6.0, 6.0)
    assert tuple(one(spark, G.concat(m, G.invert(m)))) == pytest.approx((1, 0, 0, 1, 0, 0))
    assert tuple(one(spark, G.invert(G.matrix(1, 1, 1, 1, 0, 0)))) == (1, 0, 0, 1, 0, 0)
    assert one(spark, G.expansion(m)) == pytest.approx(6**0.5)
    r = G.box(F.lit(0), F.lit(0), F.lit(1), F.lit(2))
    assert tuple(one(spark, G.apply_box(n, r))) == (-1.0, 1.0, 1.0, 2.0)
    s = G.box(F.lit(0.5), F.lit(1), F.lit(3), F.lit(1))
    assert one(spark, G.is_empty(s)) and tuple(one(spark, G.union(r, s))) == (0, 0, 1, 2) and not one(spark, G.contains(r, s))
    assert tuple(one(spark, G.outer(G.box(F.lit(0.2), F.lit(-0.2), F.lit(1.1), F.lit(2))))) == (0, -1, 2, 2)


def test_colors(spark):
    assert tuple(one(spark, G.hex_color(F.lit("#1aF")))) == (17, 170, 255, 255) and tuple(one(spark, G.hex_color(F.lit("#01020304")))) == (1, 2, 3, 4) and one(spark, G.hex_color(F.lit("#12345"))) is None
    assert tuple(one(spark, G.hsl_color(F.lit(120.0), F.lit(1.0), F.lit(0.25)))) == (0, 128, 0) and tuple(one(spark, G.hsl_color(F.lit(-60.0), F.lit(1.0), F.lit(0.5)))) == (255, 0, 255)
    assert tuple(one(spark, G.lab_color(F.lit(100.0), F.lit(0.0), F.lit(0.0)))) == pytest.approx((1, 1, 1), abs=2e-3)
    assert one(spark, G.exponential(F.lit(0.5), [0.0, 1.0], [1.0, 0.0], 2.0)) == [0.25, 0.75]


@pytest.mark.parametrize(
    ("s", "want"),
    [("D:20200102030405+02'00'", (2020, 1, 2, 1, 4, 5)), ("2019", (2019, 1, 1)), ("D:201912Z", (2019, 12, 1)), ("D:20200101000000-0530", (2020, 1, 1, 5, 30)), ("D:20200101000000+99'00'", (2020, 1, 1)), ("nothing", None), ("D:20201301", None)],
)
def test_pdf_dates(spark, s, want):
    assert one(spark, dates.pdf_date(F.lit(s))) == (dt.datetime(*want) if want else None)


def test_iso_dates(spark):
    assert [one(spark, dates.iso_date(F.lit(s))) for s in ("2020-02-03", " 2020-02 ", "2020", "2020-02-03T04:05:06+01:00", "x")] == [dt.datetime(2020, 2, 3), dt.datetime(2020, 2, 1), dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 3, 3, 5, 6), None]


def test_sql_names(spark):
    session.register(spark)
    assert spark.sql("SELECT tag FROM html_nodes('<p>a') WHERE type = 'element' AND depth = 3").first().tag == "p"
    assert spark.sql("SELECT node_text('<p>a<p>b') AS t, to_markdown('<h1>x') AS m, document_text(CAST('plain' AS BINARY)) AS d").first() == ("a\nb", "# x", "plain")
    assert spark.sql("SELECT p.i, h.title FROM VALUES (1, '<h1>x</h1><h2>y</h2>') AS p(i, html), LATERAL html_headings(p.html) h ORDER BY h.level").collect() == [(1, "x"), (1, "y")]
