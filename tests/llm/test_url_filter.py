from pyspark.sql import functions as F

from docframe.llm import url_filter as U
from tests.oracle import compare


def judged(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    h, p = U.host_of(F.col("url")), U.path_of(F.col("url"))
    r, v = U.rule_of(h, p)
    return [tuple(x) for x in df.select("i", h, p, r, v).orderBy("i").drop("i").collect()]


def test_parsing_and_rules(spark):
    got = judged(spark, [None, "no scheme", "http://A.Example.NET/en/x?q#f", "https://example.net/enx", "http://b.net", "x://example.com/de/", "y://EXAMPLE.org/fr/1", "a://b?c/d", "http://a.io://b/c"])
    assert got[0] == got[1] == ("", "", None, None)
    assert got[2] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[3][2:] == ("net/", "block") and got[4][2:] == (None, None)
    assert got[5][2:] == ("example.com/de/", "block") and got[6][2:] == ("org/fr/", "allow")
    assert got[7][:2] == ("b", "") and got[8][:2] == ("a.io:", "//b/c")


def test_bad_hosts_are_blocked_and_rare_ones_shrunk(spark):
    pages = [(i, f"h{i % 20}.good.com") for i in range(2000)] + [(5000 + i, "spam.bad.com") for i in range(200)] + [(9000, "one.good.com")]
    labels = [(i, int(i % 50 == 0)) for i in range(2000)] + [(5000 + i, 1) for i in range(200)] + [(9000, 1)]
    got = U.host_reputation(spark.createDataFrame(pages, "id long, host string"), spark.createDataFrame(labels, "id long, bad int")).collect()
    bound = {r.host: r.bound for r in got}
    assert bound["spam.bad.com"] > 0.8 and bound["one.good.com"] < U.MAX_BAD and bound["h1.good.com"] < 0.1


def test_defined_cases(spark):
    pages, labels = spark.createDataFrame([], "id long, host string"), spark.createDataFrame([], "id long, bad int")
    assert U.host_reputation(pages, labels).count() == 0
    one = spark.createDataFrame([(None, ""), (1, "a.co.uk"), (1, "a.co.uk")], "id long, host string")
    assert {r.host for r in U.host_reputation(one, labels).collect()} == {"", "a.co.uk"}
    d = spark.range(1).select(U.domain_of(F.lit("x.a.co.uk")), U.suffix_of(F.lit("x.a.co.uk"))).first()
    assert tuple(d) == ("a.co.uk", "co.uk")


def test_query_equals_its_sql(spark):
    compare(spark, U.op5_url_filter, U.OP5_SQL)
