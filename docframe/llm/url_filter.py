"""URL filters: fixed rules, then empirical-Bayes host reputation.

Labelled outcomes (bad or not) are counted by host. A host's rate of bad pages
is shrunk through a chain of beta-binomial priors: the whole table gives the
prior of a public suffix, the suffix that of a registered domain, the domain
that of a host. The strength of each prior is estimated from the spread
between groups (method of moments). A page is blocked if the lower bound of
its host's posterior rate exceeds max_bad. Reputation goes by the host's name,
without user and port; an address of numbers is a domain of its own.

Defined cases: a null url, or one without ``://``, has an empty host and path
and is judged as the host ``''``; pages without a label only receive; several
labels of a page count as one, bad if any is; repeated pages are kept and
counted each; urls of any length are read whole; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

#: (verdict, host, path) of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Public suffixes of two labels, for a start; any other suffix has one. host_reputation takes the list that fits the crawl.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.nz", "co.za")
ADDRESS = r"^([0-9]+(\.[0-9]+){3}|\[.*)$"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
Z, MAX_BAD, WEAKEST, STRONGEST = 1.645, 0.2, 1.0, 1000.0


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffix_of(name: Column, suffixes=SUFFIXES) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(ADDRESS), "address").when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(name: Column, suffixes=SUFFIXES) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(ADDRESS), name).when(two.isin(*suffixes), F.substring_index(name, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; both null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _strength(stats: DataFrame, by: str) -> DataFrame:
    """One row: N, X and the estimated prior strength of groups `by`."""
    g = stats.groupBy(by).agg(F.sum("n").alias("n"), F.sum("x").alias("x")).where("n > 0")
    s = g.agg(F.sum("n").alias("N"), F.sum("x").alias("X"), F.count("*").alias("m"), F.sum(F.col("x") * F.col("x") / F.col("n")).alias("xx"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"))
    p = F.expr("X / N")
    tau = (F.col("xx") - p * F.col("X") - p * (1 - p) * (F.col("m") - 1)) / (F.col("N") - F.col("nn") / F.col("N"))
    k = F.when((F.col("m") > 1) & (F.col("nn") < F.col("N").cast("double") * F.col("N")) & (tau > 0), p * (1 - p) / F.nullif(tau, F.lit(0.0)) - 1).otherwise(F.lit(STRONGEST))
    return s.select("N", "X", F.least(F.greatest(k, F.lit(WEAKEST)), F.lit(STRONGEST)).alias("k"))


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = Z, suffixes=SUFFIXES) -> DataFrame:
    """(host, rate, bound) of every host name of pages(id, host), given outcomes(id, bad).

    The counts by host are the only shuffled state: partial sums first, so a
    host with a third of all pages costs one row a task.
    """
    labelled = outcomes.where("id is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    stats = materialize(
        pages.join(labelled, "id", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("x"))
        .withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)})
    )
    k = {by: _strength(stats, by).first() for by in ("suffix", "domain", "host")}
    mean = lambda x, n, prior, by: (x + k[by]["k"] * prior) / (n + k[by]["k"])
    total = ((k["host"]["X"] or 0) + 1.0) / ((k["host"]["N"] or 0) + 2.0)
    by_suffix = stats.groupBy("suffix").agg(mean(F.sum("x"), F.sum("n"), F.lit(total), "suffix").alias("of_suffix"))
    by_domain = (
        stats.groupBy("suffix", "domain").agg(F.sum("x").alias("dx"), F.sum("n").alias("dn")).join(by_suffix, "suffix")
        .select("domain", mean(F.col("dx"), F.col("dn"), F.col("of_suffix"), "domain").alias("of_domain"))
    )
    rate, size = F.col("rate"), F.col("n") + k["host"]["k"]
    return stats.join(by_domain, "domain").withColumn("rate", mean(F.col("x"), F.col("n"), F.col("of_domain"), "host")).select(
        "host", "rate", (rate - z * F.sqrt(rate * (1 - rate) / (size + 1))).alias("bound")
    )


def op5_url_filter(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).cast("int").alias("bad"))
    url = F.col("url")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    pages = pages.withColumn("name", name_of(F.col("host")))
    reputation = host_reputation(pages.select("id", F.col("name").alias("host")), labels).withColumnRenamed("host", "name")
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    method = F.when(F.col("bound") > MAX_BAD, "block").otherwise("allow")
    return pages.join(reputation, "name").select(
        F.col("id").alias("page_id"), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.round("bound", 6).alias("bound")
    )


def _duck_strength(by: str) -> str:
    return f"""{by}_k AS (SELECT N, X, CASE WHEN m > 1 AND nn < N::DOUBLE * N AND tau > 0 THEN least(greatest(p * (1 - p) / tau - 1, {WEAKEST}), {STRONGEST}) ELSE {STRONGEST} END AS k
      FROM (SELECT *, (xx - p * X - p * (1 - p) * (m - 1)) / (N - nn / N) AS tau FROM (SELECT *, X / N AS p FROM (
        SELECT sum(n)::BIGINT AS N, sum(x)::BIGINT AS X, count(*) AS m, sum(x * x / n) AS xx, sum(n::DOUBLE * n) AS nn
        FROM (SELECT sum(n)::BIGINT AS n, sum(x)::BIGINT AS x FROM stats GROUP BY {by} HAVING sum(n) > 0)))))"""


_TWO = "(" + ", ".join(f"'{s}'" for s in SUFFIXES) + ")"
_LAST = lambda n: f"array_to_string(list_slice(string_split(name, '.'), -{n}, -1), '.')"
_FITS = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_CHAIN = lambda pick: "CASE " + " ".join(f"WHEN {_FITS(h, p)} THEN '{pick(w, h, p)}'" for w, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
OP5_SQL = f"""
WITH parsed AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM (SELECT page_id, coalesce(translate(regexp_extract(url, '{URL}', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '') AS host,
                       coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages)),
lab AS (SELECT doc_id, max((quality = 0)::INT) AS bad FROM labels GROUP BY doc_id),
stats AS (SELECT *, name AS host, CASE WHEN regexp_matches(name, '{ADDRESS}') THEN name WHEN {_LAST(2)} IN {_TWO} THEN {_LAST(3)} ELSE {_LAST(2)} END AS domain,
                 CASE WHEN regexp_matches(name, '{ADDRESS}') THEN 'address' WHEN {_LAST(2)} IN {_TWO} THEN {_LAST(2)} ELSE {_LAST(1)} END AS suffix
          FROM (SELECT name, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS x FROM parsed LEFT JOIN lab ON page_id = doc_id GROUP BY name)),
{_duck_strength("suffix")}, {_duck_strength("domain")}, {_duck_strength("host")},
s AS (SELECT suffix, (sum(x) + k * t) / (sum(n) + k) AS m FROM stats, (SELECT k FROM suffix_k), (SELECT (coalesce(X, 0) + 1.0::DOUBLE) / (coalesce(N, 0) + 2.0::DOUBLE) AS t FROM host_k) GROUP BY suffix, k, t),
d AS (SELECT domain, (sum(x) + k * m) / (sum(n) + k) AS m FROM stats JOIN s USING (suffix), (SELECT k FROM domain_k) GROUP BY domain, k, m),
h AS (SELECT host AS name, r - {Z} * sqrt(r * (1 - r) / (n + k + 1)) AS bound FROM (SELECT host, n, k, (x + k * m) / (n + k) AS r FROM stats JOIN d USING (domain), (SELECT k FROM host_k)))
SELECT page_id, host, path, {_CHAIN(lambda w, h, p: h + p)} AS rule,
       coalesce({_CHAIN(lambda w, h, p: w)}, CASE WHEN bound > {MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict, round(bound, 6) AS bound
FROM parsed JOIN h USING (name)
"""
