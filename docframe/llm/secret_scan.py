"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

Every row of text is scanned once, each pattern in one pass that marks its
matches; running sums of the lengths between the marks give the offsets. Each
match carries a hash of its secret value; the hashes are counted over the whole
corpus by distinct owner and distinct repository. A value that many owners hold
is a copied example, one that stays with few looks live: with one owner however
often that owner repeats it, with several if few repositories have it. Beside
the three fixed kinds the scan collects generic high-entropy tokens (letters
and digits, 20 characters and more); those that look live and overlap no fixed
span are added as kind ``owned``.

Rows without a match are never shuffled. What is done per match is sorted
windows and sums, so a text with hundreds of thousands of matches takes time in
proportion.

Defined cases: a null text is the empty text and has no spans; a null owner or
repository counts as one unnamed owner; repeated rows are kept, each with its
own result, and count once as an owner; texts are scanned whole at any length;
an empty table gives an empty result; other columns are left alone and never
read (the kept ones may have any name but the result's own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The fixed kinds, in the order that breaks ties. Letters are spelled in both
#: cases because Unicode-aware case folding would also accept U+017F and U+212A.
ASSIGN = (
    "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: Runs are maximal, so asking for the length in the pattern drops the same matches.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
GENERIC = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:bigint>>"


#: Stands around matches; replaced in texts, where no pattern matches it.
_MARK, _OTHER = "\x01", "\x02"
FOUND = "array<struct<kind:int,place:int,gap:bigint,size:bigint,value:bigint,good:boolean>>"
KEPT = "array<struct<from:bigint,to:bigint>>"
#: Code points of the pieces in which a text is redacted.
_CHUNK = 4096


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _matches(text: Column, pattern: str, kind: int, group: int, keep) -> Column:
    """All matches in order: the code points since the last one and of their own, the value's hash, whether keep() accepts it.

    The pieces between matches and the matches tile the text.
    """
    step = 3 if group else 2
    mark = f"{_MARK}$0{_MARK}" + (f"${group}{_MARK}" if group else "")

    def found(parts: Column) -> Column:
        def one(i: Column) -> Column:
            at = lambda k: F.get(parts, i * step + k)
            value = at(2 if group else 1)
            return F.struct(
                F.lit(kind).alias("kind"), i.alias("place"), F.length(at(0)).cast("bigint").alias("gap"), F.length(at(1)).cast("bigint").alias("size"), F.xxhash64(value).alias("value"), keep(value).alias("good")
            )

        return F.transform(F.sequence(F.lit(0), ((F.size(parts) - 1) / step).cast("int") - 1), one)

    marked = lambda m: F.when(F.instr(m, _MARK) > 0, _let(F.split(m, _MARK, -1), found)).otherwise(F.array().cast(FOUND))
    return _let(F.regexp_replace(text, F.lit(pattern), F.lit(mark)), marked)


def all_matches(text: Column) -> Column:
    """The matches of all kinds; text holds no mark."""
    yes = lambda v: F.lit(True)
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    return F.concat(_matches(text, ASSIGN, 0, 2, lambda v: F.length(v) >= 6), _matches(text, ACCESS, 1, 0, yes), _matches(text, HEX, 2, 0, yes), _matches(text, GENERIC, 3, 0, mixed))


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the spans."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan_secrets(df: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id",
                 keep: tuple[str, ...] = ("doc_id",), max_owners: int = 2, max_repos: int = 8) -> DataFrame:
    """Per input row: the kept columns, ``base`` and ``spans`` (arrays of start, kind, end, value), ``kept`` (what redact
    leaves; null without spans), ``n_live`` and ``n_example`` over all candidates.

    max_owners, max_repos: a value with more owners is a copied example, and so is
    one of several owners found in more repositories.
    """
    text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(_MARK), F.lit(_OTHER))
    scanned = materialize(
        df.select(
            *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)),
            F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("_owner"),
            F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("_repo"),
            all_matches(text).alias("_found"),
        ).withColumn("_row", F.monotonically_increasing_id())
    )
    by_row, before = W.partitionBy("_row"), (W.unboundedPreceding, -1)
    places = scanned.where(F.size("_found") > 0).select("_row", "_owner", "_repo", F.explode("_found").alias("_m")).select("_row", "_owner", "_repo", "_m.*").repartition("_row")
    end = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("_row", "kind").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    spans = materialize(places.withColumn("end", end).where("good").select("_row", "_owner", "_repo", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value"))
    owners = (
        spans.groupBy("value")
        .agg(F.count_distinct("_owner").alias("_owners"), F.count_distinct("_repo").alias("_repos"))
        .select("value", ((F.col("_owners") == 1) | ((F.col("_owners") <= max_owners) & (F.col("_repos") <= max_repos))).alias("_live"))
    )
    fixed = F.col("kind") < 3
    # of the fixed spans that begin before a generic one ends, the greatest end says whether any overlaps it
    order = by_row.orderBy(F.when(fixed, F.col("start")).otherwise(F.col("end")), F.when(fixed, 1).otherwise(0))
    covered = F.coalesce(F.max(F.when(fixed, F.col("end"))).over(order.rowsBetween(*before)), F.lit(0))
    judged = spans.join(owners, "value").repartition("_row").withColumn("_final", fixed | (F.col("_live") & (covered <= F.col("start"))))
    done = F.coalesce(F.max(F.when(F.col("_final"), F.col("end"))).over(by_row.orderBy("start", "kind", "end").rowsBetween(*before)), F.lit(0).cast("bigint"))
    judged = judged.withColumn("_from", F.when(F.col("_final") & (F.col("start") >= done), done))
    span = F.struct("start", "kind", "end", "value")
    last = F.struct(F.max(F.when(F.col("_final"), F.col("end"))).alias("from"), F.lit((1 << 31) - 1).cast("bigint").alias("to"))
    result = judged.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.when(fixed, span))).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("_final"), span))).alias("spans"),
        F.when(F.count_if("_final") > 0, F.concat(F.array_sort(F.collect_list(F.when(F.col("_from").isNotNull(), F.struct(F.col("_from").alias("from"), F.col("start").alias("to"))))), F.array(last))).alias("kept"),
        F.count_if("_live").alias("n_live"),
        F.count_if(~F.col("_live")).alias("n_example"),
    )
    kept = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    none = F.array().cast(SPAN)
    found = scanned.where(F.size("_found") > 0).drop("_owner", "_repo", "_found").join(result, "_row", "left")
    found = found.select(*kept, F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"), F.col("kept"), *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_live", "n_example")))
    clean = scanned.where(F.size("_found") == 0)
    return found.union(clean.select(*kept, none, none, F.lit(None).cast(KEPT), F.lit(0).cast("bigint"), F.lit(0).cast("bigint")))


def redact(text: Column, kept: Column, mark: str = "[SECRET]") -> Column:
    """The text with the mark between the stretches that scan_secrets keeps."""

    def stretch(chunks: Column):
        def cut(k: Column) -> Column:
            to = F.least(k["to"], F.size(chunks).cast("bigint") * _CHUNK)
            piece = lambda c: F.substring(F.get(chunks, c), (F.greatest(k["from"] - c * _CHUNK, F.lit(0)) + 1).cast("int"), (F.least(to - c * _CHUNK, F.lit(_CHUNK)) - F.greatest(k["from"] - c * _CHUNK, F.lit(0))).cast("int"))
            inside = F.transform(F.sequence(F.floor(k["from"] / _CHUNK).cast("int"), F.floor((to - 1) / _CHUNK).cast("int")), piece)
            return F.when(k["from"] < to, F.array_join(inside, "")).otherwise("")

        return F.array_join(F.transform(kept, cut), mark)

    return F.when(kept.isNull(), text).otherwise(_let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0)), stretch))


def op6_secret_scan(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return scan_secrets(docs).select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(render(F.col("base")), 256).alias("base_sha256"),
        render(F.col("spans")).alias("spans"),
        F.col("n_live").cast("bigint").alias("n_live"),
        F.col("n_example").cast("bigint").alias("n_example"),
    )


def _duck_spans(pattern: str, kind: int, group: int, keep: str) -> str:
    p, k = pattern.replace("'", "''"), kind
    return f"""
      SELECT doc_id, owner, {k} AS kind, s.start AS start, s.start + length(s.whole) AS "end", s.value AS value FROM (
        SELECT doc_id, owner, unnest(list_transform(generate_series(1, len(whole)), lambda i: {{
            'start': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:i-1], lambda w: length(w))), 0),
            'whole': whole[i], 'value': vals[i]}})) AS s
        FROM (SELECT doc_id, coalesce(source, '') AS owner, string_split_regex(coalesce(text, ''), '{p}') AS gaps,
                     regexp_extract_all(coalesce(text, ''), '{p}', 0) AS whole, regexp_extract_all(coalesce(text, ''), '{p}', {group}) AS vals
              FROM documents WHERE regexp_matches(text, '{p}')))
      WHERE {keep}"""


OP6_SQL = f"""
WITH base AS ({_duck_spans(ASSIGN, 0, 2, "length(s.value) >= 6")} UNION ALL {_duck_spans(ACCESS, 1, 0, "true")} UNION ALL {_duck_spans(HEX, 2, 0, "true")}),
generic AS ({_duck_spans(GENERIC, 3, 0, "regexp_matches(s.value, '[0-9]') AND regexp_matches(s.value, '[A-Za-z]')")}),
cand AS (SELECT * FROM base UNION ALL SELECT * FROM generic),
vals AS (SELECT value, count(DISTINCT owner) = 1 OR (count(DISTINCT owner) <= 2 AND count(DISTINCT doc_id) <= 8) AS live FROM cand GROUP BY value),
per AS (SELECT doc_id, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM cand JOIN vals USING (value) GROUP BY doc_id),
added AS (SELECT g.* FROM generic g JOIN vals USING (value) WHERE live AND NOT EXISTS
            (SELECT 1 FROM base b WHERE b.doc_id = g.doc_id AND b.start < g."end" AND g.start < b."end")),
names AS (SELECT *, CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owned' END || ':' || start || ':' || "end" AS s
          FROM (SELECT * FROM base UNION ALL SELECT * FROM added)),
joined AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
                  coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS b, string_agg(s, ',' ORDER BY start, kind) AS spans
           FROM names GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents d LEFT JOIN joined USING (doc_id) LEFT JOIN per USING (doc_id)
"""
