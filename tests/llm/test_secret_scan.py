import hashlib
import random
import re

from pyspark.sql import functions as F

from docframe.llm import secret_scan as S

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    bits = ["token", "TOKEN=", "token :", '"', "'", " ", "= ", "abcdefgh", "abc", "AKIA", "AKIA" + "X9" * 8, "0123456789abcdef" * 2, "é", "🦆", "\n", "api_key:", "apikey='", "passwd", "ſecret=", "Key", "."]
    texts = [None, "", "token=token :abcdefgh", "secret: 12345", "🦆token=abcdef"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    rows = {r.doc_id: r for r in S.scan_secrets(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert [(s.start, s.kind, s.end) for s in rows[i].base] == brute(t)


def test_ownership_separates_examples_from_live_values(spark):
    example, own = "x1" * 12, "Zz9" * 8
    rows = [(i, f"see {example} here", f"src{i}") for i in range(12)] + [(100, f"mine {own} and {example}", "src0"), (101, f"{own} again", "src0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in S.scan_secrets(df).collect()}
    assert [s.kind for s in got[100].spans] == [3] and (got[100].n_live, got[100].n_example) == (1, 1)
    assert got[3].spans == [] and got[3].n_example == 1


def test_defined_cases(spark):
    schema = "doc_id long, text string, source string, spans string, _row int, base int"
    row = (None, "token = abcdef1234", None, "x", 1, 2)
    got = S.scan_secrets(spark.createDataFrame([row, row, (1, None, "a", None, None, None)], schema)).collect()
    assert sorted(len(r.base) for r in got) == [0, 1, 1]
    assert S.scan_secrets(spark.createDataFrame([], schema)).count() == 0
    long = "y" * 300_000 + " token=abcdef1234"
    assert S.scan_secrets(spark.createDataFrame([(1, long, "a", "", 0, 0)], schema)).first().base[0].start == 300_001


def test_redaction_keeps_the_rest(spark):
    text = "a 🦆 token=abcdef1234 b " + "0f" * 12 + " c"
    df = spark.createDataFrame([(1, text, "s"), (2, "clean", "s")], "doc_id long, text string, source string")
    got = {r.doc_id: r.t for r in S.scan_secrets(df, keep=("doc_id", "text")).select("doc_id", S.redact(F.col("text"), F.col("kept")).alias("t")).collect()}
    assert got == {1: "a 🦆 [SECRET] b [SECRET] c", 2: "clean"}


def test_redaction_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "_CHUNK", 7)
    rng = random.Random(4)
    bits = ["token=abcdef99 ", "secret: " + "0a" * 13, "0f" * 13, "🦆é", "\x01", "plain words ", "\n", "AKIA" + "Q7" * 9, "Zz9" * 8 + " ", ","]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in S.scan_secrets(df, keep=("doc_id", "text")).withColumn("t", S.redact(F.col("text"), F.col("kept"))).collect():
        at, out = 0, ""
        for s in r.spans:
            if s.start >= at:
                out += r.text[at : s.start] + "[SECRET]"
            at = max(at, s.end)
        assert r.text == texts[r.doc_id] and r.t == out + r.text[at:]


def test_many_matches_in_one_text_take_time_in_proportion(spark):
    import time

    n, one = 200_000, "token=abcdef1234 word "
    df = spark.createDataFrame([(1, one * n, "s")], "doc_id long, text string, source string")
    began = time.time()
    r = S.scan_secrets(df, keep=("doc_id", "text")).select(F.size("base"), F.get("base", F.lit(n - 1)), F.size("spans"), F.length(S.redact(F.col("text"), F.col("kept")))).first()
    assert r[0] == r[2] == n and (r[1].start, r[1].end) == ((n - 1) * len(one), n * len(one) - 6) and r[3] == n * len("[SECRET] word ")
    assert time.time() - began < 60


def test_an_owner_may_repeat_a_value(spark):
    own = "Zz9" * 8
    df = spark.createDataFrame([(i, f"mine {own}", "src") for i in range(40)], "doc_id long, text string, source string")
    assert all([s.kind for s in r.spans] == [3] for r in S.scan_secrets(df).collect())


def test_digest(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(S.render(F.array().cast(S.SPAN)), 256)).first()[0]


def test_query_equals_its_sql(spark):
    from tests.oracle import compare

    compare(spark, S.op6_secret_scan, S.OP6_SQL)
