"""Nearest neighbours, token counts, decontamination, the pipeline and the entry module."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docframe.llm import common, decontaminate, token_counts, vptree
from docframe.llm import queries as llm
from tests.oracle import SF, compare

# -- vantage-point trees


def brute(rows, k, asks):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if not asks(q):
            continue
        best = {}
        for i, b in good:
            if i != q and len(a) == len(b):
                s = vptree.dots(a[None], b[None])[0] / (np.sqrt(vptree.dots(a[None], a[None])[0]) * np.sqrt(vptree.dots(b[None], b[None])[0]))
                best[i] = max(best.get(i, -9), s)
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return {(q, r + 1, i, -s) for q, b in out.items() for r, (s, i) in enumerate(b)}


def test_exact_search_equals_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)] + [(2000 + i, [2 * x for x in rows[7][1]]) for i in range(5)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 6), (3003, [float("nan")] * 6), (3004, [1.0, None]), (None, [1.0] * 6), (3010, [1.0, 2.0]), (3020, [2.0, 1.0]), (20, rows[20][1]), (rows[30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(1))
    got = {tuple(r) for r in vptree.nearest(df, F.col("id") % 10 == 0, shard_rows=150).collect()}
    assert got == brute(rows, 5, lambda i: i % 10 == 0)


def searched(x, queries, relax, leaf=64):
    tree = vptree.Tree(x, [[i] for i in range(len(x))], leaf)
    found = tree.search(x[:queries], np.arange(queries), 5, relax)
    return [{i for _, i in best} for best in found], tree.scored / (queries * len(x))


def test_clusters_are_pruned_without_loss():
    rng = np.random.default_rng(1)
    x = (rng.normal(0, 1, (40, 16))[rng.integers(0, 40, 4000)] + rng.normal(0, 0.1, (4000, 16))).astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    order = np.argsort(-(unit[:100] @ unit.T - 9 * np.eye(100, len(x))), axis=1)
    found, share = searched(x, 100, 1.0)
    assert found == [set(o[:5].tolist()) for o in order] and share < 0.25
    loose, less = searched(x, 100, 1.5)
    assert less < share and np.mean([len(a & b) / 5 for a, b in zip(found, loose, strict=True)]) >= 0.9


@pytest.mark.parametrize(("relax", "recall", "most"), [(1.0, 1.0, 1.0), (6.0, 0.95, 0.95), (7.0, 0.9, 0.9)])
def test_share_scored_of_the_table(relax, recall, most):
    import pyarrow.parquet as pq

    x = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist(), float)
    exact, _ = searched(x, 200, 1.0)
    found, share = searched(x, 200, relax)
    assert share <= most and np.mean([len(a & b) / 5 for a, b in zip(exact, found, strict=True)]) >= recall


def test_search_of_an_empty_table(spark):
    assert vptree.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_search_query_equals_its_sql(spark):
    compare(spark, vptree.op2_vp_tree_ann, vptree.OP2_SQL)


# -- token counts


@pytest.mark.parametrize("rule", ["start", "most"])
def test_sections_add_up_to_whole_encodings(spark, rule):
    texts = [None, "", "one", "a\nb\n", "\n\n\n", "  x\n\n  y", "é🦆\n日本\n" * 50, "word " * 5000]
    df = spark.createDataFrame([(i if i else None, t, 1, "c") for i, t in enumerate(texts)] + [(2, "one", 1, "c")], "doc_id long, text string, section int, n_tokens string")
    rows = token_counts.token_counts(df, token_counts.vocabulary(), rule=rule).collect()
    coder = token_counts.Encoder(token_counts.vocabulary())
    for i, t in enumerate(texts):
        mine = sorted((r.section, r.start, r.end, r.n_tokens) for r in rows if r.id == (i if i else None))
        if i == 2:
            assert mine[0] == mine[1]
            mine = mine[:1]
        assert sum(m[3] for m in mine) == (len(coder.encode(t)) if t else 0)
        assert mine[0][1] == 0 and mine[-1][2] == len(t or "") and all(a[2] == b[1] for a, b in zip(mine, mine[1:], strict=False))
    assert token_counts.token_counts(df.limit(0), token_counts.vocabulary()).count() == 0


def test_allocation_equals_brute_force():
    rng = random.Random(3)
    for _ in range(50):
        ends = np.cumsum([rng.randrange(1, 6) for _ in range(30)])
        spans = np.stack([np.concatenate([[0], ends[:-1]]), ends], axis=1)
        cut = np.array([0, *sorted(rng.sample(range(1, int(ends[-1])), 8))])
        of = lambda c: int(np.flatnonzero(cut <= c)[-1])
        for rule in ("start", "most"):
            owner, crosses = token_counts.allocate(spans, cut, int(ends[-1]), rule)
            for (a, b), o, x in zip(spans, owner, crosses, strict=True):
                held = [of(c) for c in range(a, b)]
                assert o == (held[0] if rule == "start" else max(sorted(set(held)), key=held.count)) and x == (len(set(held)) > 1)


def test_token_query_covers_all_documents(spark):
    got = token_counts.op7_token_counts(spark, SF).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    coder = token_counts.Encoder(token_counts.vocabulary())
    text = dict(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    assert {r.doc_id: r.n for r in got} == {i: len(coder.encode(t)) for i, t in text.items()}


def test_long_runs_are_encoded_whole(monkeypatch):
    path, rng = token_counts.vocabulary(), random.Random(5)
    plain, cut = token_counts.Encoder(path), token_counts.Encoder(path)
    white = re.compile("[\t-\r \x85\xa0\u2003\u3000]{3,}")
    for _ in range(300):
        text = "".join(rng.choice(["a", "word", " ", "   ", "\n", "\n\n", "\t\t ", "\u3000" * 4, "12", "...", "\xa0"]) for _ in range(40))
        whole = plain.encode(text).tolist()
        with monkeypatch.context() as m:
            m.setattr(token_counts, "LONG_RUN", 3)
            m.setattr(token_counts, "_WHITE", white)
            assert cut.encode(text).tolist() == whole
    for text in (" " * (4 << 20), "\n" * (2 << 20) + "end", "start" + " \t" * (1 << 20) + "end", "z" * (1 << 20), "." * (1 << 20), "7" * (1 << 20)):
        ids = plain.encode(text)
        assert plain.coder.decode(ids.tolist()) == text


def test_lines_of_the_query_equal_brute_force(spark):
    got = {}
    for r in token_counts.op7_token_counts(spark, SF).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.start, r.end, r.n_tokens)
    coder = token_counts.Encoder(token_counts.vocabulary()).coder
    for i, text in map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()):
        lines = text.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        ends, counts = np.cumsum([len(x) for x in lines]), [0] * len(lines)
        _, offsets = coder.decode_with_offsets(coder.encode_ordinary(text))
        for at in offsets:
            counts[int(np.searchsorted(ends, at, side="right"))] += 1
        assert got[i] == {k: (int(e) - len(x), int(e), n) for k, (x, e, n) in enumerate(zip(lines, ends, counts, strict=True))}


# -- decontamination


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_infix_distance_equals_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9)))
        t = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 12)))
        eq = {}
        for i, c in enumerate(a):
            eq[c] = eq.get(c, 0) | 1 << i
        assert decontaminate.infix_distance(eq, len(a), t) == min(edit(a, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))


def items():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/benchmark.parquet").to_pydict()
    return list(zip(t["item_id"], (x.encode() for x in t["text"]), strict=True))


def edited(text, rate, rng):
    out = bytearray()
    for c in text:
        if rng.random() < rate:
            out += rng.choice([b"", bytes([rng.choice(b"aeinrst")]), bytes([rng.choice(b"aeinrst"), c])])
        else:
            out.append(c)
    return bytes(out)


LENGTHS = [(5, 9), (10, 15), (16, 23), (24, 31), (32, 39), (40, 48), (49, 60), (61, 80), (81, 120), (121, 180), (200, 260)]


@pytest.mark.parametrize(("shortest", "longest"), LENGTHS)
def test_recall_by_length_and_edit_rate(shortest, longest):
    rng, bench = random.Random(3), [decontaminate.normal(t) for _, t in items()]
    for rate in (0.0, 0.05, 0.1, 0.15, 0.18, 0.2):
        passages = []
        while len(passages) < 60:
            t, n = rng.choice(bench), rng.randint(shortest, longest)
            at = rng.randint(0, max(0, len(t) - n))
            p = t[at : at + n].strip()
            if len(p) >= shortest:
                passages.append(p)
        found = decontaminate.Items(list(enumerate(passages)))
        texts = [b"zz. " + edited(p, rate, rng) + b" qqq zz" for p in passages]
        truth = {(i, i): found.distance(i, decontaminate.normal(t)) for i, t in enumerate(texts)}
        truth = {p: d for p, d in truth.items() if d <= found.most[p[0]]}
        got = {(t, k): d for t, k, d in decontaminate.leaks_in(texts, found)}
        hit = [p for p in truth if p in got]
        assert all(got[p] == truth[p] for p in hit) and all(d <= found.most[k] for (_, k), d in got.items())
        assert len(hit) >= (1.0 if longest < 24 or not rate else 0.9) * len(truth) and (rate > 0.18 or len(truth) > 20)


def test_passages_in_text_without_spaces_are_found():
    item = "机器学习模型在训练数据中看到测试题目时评测结果会偏高因此需要清除重复内容".encode()
    found = decontaminate.Items([(1, item), (2, b"-" * 300), (3, b"ab" * 100)])
    before, after = "前面还有一些别的文字没有空格".encode(), "后面也有一些文字".encode()
    texts = [before + item + after, before + item[:60] + item[63:] + after, before + after, b"x" + b"-" * 100_000, b"ab" * 99, b"a" * 5000]
    assert {(t, k) for t, k, _ in decontaminate.leaks_in(texts, found)} == {(0, 0), (1, 0), (3, 1), (4, 2)}


def test_bounds_never_exceed_the_distance():
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"abcdef ") for _ in range(rng.randrange(1, 200))) for _ in range(40)]
    found = decontaminate.Items(list(enumerate(texts)))
    for k, t in enumerate(found.texts):
        window = b"zz" + edited(t, 0.15, rng) + b"yyy"
        one = lambda x: np.array([x])
        found.most[k] = len(t)  # count to the end
        bound = found.bounds(one(k), one(2 - len(t)), one(2 + 2 * len(t)), np.frombuffer(window, np.uint8), one(0), one(len(window)))[0] if t else 0
        assert bound <= (exact := found.distance(k, window) if t else 0) and (len(t) > 64 or bound == exact)


def test_long_texts_are_read_whole():
    item = items()[0][1]
    found = decontaminate.Items(items())
    text = b"word " * 1_200_000 + item + b" word" * 200_000
    assert [k for _, k, d in decontaminate.leaks_in([text], found) if not d] == [0]


def test_clean_texts_are_left_alone():
    found = decontaminate.Items(items())
    assert decontaminate.leaks_in([b"An ordinary text about nothing in particular, long enough to be walked. " * 20], found) == []


def test_decontamination_query_equals_brute_force_on_exact_passages(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in decontaminate.op9_decontaminate(spark, sf).collect() if r.distance == 0}
    docs = [(r.doc_id, decontaminate.normal(r.text.encode())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bench = [(r.item_id, decontaminate.normal(r.text.encode())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got == {(i, k) for i, t in docs for k, x in bench if x in t}


def test_decontamination_query_equals_brute_force_on_edited_passages(spark, tmp_path):
    rng = random.Random(2)
    bench = [(k, t) for k, t in items()][:40] + [(900, b"how many rivers cross the plain?"), (901, b"name the ninth prime"), (902, b"name the ninth prime")]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for n in range(60):
        passage = edited(rng.choice(bench)[1], rng.choice([0, 0.05, 0.1, 0.15]), rng).decode(errors="ignore")
        docs.append((10_000 + n, f"An opening of its own. {passage}, and then some more of it."))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, t.decode()) for k, t in bench], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.op9_decontaminate(spark, str(tmp_path)).collect()}
    all_, truth = decontaminate.Items(bench), {}
    for i, t in docs:
        window = decontaminate.normal(t.encode())
        for n, (k, _) in enumerate(bench):
            if i >= 10_000 or len(window) < 1500:
                d = all_.distance(n, window)
                if d <= all_.most[n]:
                    truth[i, k] = d
    short = {i for i, t in docs if i >= 10_000 or len(decontaminate.normal(t.encode())) < 1500}
    got = {p: d for p, d in got.items() if p[0] in short}
    assert set(got) <= set(truth) and all(truth[p] == d for p, d in got.items()) and len(got) >= 0.95 * len(truth) and len(truth) > 50


def test_short_items_are_found_at_every_distance_allowed():
    rng, texts = random.Random(8), [b"what is the capital of france now?", b"name three rivers", b"tiny"]
    found, wrapped = decontaminate.Items(list(enumerate(texts))), []
    for _ in range(150):
        out = bytearray(rng.choice(texts))
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(out) + 1)
            out[at : at + 1] = rng.choice([b"", b"x", b"yz"])
        wrapped.append(b'Asked: ("' + bytes(out) + b'"), and so on.')
    size = [len(t) for t in texts]
    want = {}
    for i, t in enumerate(wrapped):
        for k, x in enumerate(texts):
            d = found.distance(k, decontaminate.normal(t))
            if d <= int(0.2 * size[k] + 1e-9):
                want[i, k] = d
    assert {(t, k): d for t, k, d in decontaminate.leaks_in(wrapped, found)} == want and any(want.values())


def test_decontamination_defined_cases(spark):
    long = "The benchmark item that is looked for, of more than forty characters."
    bench = spark.createDataFrame([(1, long), (2, long), (3, None), (4, ""), (5, "short one")], "item_id int, text string")
    schema = "doc_id long, text string, item int, distance string"
    rows = [(1, "x " * 200 + long + " y", 0, ""), (None, "before " + long.upper(), 0, ""), (3, None, 0, ""), (3, "", 0, ""), (4, "a short one here", 0, ""), (4, "a short one here", 0, ""), (5, "shorter ones", 0, "")]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((-1 if r.id is None else r.id, r.item) for r in decontaminate.find_leaks(docs, bench, block_bytes=100).collect())
    assert got == [(-1, 1), (-1, 2), (1, 1), (1, 2), (4, 5), (4, 5)]
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench, block_bytes=100).collect()) == [3, 3, 5]
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


# -- the pipeline and the entry


def test_pipeline_stages_on_planted_documents(spark, tmp_path):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    item = bench.first().text
    long = next(t for _, t in clean if len(t) > 3000 and item not in t)
    planted = [
        (10_000, long + " copy one"), (10_001, long + " copy one"), (10_002, "12345 !!! 678"), (10_003, None),
        (10_004, "An opening of its own before the passage comes. " + item + " And an end."), (10_005, "Only here: token = abcdef0123456789abcdef0123 and then more."),
    ]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in clean + planted]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if n < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert seen[0] == {i for i, _ in clean + planted} - {10_002, 10_003}
    assert not {10_000, 10_001} <= seen[1] and 10_004 in seen[1] and 10_004 not in seen[2] and seen[3] == seen[2] == seen[4]
    redacted = spark.read.parquet(f"{tmp_path}/3").where("doc_id = 10005").first()
    assert redacted.text == "Only here: [SECRET] and then more." and redacted.n_chars == len(redacted.text)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == seen[4]


def test_stages_with_clashing_columns_repeated_rows_and_empty_tables(spark, tmp_path):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["_lang", "_score", "spans", "base", "kept", "node", "shingle", "_row", "_c0", "_k0", "id", "text_", "u", "v"]
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en", "a"), (1, words, "en", "a"), (1, words[::-1], "en", None), (2, None, None, "b"), (3, "", "de", "b"), (4, "token = abcdef0123456789", "en", "c"), (None, words + " more", "en", "c"), (5, bench.first().text, "es", "d")]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r, *names) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        docs = common.materialize(out)
        assert all(r[n] == n for r in docs.collect() for n in names), name
    got = sorted((r.doc_id, r.text) for r in docs.collect())
    assert got == sorted([(1, words), (1, words[::-1]), (4, "[SECRET]")])
    packed = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path))
    assert packed.count() == 3 and corpus_pipeline.STAGES[4][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_hand_small_batches_to_their_kernels_and_other_queries_get_theirs_back(spark, tmp_path):
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, f"text {i} " + "some words of it " * 6000, "en", "src") for i in range(40)] + [(40, "one long word " * 200_000, "en", "src")]
    docs = common.materialize(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1))
    want = sorted(len(r[1]) for r in rows)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            n = [len(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.list_(pa.int32()))], names=["n"])

    for name, stage in corpus_pipeline.STAGES:
        common.table(spark, SF, "documents")
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m" and spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096"
        stage(spark, docs.limit(0), str(tmp_path))
        seen = [r.n for r in docs.select("text").mapInArrow(sizes, "n array<int>").collect()]
        assert sorted(n for x in seen for n in x) == want, name
        assert all(sum(x[:-1]) < 1 << 20 for x in seen), name  # the row that fills a batch is its last
    common.table(spark, SF, "documents")


def test_written_tables_can_be_dropped(spark):
    import os

    first, last = common.materialize(spark.range(3)), common.materialize(spark.range(4))
    paths = common._written[-2:]
    common.drop_written(spark, but_last=1)
    assert not os.path.exists(paths[0]) and last.count() == 4 and common._written == paths[1:] and first is not None
    common.drop_written(spark)
    assert not os.path.exists(paths[1])


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names) and set(llm.ORACLE_SQL) <= set(llm.QUERIES)
