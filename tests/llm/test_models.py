"""Language ID, quality and language-model scores."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.llm import language_id, lm_score, quality
from tests.oracle import SF


def held(i, n, r):
    return zlib.crc32(str(i).encode()) % n == r


# -- language ID


@pytest.fixture(scope="module")
def net(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text", "lang")
    return language_id.fit(docs, F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)


def test_language_query_on_unseen_rows(spark):
    got = language_id.op1_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    unseen = [r for r in got if r.held_out]
    assert len(got) == len(lang) and all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in unseen]) > 0.9


def test_language_tables_equal_the_network(net):
    rng = np.random.default_rng(0)
    x = rng.integers(97, 123, (5, language_id.WINDOW)).astype(np.uint8)
    x[3, 40:] = 0
    scorer = language_id.Scorer(net)
    got = scorer.windows(np.pad(x, ((0, 0), (0, 3))))
    e = net.embed[np.pad(x, ((0, 0), (0, 3)))]
    pooled = [
        np.stack([e[:, i : i + w].reshape(5, -1) @ f for i in range(language_id.WINDOW)], axis=1).max(axis=1) for w, f in zip(language_id.WIDTHS, net.filters, strict=True)
    ]
    z = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.out + net.out_bias
    assert np.allclose(got, z - np.log(np.exp(z).sum(axis=1, keepdims=True)), atol=1e-4)


def test_language_gradients(net):
    rng = np.random.default_rng(1)
    small = language_id.ByteConv(["a", "b"], seed=3)
    x, y, w = rng.integers(1, 256, (4, 30)).astype(np.uint8), np.array([0, 1, 1, 0]), np.ones(4, np.float32)

    def loss():
        e, pooled = small.embed[x], []
        for k, f in zip(language_id.WIDTHS, small.filters, strict=True):
            pooled.append(np.stack([e[:, i : i + k].reshape(4, -1) @ f for i in range(30 - k + 1)], axis=1).max(axis=1))
        z = np.maximum(np.concatenate(pooled, axis=1) + small.bias, 0) @ small.out + small.out_bias
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(4), y]).mean())

    grads = small.gradients(x, y, w)
    for k, at in ((0, (int(x[0, 3]), 2)), (1, (3, 4)), (3, (7, 1)), (5, (2, 1))):
        p = small.params()[k]
        p[at] += 1e-3
        up = loss()
        p[at] -= 2e-3
        down = loss()
        p[at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[k][at]) < 2e-3


def test_language_defined_cases(spark, net):
    schema = "id long, text string, lang string, _lang int, score int"
    rows = [(1, None, None, 1, 1), (2, "123 !!", "en", 1, 1), (2, "123 !!", "en", 1, 1), (None, "the of and to " * 9000, None, 1, 1), (3, "é", None, 1, 1)]
    got = language_id.predict(spark.createDataFrame(rows, schema), net, ["id"]).collect()
    assert [r._lang for r in got if r.id in (1, 2)] == ["und"] * 3 and all(r._score == 0 for r in got if r.id in (1, 2))
    assert [r._lang for r in got if r.id is None] == ["en"] and [r._lang != "und" for r in got if r.id == 3] == [True]
    empty = spark.createDataFrame([], schema)
    assert language_id.predict(empty, net, ["id"]).count() == 0
    assert language_id.fit(empty, F.lit(True)) is None
    assert {r._lang for r in language_id.predict(spark.createDataFrame(rows, schema), None, ["id"]).collect()} == {"und"}


# -- quality


def test_quality_query_on_unseen_rows(spark):
    got = {r.doc_id: r for r in quality.op3_pu_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    unseen = [(got[i], q) for i, q in labels.items() if got[i].held_out]
    assert all(r.held_out == held(i, 3, 1) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    assert np.mean([r.predicted == q for r, q in unseen]) > 0.9


def test_prior_and_risk_on_known_classes():
    rng = np.random.default_rng(2)
    make = lambda n, at: rng.normal(at, 1, (n, 6))
    pos, unl = make(1500, 1.5), np.concatenate([make(900, 1.5), make(600, -1.5)])[rng.permutation(1500)]
    assert abs(quality.estimate_prior(pos, unl) - 0.6) < 0.08
    net, _ = quality.train(pos, unl)
    assert (net(make(500, 1.5)) > 0).mean() > 0.95 and (net(make(500, -1.5)) < 0).mean() > 0.95


def test_quality_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "x " * 100_000)], "id long, text string")
    net, _ = quality.fit(docs, spark.createDataFrame([], "id long"), F.lit(True))
    assert net is None and {r.score for r in quality.score(docs, None).collect()} == {0.5}
    some = quality.Network(quality.WIDTH, 4)
    got = quality.score(docs, some).collect()
    assert len(got) == 3 and len({r.score for r in got if r.id == 1}) == 1
    assert quality.score(docs.limit(0), some).count() == 0


# -- partial matching


def brute_ppm(train, text, order=lm_score.ORDER):
    most = lm_score.ORDER
    counts = [{} for _ in range(most + 1)]
    for t in train:
        s = [256] * most + list(t) + [256]
        for i in range(most, len(s)):
            for k in range(most + 1):
                counts[k].setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    total, s = 0.0, [256] * most + list(text) + [256]
    for i in range(most, len(s)):
        p, out = 1.0, set()
        for k in range(order, -1, -1):
            c = {a: n for a, n in counts[k].get(tuple(s[i - k : i]), {}).items() if a not in out}
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if s[i] in c:
                p *= c[s[i]] / (n + d)
                break
            p, out = p * d / (n + d), out | set(c)
        else:
            p /= 257 - len(out)
        total += math.log10(p)
    return total


def as_arrow(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


TRAIN = [b"the cat sat on the mat", b"a cat is a cat", b"", b"mats are flat", "é€".encode()]
TEXTS = [b"the cat", b"", b"zebra!", b"cat mat the flat aaa", b"\xff\x00xyz", b"the cat sat on the mat"]


def test_trie_equals_brute_force_and_sums_to_one():
    code, n = lm_score.grams(*as_arrow(TRAIN))
    trie, size = lm_score.ByteTrie(code, n), lm_score.SYMBOLS
    want = [brute_ppm(TRAIN, t) for t in TEXTS]
    assert np.allclose(lm_score.text_scores(*as_arrow(TEXTS), trie.log_p), want, atol=1e-9)
    # the same from parts: contexts of up to two symbols shared, the others by their last three
    low = lm_score.ByteTrie(*lm_score.merged([(code % size**3, n)]), 2)
    part = code // size % size**3 % 7
    tries = [lm_score.ByteTrie(code[part == k], n[part == k], lm_score.ORDER, low) for k in range(7)]

    def of_parts(asked):
        mine, out = asked // size % size**3 % 7, np.zeros(len(asked))
        for k, t in enumerate(tries):
            out[mine == k] = t.log_p(asked[mine == k])
        return out

    assert np.allclose(lm_score.text_scores(*as_arrow(TEXTS), of_parts), want, atol=1e-9)
    for context in (b"ra ca", b"xthe ", b"zzzzt", b"cat i", b"xq\x00\xffz"):
        base = 0
        for c in context:
            base = base * size + c
        assert abs((10.0 ** trie.log_p(base * size + np.arange(size))).sum() - 1) < 1e-9
    nothing = lm_score.ByteTrie(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert np.allclose(lm_score.text_scores(*as_arrow([b"ab"]), nothing.log_p), -3 * math.log10(257))


def test_index_finds_every_key_and_no_other():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 53, 20_000))
    index, asked = lm_score.Index(keys), np.concatenate([keys[::-1], keys + 1, [0]])
    want = np.searchsorted(keys, asked).clip(max=len(keys) - 1)
    assert np.array_equal(index.find(asked), np.where(keys[want] == asked, want, -1))
    assert lm_score.Index(keys[:0]).find(asked[:3]).tolist() == [-1, -1, -1]
    assert lm_score.merged([(keys[:0], keys[:0])])[0].tolist() == [] and lm_score.merged([(keys[:3], keys[:3]), (keys[1:3], keys[:2])])[1].tolist() == [keys[0], keys[1] + keys[0], keys[2] + keys[1]]


def test_memory_of_a_block_is_bounded():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = [bytes(rng.choice(np.frombuffer(b"abcdefgh ", np.uint8), 4_000)) for _ in range(2_000)]  # 8 MB
    batch = pa.RecordBatch.from_pydict({"block": pa.array([0] * 2_000, pa.int64()), "learn": [True] * 2_000, "text": [t.decode() for t in texts]})
    tracemalloc.start()
    try:
        lists = pa.Table.from_batches([r for r in lm_score._count(1)(iter([batch])) if r.column("bucket")[0].as_py() >= 0 and r.column("kind")[0].as_py() < lm_score.SHORT])
        counting = tracemalloc.get_traced_memory()[1]
        values = [np.frombuffer(v.as_py(), np.int64) for v in lists.column("values")]
        answers = [(v if k == lm_score.WORDS else np.log10(0.5 / v)).tobytes() for k, v in zip(lists.column("kind").to_pylist(), values, strict=True)]
        lists = lists.set_column(lists.schema.get_field_index("values"), "values", pa.array(answers, pa.binary()))
        tracemalloc.reset_peak()
        got = lm_score._score(1)(pa.table({"id": range(2_000), "learn": batch.column("learn"), "text": batch.column("text")}), lists)
        scoring = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.num_rows == 2_000 and got.column("n_tokens").to_pylist() == [len(t.split()) + 1 for t in texts]
    assert max(counting, scoring) < 260e6, (counting, scoring)


def test_scores_equal_brute_force(spark):
    schema = "doc_id long, text string, block string, learn string, total int"
    rows = [(i, t.decode("latin1"), "b", "l", 0) for i, t in enumerate(TRAIN + TEXTS)] + [(None, None, "", "", 0), (3, "A b\x0bA", "", "", 0), (3, "A b\x0bA", "", "", 0)]
    df = spark.createDataFrame(rows, schema)
    found, n, v = lm_score.lm_scores(df, F.coalesce(F.col("doc_id") < 6, F.lit(False)), block_bytes=20, most_buckets=3)
    train = [(t or "").encode() for i, t, *_ in rows if i is not None and i < 6]
    words = Counter(w for t in train for w in [*t.lower().split(), b"\n"])
    assert (n, v) == (sum(words.values()), len(words))
    want = []
    for i, t, *_ in rows:
        w = [*(t or "").encode().lower().split(), b"\n"]
        want.append((-1 if i is None else i, len(w), sum(words[x] > 0 for x in w), round(sum(math.log10(words[x] + 0.5) for x in w), 9), round(brute_ppm(train, (t or "").encode()), 6)))
    got = [(-1 if r.id is None else r.id, r.n_tokens, r.n_known, round(r.word_log, 9), round(r.score, 6)) for r in found.collect()]
    assert sorted(got) == sorted(want)


def test_scores_do_not_depend_on_blocks_and_buckets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    runs = []
    for layout in ({}, {"block_bytes": 30_000, "most_buckets": 5}):
        found, n, v = lm_score.lm_scores(docs, F.col("doc_id") % 5 != 1, **layout)
        runs.append((n, v, sorted((r.id, r.n_tokens, r.n_known, round(r.word_log, 6), round(r.score, 6)) for r in found.collect())))
    assert runs[0] == runs[1]


def test_a_long_text_is_scored_whole(spark):
    text = "lorem ipsum dolor " * 400_000
    df = spark.createDataFrame([(1, "lorem ipsum dolor "), (2, text), (3, " " * 5_000_000), (4, "z" * 5_000_000)], "doc_id long, text string")
    found, _, _ = lm_score.lm_scores(df, F.col("doc_id") == 1)
    got = {r.id: r for r in found.collect()}
    assert got[2].n_tokens == 1_200_001 and got[2].n_known == got[2].n_tokens and got[3].n_tokens == 1 and got[4].n_tokens == 2
    assert got[4].score < got[2].score < 0


def test_score_of_an_empty_table(spark):
    found, n, v = lm_score.lm_scores(spark.createDataFrame([], "doc_id long, text string"), F.lit(True))
    assert found.count() == 0 and (n, v) == (0, 0)


def test_score_query(spark):
    got = lm_score.op10_lm_score(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id, 5, 1) and r.score < 0 and r.base_score < 0 for r in got)
