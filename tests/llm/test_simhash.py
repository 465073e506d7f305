import random
import re

import numpy as np
import xxhash

from docframe.llm import components, simhash


def brute_print(text, words=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(values, distance=3):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprint_equals_brute_force():
    texts = ["", " \n", "one", "Two words", "A b  C\td", "x\u00a0y z É é", "the same the same the same the same", " ".join(f"w{i}" for i in range(2000))]
    assert [simhash.simhash(t.encode()) for t in texts] == [brute_print(t) for t in texts]
    try:
        simhash._PIECE, before = 100, simhash._PIECE
        assert simhash.simhash(texts[-1].encode()) == brute_print(texts[-1])
    finally:
        simhash._PIECE = before


def groups(spark, values, **kw):
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    prints = spark.createDataFrame(signed, "id long, fp long")
    got = prints.join(simhash.near_components(prints, **kw), "fp").select("id", "component").collect()
    return [c for _, c in sorted(map(tuple, got))]


def test_no_link_is_lost(spark):
    rng = random.Random(5)
    values = []
    for _ in range(60):
        v = rng.getrandbits(64)
        values.append(v)
        for _ in range(rng.randrange(6)):
            for b in rng.sample(range(64), rng.randrange(5)):
                v ^= 1 << b
            values.append(v)
    rng.shuffle(values)
    assert groups(spark, values) == brute_groups(values)


def test_hot_cells_are_cut_into_blocks_without_loss(spark):
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    values = [centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a + 1, 64, 7)] + [rng.getrandbits(64) for _ in range(20)] + [0, 0]
    want = brute_groups(values)
    assert groups(spark, values, cell_rows=10) == want == groups(spark, values)


def test_components_of_a_long_path(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(199)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(200)} == {0} and got[1001] == got[1000] == 1000
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_defined_cases(spark):
    schema = "doc_id long, text string, fp int, component string"
    rows = [(7, None, 1, "a"), (3, " ", 2, "b"), (3, " ", 2, "b"), (None, "", 0, ""), (9, "some words that stand alone here", 0, "")]
    got = simhash.simhash_groups(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.id or -1, r.component) for r in got) == [(-1, 3), (3, 3), (3, 3), (7, 3), (9, 9)]
    assert simhash.simhash_groups(spark.createDataFrame([], schema)).count() == 0
    kept = simhash.deduplicate(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.doc_id for r in kept) == [3, 9]


def test_copies_of_similarity_beyond_four_fifths_go_and_others_stay(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randrange(3, 10)))
    texts, near = [[word() for _ in range(300)] for _ in range(30)], []
    for w in texts:
        for _ in range(4):
            copy = list(w)
            for i in rng.sample(range(len(copy)), 4):
                copy[i] = word()
            near.append(copy)
    half = [w[:150] + [word() for _ in range(150)] for w in texts]
    rows = [(i, " ".join(w)) for i, w in enumerate([*texts, *half, *near])]
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), cell_rows=30).collect()}
    assert kept >= set(range(60)) and len(kept) <= 60 + 0.15 * len(near)


def test_query(spark):
    from tests.oracle import SF

    got = {r.doc_id: r for r in simhash.op4_simhash_dedup(spark, SF).collect()}
    docs = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    prints = [brute_print(t) for _, t in docs]
    assert [got[i].fingerprint for i, _ in docs] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i, _ in docs] == [docs[k][0] for k in brute_groups(prints)]
    assert np.unique([r.component_id for r in got.values()]).size < len(docs)


def test_stage_links_exactly_the_pairs_of_four_fifths(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randrange(3, 10)))
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    licence, texts = [word() for _ in range(40)], []
    for n in [3, 7, 20, 60, 90, 150, 200, 400, 700, 1000] * 8:
        base = [word() for _ in range(n)] + licence * (n > 20)
        texts.append(base)
        n, more = len(base), [word() for _ in range(300)]
        for kind in range(4):
            part = rng.uniform(0.02, 0.3)
            copy = list(base)
            if kind == 0:
                copy = base[: int(n * (1 - part))]
            elif kind == 1:
                copy = base + more[: int(n * part)]
            elif kind == 2:
                copy = more[: int(n * part)] + base
            else:
                for i in rng.sample(range(n), max(1, int(n * part / 6))):
                    copy[i] = word()
            texts.append(copy)
    sets = [shingles(w) for w in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    for cell_rows in (20_000, 25):
        kept = {r.doc_id for r in simhash.deduplicate(docs, cell_rows=cell_rows).collect()}
        assert kept == {find(i) for i in range(len(texts))}


def test_every_kernel_gives_memory_back(spark, monkeypatch):
    calls, frame = [], type(spark.range(0))
    real = frame.mapInArrow

    def spy(self, f, *more):
        before = len(calls)
        list(f(iter([])))
        assert len(calls) > before, f
        return real(self, f, *more)

    with monkeypatch.context() as m:
        m.setattr(simhash, "released", lambda batches: calls.append(1) or batches)
        m.setattr(frame, "mapInArrow", spy)
        text = " ".join(f"word{i}" for i in range(60))
        rows = [(i, text + f" end{i % 3}") for i in range(6)] + [(9, "another text")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert simhash.deduplicate(docs).count() == 2
    assert len(calls) > 5
