"""SimHash near-duplicates through segment bit counts and a grid range join.

A fingerprint's 64 bits are cut into 32 segments of two bits and mapped to the
vector of their bit counts. The Manhattan distance of two such vectors is a
lower bound of the Hamming distance. The vector is kept as a thermometer code
(count 0, 1, 2 as 00, 01, 11), so that Manhattan distance is the bit count of
an exclusive or.

Grid range join: the segments form distance + 3 groups. If the distance is
kept, at least three groups agree whole, so two fingerprints within reach share
a grid cell for at least one choice of three groups. In a cell all pairs are
held against the bound, then against the fingerprints; a cell emits a spanning
forest of its links, never its pairs, so the output is linear in the rows.
Cells with more than cell_rows fingerprints are cut into blocks, and each pair
of blocks is a task of its own.

Exact copies share a fingerprint and are one row from the first aggregation on.

deduplicate links by the similarity of shingle sets: fingerprints give the first
candidates, prefixes of the sets those that 64 bits cannot tell, and every link
is verified on the sets.

Defined cases: null and wordless texts have the fingerprint zero and are linked
like any other; a null id is never a component's id unless all ids in it are
null; repeated rows are kept; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import matching, materialize, released, table, text_chunks
from .components import components

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_PIECE = 4 << 20


def shingle_hashes(text: bytes, words: int = 3, seed: int = 42):
    """XXH64 of every word shingle, as arrays; texts of many megabytes come in pieces."""
    h, tail, at, any_yet = xxhash.xxh64_intdigest, [], 0, False
    while at < len(text):
        end = len(text)
        if end - at > _PIECE:
            m = _SPACE.search(text, at + _PIECE)
            end = m.start() if m else end
        w = tail + text[at:end].lower().split()
        at = end
        if len(w) >= words:
            any_yet = True
            yield np.array([h(b" ".join(s), seed) for s in zip(*(w[i:] for i in range(words)), strict=False)], np.uint64)
            tail = w[len(w) - words + 1 :] if words > 1 else []
        else:
            tail = w
    if not any_yet and tail:
        yield np.array([h(b" ".join(tail), seed)], np.uint64)


def simhash(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint: a bit is 1 if set in over half the hashes."""
    return _bit_majority(shingle_hashes(text, words, seed))


def fingerprints(df: DataFrame, keep: list[str], text_col: str = "text", words: int = 3) -> DataFrame:
    """The kept columns of every row, and ``_fp``, the fingerprint as a BIGINT."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = np.array([simhash(t, words) for _, texts in text_chunks(b.column(0)) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps.view(np.int64))], names=[*b.schema.names[1:], "_fp"])

    fields = [T.StructField(f"_k{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
    found = df.select(F.col(text_col).alias("_text"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep))).mapInArrow(lambda b: released(run(b)), T.StructType([*fields, T.StructField("_fp", T.LongType())]))
    return found.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "_fp")


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("bigint")


_LOW = 0x5555555555555555


def thermometer(fp: Column) -> Column:
    """The per-segment bit counts as a thermometer code: the two bits of each segment, sorted."""
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(_long(_LOW)).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(_long(_LOW)), 1))


def cells(distance: int) -> list[tuple[int, list[int]]]:
    """Of each choice of three groups of segments: its mask, and the masks of the groups that must differ for it to be the first."""
    cut = np.linspace(0, 32, distance + 4).round().astype(int)
    masks = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return [(masks[i] | masks[j] | masks[k], [masks[g] for g in range(k) if g not in (i, j)]) for i, j, k in combinations(range(distance + 3), 3)]


def forest_of_cells(distance: int):
    """mapInArrow function: rows (mask, block, fp, node) sorted by cell and block to the links of a spanning forest of each."""
    masks = np.array([m for m, _ in cells(distance)], np.uint64)
    low, one = np.uint64(_LOW), np.uint64(1)

    def links(key, t, fp):
        n = len(fp)
        root = np.arange(n)
        i = np.flatnonzero((key[1:] == key[:-1]).all(axis=1))
        d, out = 1, []
        while len(i):
            near = i[np.bitwise_count(t[i] ^ t[i + d]) <= distance]
            near = near[np.bitwise_count(fp[near] ^ fp[near + d]) <= distance]
            near = near[root[near] != root[near + d]]
            for a in near:
                x, y = a, a + d
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((a, a + d))
            if len(near):
                while (root[root] != root).any():
                    root = root[root]
            d += 1
            i = i[i + d < n]
            i = i[(key[i] == key[i + d]).all(axis=1)]
        return np.array(out, np.int64).reshape(-1, 2)

    def run(batches):
        import pyarrow as pa

        def emit(rows):
            at = links(rows["key"], rows["t"], rows["fp"])
            return pa.RecordBatch.from_arrays([pa.array(rows["node"][at[:, 0]]), pa.array(rows["node"][at[:, 1]])], names=["u", "v"])

        long = lambda b, c: b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            mask, fp = long(b, "mask"), long(b, "fp").view(np.uint64)
            high = fp >> one
            t = ((fp | high) & low) | ((fp & high & low) << one)
            new = {"key": np.stack([mask.view(np.uint64), t & masks[mask], long(b, "block").view(np.uint64)], axis=1), "t": t, "fp": fp, "node": long(b, "node")}
            held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
            open_ = int(np.flatnonzero((held["key"] == held["key"][-1]).all(axis=1))[0])
            if open_:
                yield emit({c: x[:open_] for c, x in held.items()})
                held = {c: x[open_:] for c, x in held.items()}
        if held is not None:
            yield emit(held)

    return run


def near_links(fps: DataFrame, distance: int = 3, cell_rows: int = 20_000) -> DataFrame:
    """Links (u, v) that connect all distinct rows of fps(fp, node) within the distance, by node."""
    masks = F.array(*(_long(m) for m, _ in cells(distance)))
    cell = thermometer(F.col("fp")).bitwiseAND(F.get(masks, F.col("mask"))).alias("cell")
    gridded = fps.select("fp", "node", F.explode(F.sequence(F.lit(0), F.lit(len(cells(distance)) - 1))).alias("mask"))
    hot = gridded.groupBy("mask", cell).agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).select("mask", "cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("blocks"))
    hot = materialize(hot)
    if hot.isEmpty():
        dealt = gridded.withColumn("block", F.lit(0).cast("bigint"))
    else:
        own = F.pmod(F.xxhash64("fp", "node"), F.col("blocks")).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (F.least(own, j).cast("bigint") * F.col("blocks") + F.greatest(own, j)))
        dealt = gridded.withColumn("cell", cell).join(hot, ["mask", "cell"], "left").select(*gridded.columns, F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(pair)).alias("block"))
    # the cell is worked out where it is needed and not carried along
    dealt = dealt.select("mask", "block", "fp", "node").repartition("mask", cell, "block").sortWithinPartitions("mask", cell, "block")
    return dealt.mapInArrow(lambda b: released(forest_of_cells(distance)(b)), "u bigint, v bigint")


def near_components(prints: DataFrame, distance: int = 3, cell_rows: int = 20_000) -> DataFrame:
    """(fp, component) for the distinct fingerprints of prints(id, fp): the smallest id reachable."""
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(near_links(classes.select("fp", F.col("fp").alias("node")), distance, cell_rows))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rooted.join(least, "root").select("fp", "component")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """(id, fp, component) of every row."""
    prints = materialize(fingerprints(df, [id_col], text_col, words).select(F.col(id_col).alias("id"), F.col("_fp").alias("fp")))
    return prints.join(near_components(prints, distance), "fp").select("id", "fp", "component")


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """The distinct word shingles' hashes, sorted."""
    parts = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def parities(shingles: np.ndarray) -> bytes:
    """A bit for each slot, the parity of the shingles that fall on it; slots are a power of two, 512 or more, one a shingle or more.

    The bits of two sets differ in no more places than the sets do in shingles.
    """
    slots = 1 << max(9, (len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1, bitorder="little").tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of parities, as bytes, for fewer slots."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def least_overlap(similarity: float, sizes):
    """Shared shingles of two sets of so many together (for one set, with itself) at that Jaccard similarity, at least."""
    return np.ceil(similarity / (1 + similarity) * sizes - 1e-9).astype(np.int64)


def _bit_majority(hashes) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for part in hashes:
        for i in range(0, len(part), 1 << 16):
            ones += np.unpackbits(part[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def sketched(df: DataFrame, text_col: str, words: int) -> DataFrame:
    """All columns of every row as ``_k0``.., and of its shingles the fingerprint ``_fp``, a digest of the set (``_d0``, ``_d1``), its size ``_n`` and ``_bits`` (parities)."""
    at = df.columns.index(text_col)
    own = [("_fp", T.LongType()), ("_d0", T.LongType()), ("_d1", T.LongType()), ("_n", T.LongType()), ("_bits", T.BinaryType())]
    fields = [T.StructField(f"_k{i}", f.dataType) for i, f in enumerate(df.schema)] + [T.StructField(c, t) for c, t in own]
    names = [f.name for f in fields]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            digests, fps, sizes, bits = [], [], [], []
            for _, texts in text_chunks(b.column(at)):
                for t in texts:
                    parts = list(shingle_hashes(t, words))
                    h = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                    digests.append(xxhash.xxh128_digest(h.tobytes()))
                    fps.append(_bit_majority(parts))
                    sizes.append(len(h))
                    bits.append(parities(h))
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            cols = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=names)

    return df.mapInArrow(lambda b: released(run(b)), T.StructType(fields))


def shared_shingles(texts: DataFrame, words: int, bucket_entries: int = 1_000_000) -> DataFrame:
    """Rows (node, cell) of texts(node, text, n): each shingle that more than one text holds, as a number of how many hold it (127 at most), a bucket and 32 bits of its hash.

    Most shingles stand in one text only and never leave their bucket. A bucket
    is a range of the hash; what goes to it from a batch is one row of packed
    arrays, six bytes a shingle. Hashes that are the same in these bits count as
    one shingle, which may add a candidate and never loses one.
    """
    total = texts.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_entries))

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            nodes, done = b.column("node").to_numpy(), 0
            for _, found in text_chunks(b.column("text")):
                sets = [shingle_set(t, words) for t in found]
                mine = nodes[done : done + len(found)]
                done += len(found)
                size = np.array([len(x) for x in sets], np.int64)
                if not size.sum():
                    continue
                h, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
                order = np.argsort(h, kind="stable")
                h, of = h[order], of[order]
                bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                key = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                kind = np.uint16 if len(sets) < 1 << 16 else np.uint32
                cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
                rows = [(int(bucket[i]), key[i:j].tobytes(), of[i:j].astype(kind).tobytes(), mine.tobytes()) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                bs, keys, ofs, ns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(bs, pa.int64()), pa.array(keys, pa.binary()), pa.array(ofs, pa.binary()), pa.array(ns, pa.binary())], names=["bucket", "keys", "of", "nodes"])

    def unpack(batches):
        import pyarrow as pa

        def emit(bucket, held):
            key, node = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
            order = np.argsort(key, kind="stable")
            key, node = key[order], node[order]
            first = np.flatnonzero(np.diff(key.astype(np.int64), prepend=-1))
            df = np.diff(np.append(first, len(key)))
            of = np.repeat(df, df)
            keep = np.flatnonzero(of > 1)
            for i in range(0, len(keep), 1 << 18):
                part = keep[i : i + (1 << 18)]
                cell = np.minimum(of[part], 127) << 56 | bucket << 32 | key[part].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node[part]), pa.array(cell)], names=["node", "cell"])

        now, held = None, []
        for b in batches:
            bucket, keys, ofs, ns = b.column("bucket").to_numpy(), b.column("keys"), b.column("of"), b.column("nodes")
            for r in range(b.num_rows):
                if bucket[r] != now:
                    if held:
                        yield from emit(int(now), held)
                    now, held = bucket[r], []
                key, nodes = np.frombuffer(keys[r].as_py(), np.uint32), np.frombuffer(ns[r].as_py(), np.int64)
                of = ofs[r].as_py()
                held.append((key, nodes[np.frombuffer(of, np.uint16 if len(of) == 2 * len(key) else np.uint32)]))
        if held:
            yield from emit(int(now), held)

    packed = texts.select("node", "text").mapInArrow(lambda b: released(pack(b)), "bucket bigint, keys binary, of binary, nodes binary").repartition("bucket").sortWithinPartitions("bucket")
    return packed.mapInArrow(lambda b: released(unpack(b)), "node bigint, cell bigint")


def prefix_cells(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Rows (shingle, n, at, node): the shared shingles in the prefix of each text(node, text, n).

    In any order of all shingles, two sets of at least that similarity share one
    among the first n - ceil(similarity * n) + 1 of each. The order here is by the
    number of texts that hold the shingle. So a text's own shingles, which no
    other has, come first; a text with enough of them has nothing to be compared
    by, and passages that many texts hold come last.
    """
    found = shared_shingles(texts, words).groupBy("node").agg(F.array_sort(F.collect_list("cell")).alias("shared")).join(texts.select("node", "n"), "node")
    own = F.greatest(F.col("n") - F.size("shared"), F.lit(0))
    left = F.least(F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1 - own, F.size("shared").cast("bigint"))
    prefix = F.slice("shared", F.lit(1), F.greatest(left, F.lit(0)).cast("int"))
    cells = found.select("node", "n", own.alias("own"), F.posexplode(prefix).alias("k", "s"))
    return materialize(cells.select(F.col("s").alias("shingle"), "n", (F.col("own") + F.col("k")).alias("at"), "node"))


def pairs_of_cells(similarity: float, forest: bool):
    """mapInArrow function: rows (shingle, block, n, at, node, root, bits) sorted by these to pairs (u, v) of different roots.

    A pair of that similarity passes in the cell of the first shingle that both
    hold: by the sizes, by the places, and by the parities, which differ in no
    more places than the sets do. forest: of each cell only pairs that connect
    what may be alike, so the output is linear in the rows.
    """

    def run(batches):
        import pyarrow as pa

        def emit(x):
            key, n, at, node, root, bits = (x[c] for c in ("key", "n", "at", "node", "root", "bits"))
            tree = np.arange(len(n))
            i, d, ready, size = np.arange(len(n) - 1), 1, [], 0
            while len(i):
                # sizes rise within a cell, so who is too small for the next is too small for all that follow
                i = i[(key[i] == key[i + d]).all(axis=1) & (n[i] >= similarity * n[i + d] - 1e-9)]
                both = n[i] + n[i + d]
                least = least_overlap(similarity, both)
                ok = (np.minimum(n[i] - at[i], n[i + d] - at[i + d]) >= least) & (root[i] != root[i + d])
                if forest:
                    ok &= tree[i] != tree[i + d]
                a = i[ok]
                a = a[np.bitwise_count(bits[a] ^ bits[a + d]).sum(axis=1, dtype=np.int64) <= (both - 2 * least)[ok]]
                if forest and len(a):
                    kept = []
                    for p in a.tolist():
                        u, v = p, p + d
                        while tree[u] != u:
                            u = tree[u]
                        while tree[v] != v:
                            v = tree[v]
                        if u != v:
                            tree[max(u, v)] = min(u, v)
                            kept.append(p)
                    while (tree[tree] != tree).any():
                        tree = tree[tree]
                    a = np.array(kept, np.int64)
                ready.append(np.stack([np.minimum(node[a], node[a + d]), np.maximum(node[a], node[a + d])], axis=1))
                size += len(a)
                if size > 1 << 17:
                    yield np.unique(np.concatenate(ready), axis=0)
                    ready, size = [], 0
                d += 1
                i = i[i + d < len(n)]
            if size:
                yield np.unique(np.concatenate(ready), axis=0)

        held = None
        for b in batches:
            if not b.num_rows:
                continue
            new = {c: b.column(c).to_numpy() for c in ("n", "at", "node", "root")}
            new["key"] = np.stack([b.column("shingle").to_numpy(), b.column("block").to_numpy()], axis=1)
            new["bits"] = np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint64).reshape(b.num_rows, -1)
            held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
            open_ = int(np.flatnonzero((held["key"] == held["key"][-1]).all(axis=1))[0])
            for p in emit({c: x[:open_] for c, x in held.items()}) if open_ else ():
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["u", "v"])
            held = {c: x[open_:] for c, x in held.items()}
        for p in emit(held) if held is not None else ():
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["u", "v"])

    return run


def short_parities(texts: DataFrame) -> DataFrame:
    """(node, bits) of texts(node, bits): parities for 512 slots."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            bits = [folded(np.frombuffer(x, np.uint8).reshape(1, -1), 64).tobytes() for x in b.column("bits").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(bits, pa.binary())], names=["node", "bits"])

    return texts.select("node", "bits").mapInArrow(lambda b: released(run(b)), "node bigint, bits binary")


def candidates(cells: DataFrame, parities_of: DataFrame, similarity: float, forest: bool, cell_rows: int) -> DataFrame:
    """Distinct pairs (u, v) of different roots of cells(shingle, n, at, node, root) that may have that similarity; forest: enough to connect them.

    Cells of more than cell_rows are cut into blocks; a forest is one of each
    block, pairs are taken block by block.
    """
    counted = cells.groupBy("shingle").agg(F.count("*").alias("rows"), F.min("root").alias("least"), F.max("root").alias("greatest"))
    if not forest:
        # a cell of one root has nothing to pair, however large it is
        counted = counted.where("least <> greatest")
        cells = cells.join(counted.select("shingle"), "shingle", "left_semi")
    hot = materialize(counted.where(F.col("rows") > cell_rows).select("shingle", F.ceil(F.col("rows") / cell_rows).cast("int").alias("blocks")))
    zero = F.lit(0).cast("bigint")
    if hot.isEmpty():
        dealt = cells.withColumn("block", zero)
    else:
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (F.least(own, j).cast("bigint") * F.col("blocks") + F.greatest(own, j)))
        dealt = cells.join(hot, "shingle", "left").select(*cells.columns, F.explode(F.when(F.col("blocks").isNull(), F.array(zero)).otherwise(F.array(own.cast("bigint")) if forest else pair)).alias("block"))
    dealt = dealt.join(parities_of, "node").repartition("shingle", "block").sortWithinPartitions("shingle", "block", "n", "node")
    return materialize(dealt.mapInArrow(lambda b: released(pairs_of_cells(similarity, forest)(b)), "u bigint, v bigint").distinct())


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose texts(node, text, n, bits) have that Jaccard similarity of their distinct shingles, exactly.

    The parities refuse most other pairs, and none of these, before sets are joined.
    """

    def possible(batches):
        import pyarrow as pa

        for b in batches:
            keep, n = np.zeros(b.num_rows, bool), b.column("n").to_numpy()
            xs, ys = b.column("xb").to_pylist(), b.column("yb").to_pylist()
            sizes = np.array([(len(x), len(y)) for x, y in zip(xs, ys, strict=True)], np.int64).reshape(-1, 2)
            for wx, wy in np.unique(sizes, axis=0).tolist():
                who = np.flatnonzero((sizes == (wx, wy)).all(axis=1))
                x, y = (np.frombuffer(b"".join(z[i] for i in who.tolist()), np.uint8).reshape(len(who), -1) for z in (xs, ys))
                apart = np.bitwise_count(folded(x, wy) ^ folded(y, wx)).sum(axis=1, dtype=np.int64)
                keep[who] = apart <= n[who] - 2 * least_overlap(similarity, n[who])
            yield b.select(["u", "v"]).filter(pa.array(keep))

    def sets(batches):
        import pyarrow as pa

        for b in batches:
            at = 0
            for _, found in text_chunks(b.column("text")):
                out = pa.array([shingle_set(t, words).tobytes() for t in found], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("node").slice(at, len(found)), out], names=["node", "held"])
                at += len(found)

    def hold(batches):
        import pyarrow as pa

        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for r in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[r].as_buffer(), np.uint64) for c in ("x", "y"))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                keep[r] = np.count_nonzero(both[1:] == both[:-1]) >= least_overlap(similarity, np.array(len(x) + len(y)))
            yield b.select(["u", "v"]).filter(pa.array(keep))

    side = lambda k, c: texts.select(F.col("node").alias(k), F.col("n").alias(f"{c}n"), F.col("bits").alias(f"{c}b"))
    sized = pairs.join(side("u", "x"), "u").join(side("v", "y"), "v").select("u", "v", (F.col("xn") + F.col("yn")).alias("n"), "xb", "yb")
    pairs = materialize(sized.mapInArrow(lambda b: released(possible(b)), "u bigint, v bigint"))
    asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    held = materialize(matching(texts.select("node", "text"), asked, "node", "left_semi").mapInArrow(lambda b: released(sets(b)), "node bigint, held binary"))
    with_u = pairs.join(held.select(F.col("node").alias("u"), F.col("held").alias("x")), "u")
    return materialize(with_u.join(held.select(F.col("node").alias("v"), F.col("held").alias("y")), "v").mapInArrow(lambda b: released(hold(b)), "u bigint, v bigint"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, distance: int = 3, cell_rows: int = 20_000) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id.

    Rows are linked if the Jaccard similarity of their distinct word shingles is
    at least `similarity`, exactly. Rows of one set are one class. Fingerprints
    of the shingles within `distance` give the first candidates, by the grid
    range join; what a fingerprint of 64 bits cannot tell comes from prefixes:
    classes that share a shingle of their prefixes, the rarest shingles of each,
    meet in its cell. Every
    candidate is verified on the sets. A first pass takes from a cell only as many
    pairs as connect it, so that the second, which takes all, need not look
    inside the groups of many copies that the first has joined. Rows are told apart by a number of
    their own, so repeated ids are no matter.

    Texts are not shuffled as long as the rows asked for, or dropped, are few
    enough to be broadcast.
    """
    keys, text = ["_d0", "_d1"], f"_k{docs.columns.index(text_col)}"
    held = materialize(sketched(docs, text_col, words).withColumn("_row", F.monotonically_increasing_id()))
    classes = materialize(held.groupBy(*keys).agg(F.min("_row").alias("node")))
    copies = held.select("_row", *keys).join(classes, keys).where("_row <> node").select("_row")
    of_class = matching(held, copies, "_row", "left_anti")
    texts = of_class.select(F.col("_row").alias("node"), F.col(text).alias("text"), F.col("_n").alias("n"), F.col("_bits").alias("bits"))
    cells = prefix_cells(texts, words, similarity)
    prints = near_links(of_class.select(F.col("_fp").alias("fp"), F.col("_row").alias("node")), distance, cell_rows)
    short = materialize(short_parities(texts))
    asked = prints.union(candidates(cells.withColumn("root", F.col("node")), short, similarity, True, cell_rows)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    links = verified(materialize(asked.distinct()), texts, words, similarity)
    roots = materialize(components(links))
    rooted = cells.join(roots, "node", "left").select(*cells.columns, F.coalesce("root", "node").alias("root"))
    links = links.union(verified(candidates(rooted, short, similarity, False, cell_rows), texts, words, similarity))
    roots = components(links).withColumnRenamed("node", "_node")
    rooted = classes.join(roots, F.col("node") == F.col("_node"), "left").select(*keys, F.coalesce("root", "node").alias("root"))
    key = f"_k{docs.columns.index(id_col)}"
    groups = materialize(held.select("_row", *keys, F.col(key).alias("_id")).join(rooted, keys).select("_row", "_id", "root"))
    least = groups.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("null"), "_id", "_row")).alias("least")).select(F.col("least._row").alias("_row"))
    dropped = groups.select("_row").join(least, "_row", "left_anti")
    return matching(held, dropped, "_row", "left_anti").select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)))


def op4_simhash_dedup(spark, sf_dir):
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
