"""Benchmark decontamination by CGK embedding and bit-sampling LSH, verified by edit distance.

The CGK walk reads a string from a start: step j emits the current byte and
moves on or stays by a random bit of (j, byte). Strings with few edits emit
sequences of small Hamming distance, since walks that an edit has parted meet
again. Sampling a few emitted positions and hashing them is then an LSH for
edit distance; several walks raise the recall.

Walks start wherever a byte pair belongs to a fixed random subset of all pairs,
in items and documents alike, so neither words nor offsets matter and text
without spaces is read like any other. The longer an item, the more of a walk's
samples make its signature (LEVELS): the shorter ones have fewer starts that
could agree and take shorter signatures. A document's walk stops as soon as the
bytes sampled so far begin no item's signature.

A collision fixes the item-sized window around it. There the edit distances of
the item's 64-byte pieces to the best substrings add up to a lower bound of the
item's distance, worked out for many windows at once; what the bound leaves is
judged by the exact distance of the item to the best substring, and kept if the
similarity (1 - distance / item length) is high enough.

Recall against brute force at similarity 0.8, by item length and edit rate, is
held by the tests: at least 0.9 from 24 bytes on. Shorter items, and items with
few starts, are found without loss by the parts that the edits allowed must
leave whole.

Texts and items are compared with A-Z lower-cased and white space collapsed.
Distinct items go to the tasks as broadcasts of block_bytes of text at most;
each such block is one more pass over the documents.

Defined cases: null, empty and repeated items and texts match nothing and are
no error (a repeated item is reported for each of its ids); rows with a null
document id are reported with it; texts of any length are read whole, in
pieces of a few megabytes unless one text is longer; empty tables give an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, released, table, text_chunks

SIMILARITY, WALKS, SPAN = 0.8, 4, 32
#: (least item bytes, samples that make the signature); the first 8 samples lie in 16 steps, 12 in 24, 15 in 32.
LEVELS = ((24, 8), (40, 12), (90, 15))
#: Share of byte pairs that begin a walk.
DENSITY = 0.3
#: Samples after which walks are held against the items' signatures so far.
_CHECKS = (5, 8, 12, 15)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20
_STRIDE = 16
#: Pieces whose position masks are kept at a time.
_MASKS = 16_384


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def allowed(size, similarity: float):
    """Edits that an item of that many bytes may have."""
    return ((1 - similarity) * np.asarray(size) + 1e-9).astype(np.int64)


class Walk:
    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.moves = rng.integers(0, 2, (SPAN, 256)).astype(np.int32)
        some = lambda a, b, n: a + rng.choice(b - a, n, replace=False)
        self.samples = np.sort(np.concatenate([[0], some(1, 16, 7), some(16, 24, 4), some(24, SPAN, 3)]))

    def run(self, text: np.ndarray, at: np.ndarray, check):
        """Walks from positions at; check(n, signatures, positions, starts) after n samples says who goes on."""
        i, sig, n = at.astype(np.int32), np.zeros(len(at), np.uint64), 0
        start = i
        for j in range(int(self.samples[-1]) + 1):
            c = text[i]
            if j == self.samples[n]:
                sig = (sig ^ c) * _MIX
                sig ^= sig >> np.uint64(29)
                n += 1
                if n in _CHECKS:
                    go = check(n, sig, i, start)
                    if go is not None:
                        start, i, sig, c = start[go], i[go], sig[go], c[go]
                        if not len(i):
                            return
            i = i + self.moves[j][c]


def walks() -> list[Walk]:
    return [Walk(1000 + k) for k in range(WALKS)]


_BEGINS = np.random.default_rng(77).random(1 << 16) < DENSITY


def starts_of(text: np.ndarray) -> np.ndarray:
    """Positions where walks begin."""
    return np.flatnonzero(_BEGINS[text[:-1].astype(np.uint16) << 8 | text[1:]])


def _slot(sig: np.ndarray) -> np.ndarray:
    return (sig >> np.uint64(64 - _SLOTS)).astype(np.int64)


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All indices of ranges lo..hi, and the range that each belongs to."""
    n = hi - lo
    return np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(np.arange(len(n)), n)


class Items:
    """Distinct normalised items: their signatures for all walks, the parts of the short ones, their pieces."""

    def __init__(self, items: list[tuple[object, bytes]], similarity: float = SIMILARITY):
        self.similarity = similarity
        self.ids, self.texts = [k for k, _ in items], [normal(t) for _, t in items]
        self.size = np.array([len(t) for t in self.texts] + [0], np.int64)
        self.most = allowed(self.size, similarity)
        pad = b"\0" * (SPAN + 1)
        joined = np.frombuffer(b"\0" + pad.join([*self.texts, b""]) + pad, np.uint8)
        self.first = np.cumsum([1, *(len(t) + len(pad) for t in self.texts)])
        self.level = np.searchsorted([least for least, _ in LEVELS], self.size, side="right") - 1
        starts = starts_of(joined)
        item = np.maximum(np.searchsorted(self.first, starts, side="right") - 1, 0)
        inside = (starts >= self.first[item]) & (starts < self.first[item] + self.size[item])
        starts, item = starts[inside], item[inside]
        self.level[np.bincount(item, minlength=len(self.size)) * 8 < self.size] = -1
        self.level[-1] = -1
        starts, item = starts[self.level[item] >= 0], item[self.level[item] >= 0]
        self.walks, self.tables, self.begin = walks(), [], []
        for w in self.walks:
            tables, begin = {}, {n: np.zeros(1 << _SLOTS, bool) for n in _CHECKS}

            def note(n, sig, i, start, tables=tables, begin=begin):
                of = np.searchsorted(self.first, start, side="right") - 1
                begin[n][_slot(sig)] = True
                for level, (_, samples) in enumerate(LEVELS):
                    if samples == n:
                        # the first place of a signature in an item stands for all: runs of one byte do not multiply
                        mine = (self.level[of] == level) & (i < self.first[of] + self.size[of])
                        order = np.lexsort((start[mine], of[mine], sig[mine]))
                        s, k, at = sig[mine][order], of[mine][order], start[mine][order]
                        new = np.ones(len(s), bool)
                        new[1:] = (s[1:] != s[:-1]) | (k[1:] != k[:-1])
                        tables[n] = s[new], k[new].astype(np.int32), (at - self.first[k])[new].astype(np.int32)
                return None if n < LEVELS[0][1] else self.level[of] > [samples for _, samples in LEVELS].index(n)

            w.run(joined, starts, note)
            self.tables.append(tables)
            self.begin.append(begin)
        self._parts()
        self.pieces = [(k, o) for k in range(len(self.texts)) for o in range(0, len(self.texts[k]), 64)]
        self.piece_of = np.cumsum([0, *(-(-len(t) // 64) for t in self.texts)])
        self.row, self.masks = {}, np.zeros((0, 257), np.uint64)
        self.eq: dict[int, dict[int, int]] = {}

    def _parts(self) -> None:
        """For items without walks, by part length (4 bytes at most): sorted codes of the parts, their items and offsets."""
        found: dict[int, list] = {}
        for k, t in enumerate(self.texts):
            if t and self.level[k] < 0:
                n = int(self.most[k]) + 1
                cut = [len(t) * i // n for i in range(n + 1)]
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    size = min(b - a, 4)
                    found.setdefault(size, []).append((int.from_bytes(t[a : a + size], "big"), k, a))
        self.parts = {size: np.array(sorted(rows), np.int64) for size, rows in found.items()}

    def hits(self, text: np.ndarray) -> np.ndarray:
        """Rows (position, item, offset in the item) of every collision."""
        out, starts = [], starts_of(text)
        for w, tables, begin in zip(self.walks, self.tables, self.begin, strict=True):
            if not any(len(t[0]) for t in tables.values()):
                continue

            def check(n, sig, i, start, tables=tables, begin=begin):
                go = begin[n][_slot(sig)]
                if n in tables and len(tables[n][0]):
                    held, item, off = tables[n]
                    maybe = np.flatnonzero(go)
                    lo, hi = np.searchsorted(held, sig[maybe], "left"), np.searchsorted(held, sig[maybe], "right")
                    at, of = _spread(lo, hi)
                    out.append(np.stack([start[maybe][of], item[at], off[at]], axis=1).astype(np.int64))
                return go

            for i in range(0, len(starts), 1 << 18):
                w.run(text, starts[i : i + (1 << 18)], check)
        for size, rows in self.parts.items():
            code = np.zeros(len(text) - size + 1, np.uint32)
            for j in range(size):
                code = code << np.uint32(8) | text[j : len(text) - size + 1 + j]
            held = rows[:, 0].astype(np.uint32)
            table = np.zeros(1 << 16, bool)
            fold = lambda c: (c ^ c >> np.uint32(16)) & np.uint32(0xFFFF)
            table[fold(held)] = True
            maybe = np.flatnonzero(table[fold(code)])
            lo, hi = np.searchsorted(held, code[maybe], "left"), np.searchsorted(held, code[maybe], "right")
            at, of = _spread(lo, hi)
            out.append(np.stack([maybe[of], rows[at, 1], rows[at, 2]], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 3), np.int64)

    def masks_of(self, pieces: np.ndarray) -> np.ndarray:
        """Rows of position masks for pieces, built when first asked for."""
        asked = np.unique(pieces)
        if len(self.row) + len(asked) > _MASKS:
            self.row, self.masks = {}, np.zeros((0, 257), np.uint64)
        new = [p for p in asked.tolist() if p not in self.row]
        if new:
            rows = np.zeros((len(new), 257), np.uint64)
            for r, p in zip(rows, new, strict=True):
                k, o = self.pieces[p]
                part = np.frombuffer(self.texts[k], np.uint8)[o : o + 64]
                np.bitwise_or.at(r, part, np.uint64(1) << np.arange(len(part), dtype=np.uint64))
                self.row[p] = len(self.row)
            if len(self.row) > len(self.masks):
                self.masks = np.concatenate([self.masks, np.zeros((max(len(self.masks), 1024, len(self.row)), 257), np.uint64)])
            self.masks[len(self.row) - len(new) : len(self.row)] = rows
        return np.array([self.row[p] for p in asked.tolist()])[np.searchsorted(asked, pieces)]

    def distance(self, k: int, window: bytes) -> int:
        """Smallest edit distance of item k to any substring of the window."""
        text = self.texts[k]
        if k not in self.eq:
            eq: dict[int, int] = {}
            for i, c in enumerate(text):
                eq[c] = eq.get(c, 0) | 1 << i
            self.eq[k] = eq
        return infix_distance(self.eq[k], len(text), window)

    def bounds(self, item: np.ndarray, begin: np.ndarray, end: np.ndarray, text: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Sums of the pieces' distances in windows begin..end (of the whole item, within left..right of the text).

        Never more than the item's distance, and the same for items of one piece; counting ends beyond the edits allowed.
        """
        total, live, piece = np.zeros(len(item), np.int64), np.arange(len(item)), 0
        slack = end - begin - self.size[item]
        while len(live):
            live = live[(self.piece_of[item[live]] + piece < self.piece_of[item[live] + 1]) & (total[live] <= self.most[item[live]])]
            for i in range(0, len(live), 4096):
                who = live[i : i + 4096]
                k = item[who]
                size = np.minimum(64, self.size[k] - 64 * piece)
                a = begin[who] + 64 * piece
                a, b = np.maximum(a, left[who]), np.minimum(a + size + slack[who], right[who])
                total[who] += self._piece_distance(self.masks_of(self.piece_of[k] + piece), size, text, a, b)
            piece += 1
        return total

    def _piece_distance(self, row, size, text, a, b) -> np.ndarray:
        """Bit-parallel distances of pieces (mask rows, sizes) to the best substrings of text[a:b], all at once."""
        one, masks = np.uint64(1), self.masks.reshape(-1)
        row, top = row * 257, (size - 1).astype(np.uint64)
        pv, mv = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), np.uint64)
        now = size.copy()
        best = now.copy()
        for j in range(int((b - a).max(initial=0))):
            at = a + j
            c = np.where(at < b, text[np.minimum(at, len(text) - 1)], 256)
            e = masks[row + c]
            xv = e | mv
            xh = (((e & pv) + pv) ^ pv) | e
            ph = mv | ~(xh | pv)
            mh = pv & xh
            now += ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
            np.minimum(best, now, out=best)
            ph <<= one
            mh <<= one
            pv = mh | ~(xv | ph)
            mv = ph & xv
        return best


def infix_distance(eq: dict[int, int], m: int, window: bytes) -> int:
    """Myers' bit-parallel edit distance of a pattern (its position masks and length) to the best substring."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, now = mask, 0, m
    best = m
    for c in window:
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            now += 1
        elif mh & top:
            now -= 1
            if now < best:
                best = now
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
    return best


def leaks_in(texts: list[bytes], items: Items) -> list[tuple[int, int, int]]:
    """(text, item, distance) of the items that texts hold, the least distance of each pair."""
    pad = b"\0" * (SPAN + 1)
    plain = [normal(t) for t in texts]
    joined = b"\0" + pad.join([*plain, b""]) + pad
    buffer = np.frombuffer(joined, np.uint8)
    first, size = np.cumsum([1, *(len(t) + len(pad) for t in plain)]), np.array([len(t) for t in plain] + [0])
    hits = items.hits(buffer)
    if not len(hits):
        return []
    text = np.maximum(np.searchsorted(first, hits[:, 0], side="right") - 1, 0)
    # one window for the collisions of an item and a text that are at most _STRIDE bytes apart
    gap = int(items.size.max()) + _STRIDE
    place = (hits[:, 0] - hits[:, 2] + gap + text * gap) // _STRIDE
    _, at = np.unique(hits[:, 1] << 42 | place, return_index=True)
    text, item, place = text[at], hits[at, 1], place[at]
    near = place * _STRIDE - gap - text * gap
    keep = text < len(plain)
    order = np.argsort(items.size[item[keep]], kind="stable")
    text, item, near = text[keep][order], item[keep][order], near[keep][order]
    left, right, most = first[text], first[text] + size[text], items.most[item]
    begin, end = near - most, near + _STRIDE + items.size[item] + most
    bound = items.bounds(item, begin, end, buffer, left, right)
    found: dict[tuple[int, int], int] = {}
    for n in np.flatnonzero(bound <= most).tolist():
        t, k, d = int(text[n]), int(item[n]), int(bound[n])
        before = found.get((t, k))
        if before is not None and before <= d:
            continue
        if items.size[k] > 64:
            d = items.distance(k, joined[max(int(left[n]), int(begin[n])) : min(int(right[n]), int(end[n]))])
        if d <= most[n] and (before is None or d < before):
            found[t, k] = d
    return [(t, k, d) for (t, k), d in sorted(found.items())]


def distinct_items(benchmark: DataFrame, item_text: str) -> DataFrame:
    """(number, text) of the distinct texts of the benchmark that are not empty."""
    asked = benchmark.select(F.col(item_text).alias("text")).where("length(text) > 0").distinct()
    return materialize(asked.withColumn("number", F.monotonically_increasing_id()).select("number", "text"))


def _blocks(items: DataFrame, block_bytes: int):
    """Broadcasts of the distinct items, block_bytes of text or one item in each; the driver keeps none of them."""
    spark = items.sparkSession
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    for block in range(blocks):
        held = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).toArrow()
        yield spark.sparkContext.broadcast((held.column("number").to_pylist(), [t.encode() for t in held.column("text").to_pylist()]))


def _leaks_of(column, items: Items) -> np.ndarray:
    """Rows (row, item, distance) of an Arrow column of texts."""
    rows = [(i + t, k, d) for i, texts in text_chunks(column) for t, k, d in leaks_in(texts, items)]
    return np.array(rows, np.int64).reshape(-1, 3)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
               similarity: float = SIMILARITY, block_bytes: int = 4 << 20) -> DataFrame:
    """(id, item, distance, similarity) of each pair of a document and an item that it holds."""
    kind, distinct, out = dict(docs.dtypes)[id_col], distinct_items(benchmark, item_text), None
    for shipped in _blocks(distinct, block_bytes):

        def run(batches, shipped=shipped):
            import pyarrow as pa

            items = Items(list(zip(*shipped.value, strict=True)), similarity)
            ids = np.array([*items.ids, 0], np.int64)
            for b in batches:
                cols = _leaks_of(b.column(1), items)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(cols[:, 0])), pa.array(ids[cols[:, 1]]), pa.array(cols[:, 2].astype(np.int32)), pa.array(1 - cols[:, 2] / np.maximum(items.size, 1)[cols[:, 1]])],
                    names=["id", "number", "distance", "similarity"],
                )

        found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda b, run=run: released(run(b)), f"id {kind}, number bigint, distance int, similarity double")
        out = found if out is None else out.union(found)
    named = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).join(distinct, "text").select("number", "item")
    return out.join(named, "number").select("id", "item", "distance", "similarity")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text", similarity: float = SIMILARITY, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of docs whose text holds no item; nothing of docs is shuffled."""
    at = docs.columns.index(text_col)
    for shipped in _blocks(distinct_items(benchmark, item_text), block_bytes):

        def run(batches, shipped=shipped):
            import pyarrow as pa

            items = Items(list(zip(*shipped.value, strict=True)), similarity)
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[_leaks_of(b.column(at), items)[:, 0]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(lambda b, run=run: released(run(b)), docs.schema)
    return docs


def op9_decontaminate(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "distance", "similarity")
