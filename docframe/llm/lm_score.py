"""Language-model scores: prediction by partial matching over bytes, and a word unigram base.

The model is a trie of byte contexts. A symbol seen in a context has its count
over the context's total plus its distinct symbols; the rest is the escape,
which goes to the context one byte shorter with the symbols already refused
excluded. Below the empty context all symbols never seen share what is left.
A text starts after as many boundary symbols as the order and ends with one.
As the trained model is static, what a context's escape and exclusions come to
is worked out once; a byte whose string was seen costs one look-up.

Counts come from all training rows, and no table of the model is ever in one
place. Texts are dealt to blocks by hash. A block lists its distinct words and
byte strings with their training counts; the lists go to buckets, words by
hash, strings by the last three bytes of their context, so that a bucket holds
every string of its contexts of that length and more. A bucket sums its counts,
builds its part of the trie and answers the blocks' lists: the corpus count of
each word, the log probability of each string. Each block then adds up its
texts. Only contexts of up to two bytes are shared by all buckets: their
strings are at most 257^3 by the alphabet (12 bytes each), some thousands in
text. Lists travel as packed arrays.

Defined cases: null texts are empty, one end token; repeated rows are counted
and scored each; without training rows every word count is 0 and every byte has
1/257; texts of any length are scored whole; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, fold, give_back, materialize, released, table, utf8

#: Symbols: 256 bytes and the boundary.
EDGE, SYMBOLS, ORDER = 256, 257, 5
#: Order of the contexts that all buckets share; strings are dealt by one symbol more.
SHARED = 2
#: Kinds of lists.
WORDS, STRINGS, SHORT = 0, 1, 2
#: Bytes of text that are worked on at once: each takes some 60 more meanwhile.
_SLICE = 1 << 20
_LIST = 250_000
#: Keys that wait for a merge.
_WAITING = 1_000_000


def symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries around each text (ORDER before, one after), and where each text's stretch starts."""
    size = np.diff(at)
    start = np.concatenate([[0], np.cumsum(size + ORDER + 1)])
    out = np.full(start[-1], EDGE, np.uint16)
    out[np.arange(len(data)) + np.repeat(np.arange(len(size)) * (ORDER + 1) + ORDER, size)] = data
    return out, start


def _slices(at: np.ndarray):
    """Ranges of texts of about _SLICE bytes."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + _SLICE, side="right")) - 1)
        yield i, j
        i = j


def _codes(s: np.ndarray) -> np.ndarray:
    """Of every place from ORDER on, the symbol there after the ORDER before it, as one number."""
    code = s[: len(s) - ORDER].astype(np.int64)
    for k in range(1, ORDER + 1):
        code = code * SYMBOLS + s[k : len(s) - ORDER + k]
    return code


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all contexts of ORDER symbols with the next one, and their counts."""
    s, start = symbols(data, at)
    if len(s) <= ORDER:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = _codes(s)
    real = np.ones(len(code), bool)  # the last symbol is none of the boundaries before a text
    for k in range(ORDER):
        ends = start[:-1] + k - ORDER
        real[ends[ends >= 0]] = False
    return np.unique(code[real], return_counts=True)


class Index:
    """Places of integer keys, by hash tables: what collides in one goes to the next."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables, place = keys, [], np.arange(len(keys), dtype=np.int32)
        while len(place):
            bits = max(4, int(2 * len(place)).bit_length())
            mix = np.uint64((0x9E3779B97F4A7C15 + 0xD1342543DE82EF94 * len(self.tables)) & 0xFFFFFFFFFFFFFFFF | 1)
            slot = ((keys[place].astype(np.uint64) * mix) >> np.uint64(64 - bits)).astype(np.int64)
            places = np.full(1 << bits, -1, np.int32)
            places[slot] = place  # one of those that meet stays
            self.tables.append((mix, np.uint64(64 - bits), places))
            place = place[places[slot] != place]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places, -1 for keys that are none."""
        out, todo = np.full(len(keys), -1, np.int32), None
        for mix, shift, places in self.tables:
            k = keys if todo is None else keys[todo]
            at = places[((k.astype(np.uint64) * mix) >> shift).astype(np.int64)]
            there, same = at >= 0, self.keys[at] == k
            hit, clash = np.flatnonzero(there & same), np.flatnonzero(there & ~same)
            out[hit if todo is None else todo[hit]] = at[hit]
            todo = clash if todo is None else todo[clash]
            if not len(todo):
                break
        return out


class ByteTrie:
    """log10 P(symbol | context), from counts of codes of an order's contexts with their symbols.

    Kept for each order: the logarithm of each string's count, and of each
    context its own escape and, for who escaped from it, the share of one count
    and the escape among the shorter context's symbols that it has not. A
    string that was seen at the greatest order is one look-up.

    base: a trie of a lower order whose levels are taken over. Then the codes
    may be those of some contexts only, whole for each context of one symbol
    more than the base's order.
    """

    def __init__(self, code: np.ndarray, count: np.ndarray, order: int = ORDER, base: ByteTrie | None = None):
        self.order, self.levels, last = order, [], None
        if base is not None:
            self.levels, last, self.novel = list(base.levels), base.last, base.novel
        with np.errstate(divide="ignore", invalid="ignore"):
            for k in range(len(self.levels), order + 1):
                strings, at = np.unique(code % SYMBOLS ** (k + 1), return_inverse=True)
                n = np.bincount(at, weights=count, minlength=len(strings))
                contexts, of = np.unique(strings // SYMBOLS, return_inverse=True)
                total, kinds = np.bincount(of, weights=n, minlength=len(contexts)), np.bincount(of, minlength=len(contexts))
                level = {"strings": Index(strings), "contexts": Index(contexts), "log_n": np.log10(n), "log_p": np.log10(n / (total + kinds)[of]), "escape": np.log10(kinds / (total + kinds))}
                if k:
                    up = np.searchsorted(last[0], strings % SYMBOLS**k)  # the same symbol after the shorter context
                    parent = np.searchsorted(last[2], contexts % SYMBOLS ** (k - 1))
                    rest = last[3][parent] - np.bincount(of, weights=last[1][up], minlength=len(contexts))
                    new = last[4][parent] - kinds
                    level["one"] = -np.log10(rest + new)
                    level["further"] = np.where(new > 0, np.log10(new / (rest + new)), 0.0)
                else:
                    self.novel = -np.log10(max(1, SYMBOLS - len(strings)))
                last = strings, n, contexts, total, kinds
                self.levels.append(level)
        self.last = last

    def log_p(self, code: np.ndarray) -> np.ndarray:
        """Of codes of the trie's order."""
        top = self.levels[self.order]
        at = top["strings"].find(code)
        out = top["log_p"][at] if len(top["log_p"]) else np.zeros(len(code))
        rest = np.flatnonzero(at < 0)
        out[rest] = self._unseen(code[rest])
        return out

    def _unseen(self, code: np.ndarray) -> np.ndarray:
        out, live = np.zeros(len(code)), np.arange(len(code))
        above = np.full(len(code), -1, np.int64)  # the longer context that was escaped from, if any was seen
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            string, context = level["strings"].find(code[live] % SYMBOLS ** (k + 1)), level["contexts"].find(code[live] // SYMBOLS % SYMBOLS**k)
            entered, seen = above[live] >= 0, string >= 0
            begin = ~entered & (context >= 0)
            out[live[begin & seen]] = level["log_p"][string[begin & seen]]
            out[live[begin & ~seen]] = level["escape"][context[begin & ~seen]]
            if k < self.order:
                longer = self.levels[k + 1]
                hit, miss = entered & seen, entered & ~seen
                out[live[hit]] += level["log_n"][string[hit]] + longer["one"][above[live[hit]]]
                out[live[miss]] += longer["further"][above[live[miss]]]
            above[live] = context
            live = live[~(seen & (entered | begin))]
        out[live] += self.novel
        return out


def text_scores(data: np.ndarray, at: np.ndarray, log_p) -> np.ndarray:
    """log10 probability of each text, given log_p of codes."""
    out = np.zeros(len(at) - 1)
    for i, j in _slices(at):
        s, start = symbols(data[at[i] : at[j]], at[i : j + 1] - at[i])
        logp = np.zeros(len(s))
        logp[ORDER:] = log_p(_codes(s))
        for k in range(ORDER):
            logp[start[:-1] + k] = 0
        out[i:j] = np.add.reduceat(logp, start[:-1])
    return out


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not sum(len(c) for c, _ in parts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, n = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]).astype(np.int64)
    order = np.argsort(key, kind="stable")  # the parts are sorted
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def _row(kind: int, bucket: int, block: int, keys, values: np.ndarray, counts: np.ndarray | None = None):
    """A list as a record batch of one row; keys are words, or sorted integers that travel as differences."""
    import pyarrow as pa

    blob = b"\n".join(keys) if kind == WORDS else np.diff(keys, prepend=0).tobytes()
    n = values if counts is None else counts
    return pa.RecordBatch.from_arrays(
        [pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([block], pa.int64()), pa.array([blob], pa.binary()), pa.array([values.tobytes()], pa.binary()), pa.array([len(keys)], pa.int64()), pa.array([int(n.sum())], pa.int64())],
        names=["kind", "bucket", "block", "keys", "values", "size", "total"],
    )


_LISTS = "kind int, bucket int, block bigint, keys binary, values binary, size bigint, total bigint"


def _keys(kind: int, blob: bytes):
    return blob.split(b"\n") if kind == WORDS else np.cumsum(np.frombuffer(blob, np.int64))


def _in_lists(kind: int, keys, values: np.ndarray):
    for i in range(0, len(keys), _LIST):
        yield keys[i : i + _LIST], values[i : i + _LIST]


def _count(buckets: int):
    """mapInArrow function: texts sorted by block to each block's lists of words and strings, counts of training rows."""

    def lists(block, words, strings, short, ends):
        names = sorted(words)
        n = np.fromiter(map(words.__getitem__, names), np.int64, len(names))
        of = np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % buckets
        order = np.argsort(of, kind="stable")
        cut = np.searchsorted(of[order], np.arange(buckets + 1))
        for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if j > i:
                yield _row(WORDS, b, block, [names[k] for k in order[i:j]], n[order[i:j]])
        code, n = merged(strings)
        tail = code // SYMBOLS % SYMBOLS ** (SHARED + 1)
        of = ((tail.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
        order = np.argsort(of, kind="stable")
        cut = np.searchsorted(of[order], np.arange(buckets + 1))
        for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if j > i:
                yield _row(STRINGS, b, block, code[order[i:j]], n[order[i:j]])
        code, n = merged(short)
        of = code // SYMBOLS % SYMBOLS
        for b in np.unique(of).tolist():
            yield _row(SHORT, b, block, code[of == b], n[of == b])
        # a list of no keys brings the number of ends
        yield _row(SHORT, -1, block, code[:0], n[:0], np.array([ends]))

    def run(batches):
        now, state, waiting = None, None, 0
        for b in batches:
            data, at = utf8(b.column("text"))
            block, learn = b.column("block").to_numpy(), b.column("learn").to_numpy(zero_copy_only=False).astype(bool)
            cut = np.flatnonzero(np.diff(block)) + 1
            for first, last in zip([0, *cut], [*cut, len(block)], strict=True):
                if first == last:
                    continue
                if block[first] != now:
                    if state is not None:
                        yield from lists(now, *state)
                    now, state, waiting = int(block[first]), [Counter(), [], [], 0], 0
                words, strings, short, _ = state
                for i, j in _slices(at[first : last + 1]):
                    rows = np.arange(first + i, first + j)
                    for k in rows:
                        w = data[at[k] : at[k + 1]].tobytes().lower().split()
                        if learn[k]:
                            words.update(w)
                        else:
                            for x in w:
                                words.setdefault(x, 0)
                    for mine, weight in ((rows[learn[rows]], 1), (rows[~learn[rows]], 0)):
                        size = at[mine + 1] - at[mine]
                        part = data[at[rows[0]] : at[rows[-1] + 1]] if len(mine) == len(rows) else np.concatenate([data[:0], *(data[at[k] : at[k + 1]] for k in mine)])
                        code, n = grams(part, np.concatenate([[0], np.cumsum(size)]))
                        strings.append((code, n * weight))
                        waiting += len(code)
                        if weight:
                            short.append(merged([(code % SYMBOLS ** (SHARED + 1), n)]))
                    state[3] += int(np.count_nonzero(learn[rows]))
                    if waiting > _WAITING:
                        state[1] = strings = [merged(strings)]
                        state[2] = short = [merged(short)]
                        waiting = 0
        if state is not None:
            yield from lists(now, *state)

    return run


def _sum(batches):
    """mapInArrow function: lists sorted by kind and bucket to the sums of each bucket, keys that were counted only."""

    def sums(kind, bucket, held):
        if kind == WORDS:
            names = sorted(w for w, n in held.items() if n)
            keys, n = names, np.fromiter(map(held.__getitem__, names), np.int64, len(names))
        else:
            keys, n = merged(held)
            keys, n = keys[n > 0], n[n > 0]
        for k, v in _in_lists(kind, keys, n):
            yield _row(kind, bucket, -1, k, v)

    now, held, waiting = None, None, 0
    for b in batches:
        kinds, buckets, blobs, values = b.column("kind").to_numpy(), b.column("bucket").to_numpy(), b.column("keys"), b.column("values")
        for r in range(b.num_rows):
            key = int(kinds[r]), int(buckets[r])
            if key != now:
                if now is not None:
                    yield from sums(*now, held)
                now, held, waiting = key, Counter() if key[0] == WORDS else [], 0
            keys, n = _keys(key[0], blobs[r].as_py()), np.frombuffer(values[r].as_py(), np.int64)
            if key[0] == WORDS:
                for w, c in zip(keys, n.tolist(), strict=True):
                    if c:
                        held[w] += c
            else:
                held.append((keys, n))
                waiting += len(keys)
                if waiting > _WAITING and len(held) > 1:
                    held = [merged(held)]
                    waiting = 0
    if now is not None:
        yield from sums(*now, held)


def _serve(shared):
    """mapInArrow function: sums (block -1) and then lists, sorted by kind, bucket and block, to the lists with answers."""

    def run(batches):
        low, now, held, ready = ByteTrie(*shared.value, SHARED), None, None, None
        for b in batches:
            kinds, buckets, blocks, blobs, values = b.column("kind").to_numpy(), b.column("bucket").to_numpy(), b.column("block").to_numpy(), b.column("keys"), b.column("values")
            for r in range(b.num_rows):
                key = int(kinds[r]), int(buckets[r])
                if key != now:
                    now, held, ready = key, [], None
                keys = _keys(key[0], blobs[r].as_py())
                if blocks[r] < 0:
                    held.append((keys, np.frombuffer(values[r].as_py(), np.int64)))
                    continue
                if ready is None:
                    if key[0] == WORDS:
                        ready = {w: n for names, ns in held for w, n in zip(names, ns.tolist(), strict=True)}
                    else:
                        code, n = merged(held)
                        ready = ByteTrie(code, n, ORDER, low)
                    held = []
                if key[0] == WORDS:
                    answer = np.fromiter((ready.get(w, 0) for w in keys), np.int64, len(keys))
                else:
                    answer = ready.log_p(keys)
                yield _row(key[0], key[1], int(blocks[r]), keys, answer, np.zeros(1))

    return run


def _score(ends: int):
    """Function of a block's texts and answered lists: the columns of each text."""
    of_end = float(np.log10(ends + 0.5))

    def run(texts, lists):
        import pyarrow as pa

        count, codes, logs = {}, [np.zeros(0, np.int64)], [np.zeros(0)]
        for b in lists.to_batches():
            for k, keys, values in zip(b.column("kind").to_pylist(), b.column("keys"), b.column("values"), strict=True):
                if k == WORDS:
                    count.update(zip(_keys(k, keys.as_py()), np.frombuffer(values.as_py(), np.int64).tolist(), strict=True))
                else:
                    codes.append(_keys(k, keys.as_py()))
                    logs.append(np.frombuffer(values.as_py(), np.float64))
        codes, logs = np.concatenate(codes), np.concatenate(logs)
        place, get, found = Index(codes), count.__getitem__, [np.zeros((4, 0))]
        for b in texts.to_batches():
            data, at = utf8(b.column("text"))
            rows = len(at) - 1
            tokens, known, log = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows)
            for k in range(rows):
                w = data[at[k] : at[k + 1]].tobytes().lower().split()
                c = np.fromiter(map(get, w), np.float64, len(w))
                tokens[k], known[k] = len(w) + 1, np.count_nonzero(c) + (ends > 0)
                log[k] = np.log10(c + 0.5).sum() + of_end
            found.append(np.array([tokens, known, log, text_scores(data, at, lambda code: logs[place.find(code)]) if rows else np.zeros(0)]))
        tokens, known, log, score = np.concatenate(found, axis=1)
        columns = [texts.column("id"), texts.column("learn"), *map(pa.array, (tokens.astype(np.int64), known.astype(np.int64), log, score))]
        del count, get, codes, logs, place
        give_back()
        return pa.table(columns, names=["id", "learn", "n_tokens", "n_known", "word_log", "score"])

    return run


def _freed(kernel):
    """The mapInArrow function, which gives memory back when it ends."""
    return lambda batches: released(kernel(batches))


def lm_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 32 << 20, most_buckets: int = 4096) -> tuple[DataFrame, int, int]:
    """(id, learn, n_tokens, n_known, word_log, score) of every row, N and V.

    word_log is the sum of log10(c + 0.5) over the row's tokens, score the trie's
    log10 probability. learn: the condition that training rows meet. There are
    as many buckets as blocks, most_buckets at most.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    blocks = max(blocks_for(docs, text_col, block_bytes), min(spark.sparkContext.defaultParallelism, blocks_for(docs, text_col, 1 << 20)))
    buckets = min(blocks, most_buckets)
    dealt = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"), F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("bigint").alias("block")
    )
    counted = materialize(dealt.select("block", "learn", "text").repartition("block").sortWithinPartitions("block").mapInArrow(_freed(_count(buckets)), _LISTS))
    lists = counted.where("bucket >= 0")
    sums = materialize(lists.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(_freed(_sum), _LISTS))
    ends = counted.where("bucket < 0").agg(F.sum("total")).first()[0] or 0
    n, v = sums.where(F.col("kind") == WORDS).agg(F.sum("total"), F.sum("size")).first()
    n, v = (n or 0) + ends, (v or 0) + (ends > 0)
    low = sums.where(F.col("kind") == SHORT).select("keys", "values").collect()  # the alphabet bounds it
    shared = spark.sparkContext.broadcast(merged([(_keys(SHORT, bytes(r[0])), np.frombuffer(bytes(r[1]), np.int64)) for r in low]))
    asked = lists.where(F.col("kind") < SHORT).withColumn("values", F.lit(None).cast("binary")).union(sums.where(F.col("kind") < SHORT))
    served = asked.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "block").mapInArrow(_freed(_serve(shared)), _LISTS).select("block", "kind", "keys", "values")
    scored = dealt.groupBy("block").cogroup(served.groupBy("block")).applyInArrow(_score(ends), f"id {kind}, learn boolean, n_tokens bigint, n_known bigint, word_log double, score double")
    return scored, n, v


def op10_lm_score(spark, sf_dir):
    found, n, v = lm_scores(table(spark, sf_dir, "documents"), fold("doc_id", 5) != 1)
    return found.select(
        F.col("id").alias("doc_id"),
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("word_log") - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))).alias("base_score"),
        "score",
    )
