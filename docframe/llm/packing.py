"""Packing of tokenized documents into fixed-length sequences by minimum bin slack.

Only the histogram of piece lengths reaches the driver: at most seq_len counts,
whatever the input. There each bin takes the longest length left and a bitset
subset-sum program over the other available lengths finds the combination that
fills it best; the combination is removed as many times as the counts allow.
Every removal leaves some length with fewer pieces than the combination took,
so there are at most about seq_len * ln(seq_len) combinations for any corpus.

The plan is a table of slots: of the pieces of one length, those with ranks
from..to go to these bins at this offset. Pieces get their rank within their
length in two steps (count by length and hash bucket, then number within the
bucket), so a length that a third of all pieces have is spread over buckets.

Defined cases: a null text is empty and gives one piece, the end token; only
documents longer than seq_len are cut; repeated rows are packed each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, released, table, text_chunks
from .word_bpe import WordBpe

SEQ_LEN, END = 4096, 1
#: Words kept in a worker's memo of encodings before it starts anew.
MEMO_WORDS = 300_000
#: ASCII punctuation but for the apostrophe.
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: One such character between a letter or digit and white space.
_LAST_OF_WORD = re.compile(rb"([!-&(-/:-@\[-`{-~])(?<=[a-z0-9].)(?=[ \n])")
_LETTERS_DIGITS = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")


class WordEncoder:
    """Ids of whole texts, as packed 32-bit words, by a tokenizer that drops white space and folds case.

    No token of such a tokenizer crosses ASCII white space, so words are encoded
    once and remembered. Punctuation after a letter or digit is a piece of its
    own (an apostrophe may start a contraction and is left in the word).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder, self.words, self.memo = Tokenizer.from_file(path), WordBpe(path), {}

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[bytes]) -> None:
        memo, fast, split = self.memo, self.words, []
        new = set(filter(bytes.isalpha, words))
        for w in words - new:
            stem = w.rstrip(_PUNCTUATION)
            if stem != w and stem and stem[-1] in _LETTERS_DIGITS:
                split.append((w, stem, w[len(stem) :]))
            else:
                new.add(w)
        for _, *parts in split:
            new.update(parts)
        new.difference_update(memo)
        plain = sorted(filter(fast.takes, new), key=len) if fast.fits else []
        memo.update(zip(plain, fast.encode(plain), strict=True))
        rest = list(new.difference(plain))
        memo.update(zip(rest, self.ids([w.decode() for w in rest]), strict=True))
        for w, stem, end in split:
            memo[w] = memo[stem] + memo[end]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), 512):
            part = texts[i : i + 512]
            # special tokens are matched in the text as it stands, before case is folded
            split = [None if b"<|" in t else _LAST_OF_WORD.sub(rb" \1", t.lower()).split() for t in part]
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            self.learn(set().union(*filter(None, split)).difference(self.memo))
            get = self.memo.__getitem__
            out += [self.ids([t.decode()])[0] if ws is None else b"".join(map(get, ws)) for t, ws in zip(part, split, strict=True)]
        return out


_encoders: dict[str, WordEncoder] = {}


def pieces_of(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, end: int = END, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, crc): each document's ids and the end token, cut at seq_len.

    with_ids: also ``ids``, the piece's ids as packed little-endian 32-bit words.
    """

    def run(batches):
        import pyarrow as pa

        coder = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
        last = np.array([end], "<u4").tobytes()
        for b in batches:
            for first, texts in text_chunks(b.column(1)):
                rows, of, parts = [], [], []
                for k, ids in enumerate(coder.encode(texts), start=first):
                    ids += last
                    for p, s in enumerate(range(0, len(ids), 4 * seq_len)):
                        part = ids[s : s + 4 * seq_len]
                        of.append(k)
                        if with_ids:
                            parts.append(part)
                        rows.append((p, s // 4, len(part) // 4, zlib.crc32(part)))
                cols = np.array(rows, np.int64).reshape(-1, 4)
                out = [b.column(0).take(pa.array(of, pa.int64())), pa.array(cols[:, 0].astype(np.int32)), *(pa.array(cols[:, i]) for i in (1, 2, 3))]
                names = ["id", "piece", "start", "length", "crc"]
                yield pa.RecordBatch.from_arrays(out + [pa.array(parts, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)
        coder.memo.clear()  # the worker lives on, and may serve others

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda b: released(run(b)), f"id {kind}, piece int, start bigint, length bigint, crc bigint" + ", ids binary" * with_ids)


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths (at most as many as counted) with the largest sum up to room; longer lengths first."""
    full, reach, steps = 1 << room, 1, []
    cut = (full << 1) - 1
    for size in sorted((n for n in counts if n <= room), reverse=True):
        left, take = min(counts[size], room // size), 1
        while left:
            take = min(take, left)
            steps.append((reach, size, take))
            reach |= (reach << size * take) & cut
            left -= take
            take *= 2
        if reach & full:
            break
    at, used = reach.bit_length() - 1, {}
    for before, size, take in reversed(steps):
        if not before >> at & 1:
            at -= size * take
            used[size] = used.get(size, 0) + take
    return used


def plan(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[dict[int, int], int]]:
    """(combination, times) until all pieces are placed; a combination is {length: how many}."""
    left, out = dict(histogram), []
    while left:
        longest = max(left)
        rest = {n: c - (n == longest) for n, c in left.items() if c > (n == longest)}
        used = fullest(seq_len - longest, rest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[n] // u for n, u in used.items())
        for n, u in used.items():
            left[n] -= u * times
            if not left[n]:
                del left[n]
        out.append((used, times))
    return out


def slots(combinations: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, offset, first bin), sorted: where the ranks of a length go."""
    rows, rank, first = [], {}, 0
    for used, times in combinations:
        sizes = sorted(used, reverse=True)
        offsets = [0, *accumulate(n * used[n] for n in sizes)]
        for n, off in zip(sizes, offsets, strict=False):
            rows.append((n, rank.get(n, 0), used[n], off, first))
            rank[n] = rank.get(n, 0) + used[n] * times
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, length_col: str = "length", seq_len: int = SEQ_LEN, bucket_rows: int = 1_000) -> DataFrame:
    """The pieces with sequence_id and offset; lengths are 1 to seq_len."""
    import pyarrow as pa

    held = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()))
    histogram = {r[0]: r[1] for r in held.groupBy(length_col).agg(F.count("*")).collect()}  # at most seq_len rows
    where = slots(plan(histogram, seq_len))
    # a length that many pieces have is spread over as many buckets as it needs
    # from Arrow: rows of Python objects would start a daemon and workers of their own on the executors
    buckets = pa.table({length_col: pa.array(list(histogram), pa.int64()), "_buckets": pa.array([-(-c // bucket_rows) for c in histogram.values()], pa.int64())})
    per_length = held.sparkSession.createDataFrame(buckets).withColumn(length_col, F.col(length_col).cast(held.schema[length_col].dataType))
    dealt = held.join(F.broadcast(per_length), length_col).withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.col("_buckets")))
    by = [length_col, "_bucket"]
    from pyspark.sql import Window as W

    before = F.sum("_n").over(W.partitionBy(length_col).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = dealt.groupBy(*by).agg(F.count("*").alias("_n")).select(*by, F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_in", F.row_number().over(W.partitionBy(*by).orderBy("_row")) - 1).join(starts, by)
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_in")).alias("_rank"))
    names = pieces.columns
    # lengths and ranks in one number, in the order of the slots
    keys, wide = where[:, 0].astype(object) * (1 << 48) + where[:, 1], where
    keys = keys.astype(np.int64) if len(keys) else np.zeros(0, np.int64)

    def place(batches):
        import pyarrow as pa

        for b in batches:
            n, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length_col, "_rank"))
            slot = wide[np.searchsorted(keys, n * (1 << 48) + rank, side="right") - 1]
            nth = rank - slot[:, 1]
            cols = [b.column(c) for c in names] + [pa.array(slot[:, 4] + nth // slot[:, 2]), pa.array(slot[:, 3] + nth % slot[:, 2] * n)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN) -> DataFrame:
    packed = pack(pieces_of(docs, path, id_col, text_col, seq_len), "length", seq_len)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def op8_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())
