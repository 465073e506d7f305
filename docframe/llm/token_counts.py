"""Token counts by section: whole texts encoded once, tokens joined to sections by their spans.

A text is encoded whole, as a model would read it, by a byte-level tokenizer:
its tokens tile the text's bytes, so the running sum of the tokens' byte
lengths gives every token's span, and the spans become character offsets by
counting the bytes that begin a character. Sections are given as character
spans. Both lists are sorted, so the interval join is a merge (a binary search
of one in the other).

A token that crosses a boundary is allocated by a rule: ``start`` gives it to
the section of its first character, ``most`` to the section that holds most of
its characters, the earlier one if even. A character split over tokens belongs
to the token with its first byte; a token without a first byte takes the place
of the character it continues. Every token is allocated once, so a document's
sections add up to its tokens.

The tokenizer's pattern engine gives up on very long runs of white space, so
these are cut out before it sees them, where the pattern itself cuts: a run is
one piece but for its last character if more text follows. The merges of such a
piece are worked out over the whole of it.

Defined cases: a null or empty text is one empty section without tokens; texts
and runs of any length are encoded whole (4 MB of one letter: some seconds);
repeated rows are counted each; an empty table gives an empty result; other
columns are not read, whatever they are called.
"""

from __future__ import annotations

import base64
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, utf8


#: Characters of white space in a row that are kept from the pattern engine.
LONG_RUN = 4096
#: White space as Unicode has it, which is what the tokenizer's pattern means.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


class Encoder:
    """Ids of a byte-level vocabulary, and their byte lengths."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        self.length[list(ranks.values())] = [len(t) for t in ranks]

    def encode(self, text: str) -> np.ndarray:
        runs = list(_WHITE.finditer(text)) if len(text) >= LONG_RUN else ()
        if not runs:
            return self.coder.encode_to_numpy(text)
        parts, at = [], 0
        for m in runs:
            end = m.end() - (m.end() < len(text))
            parts += [self.coder.encode_to_numpy(text[at : m.start()]), np.array(self.coder._encode_single_piece(text[m.start() : end]), np.uint32)]
            at = end
        return np.concatenate([*parts, self.coder.encode_to_numpy(text[at:])])


_encoders: dict[str, Encoder] = {}


def line_sections(text: bytes) -> np.ndarray:
    """First bytes of the lines of a text; a line holds its line end."""
    b = np.frombuffer(text, np.uint8)
    starts = np.flatnonzero(b == 10) + 1
    return np.concatenate([[0], starts[starts < len(b)]])


def allocate(spans: np.ndarray, sections: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For tokens (start, end) and sorted section starts, in characters: each token's section, and whether it crosses a boundary."""
    first = np.searchsorted(sections, spans[:, 0], side="right") - 1
    last = np.searchsorted(sections, np.maximum(spans[:, 1] - 1, spans[:, 0]), side="right") - 1
    owner = first.copy()
    if rule == "most":
        ends = np.append(sections[1:], size)
        for t in np.flatnonzero(last > first):
            s, e = spans[t]
            inside = [min(e, ends[k]) - max(s, sections[k]) for k in range(first[t], last[t] + 1)]
            owner[t] += int(np.argmax(inside))
    return owner, last > first


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "start", sections=line_sections) -> DataFrame:
    """(id, section, start, end, n_tokens, n_crossing) of every section, offsets in characters.

    sections: of a UTF-8 text, the ascending first bytes of its sections, the first of them 0.
    """
    if rule not in ("start", "most"):
        raise ValueError(f"no such rule: {rule}")

    def run(batches):
        import pyarrow as pa

        coder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        for b in batches:
            data, at = utf8(b.column(1))
            of, parts = [], []
            for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
                text = data[i:j].tobytes()
                ends = np.cumsum(coder.length[coder.encode(text.decode())]) if text else np.zeros(0, np.int64)
                # characters begun before each byte
                chars = np.concatenate([[0], np.cumsum((data[i:j] & 0xC0) != 0x80)])
                cut = chars[sections(text)]
                spans = np.stack([chars[np.concatenate([[0], ends[:-1]]).astype(np.int64)], chars[ends]], axis=1) if len(ends) else np.zeros((0, 2), np.int64)
                inside = np.flatnonzero(spans[:, 0] == spans[:, 1])  # only continues a character
                spans[inside, 0] -= 1
                owner, crosses = allocate(spans, cut, chars[-1], rule)
                n = len(cut)
                of.append(np.full(n, k))
                parts.append(np.stack([np.arange(n), cut, np.append(cut[1:], chars[-1]), np.bincount(owner, minlength=n), np.bincount(owner[crosses], minlength=n)], axis=1))
            cols = np.concatenate([np.zeros((0, 5), np.int64), *parts])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.concatenate([np.zeros(0, np.int64), *of]))), pa.array(cols[:, 0].astype(np.int32)), *(pa.array(cols[:, c]) for c in range(1, 5))],
                names=["id", "section", "start", "end", "n_tokens", "n_crossing"],
            )

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, section int, start bigint, end bigint, n_tokens bigint, n_crossing bigint")


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), vocabulary()).withColumnRenamed("id", "doc_id")
