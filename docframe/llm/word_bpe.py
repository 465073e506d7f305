"""Byte-pair encoding of many words at once, in numpy, from a tokenizer file of word pieces.

Covers the words that such a tokenizer takes as one piece: runs of Latin
letters. All words of a batch take their best merge at the same time, the
leftmost of lowest rank, until none has one left; this is the tokenizer's own
rule, so the ids are the same. Other words, and files of another make, are the
tokenizer's own business (see packing.WordEncoder).
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Letters of ASCII and Latin-1 in UTF-8; capitals above ASCII are folded by hand.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_CAPITALS = re.compile(rb"\xc3[\x80-\x96\x98-\x9e]")
_NONE = np.int32(2**31 - 1)
LONGEST = 48


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], n = chr(256 + n), n + 1
    return out


class WordBpe:
    """None of it is used unless `fits`: the file has the make that is assumed here."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, norm, pre = whole["model"], whole.get("normalizer") or {}, whole.get("pre_tokenizer") or {}
        first = (pre.get("pretokenizers") or [{}])[0]
        self.fits = (
            [n.get("type") for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [p.get("type") for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and first.get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            and model.get("end_of_word_suffix") == "</w>"
            and not model.get("ignore_merges")
        )
        if not self.fits:
            return
        vocab, symbols = model["vocab"], _byte_symbols()
        self.inner = np.array([vocab.get(s, -1) for s in symbols], np.int32)
        self.final = np.array([vocab.get(f"{s}</w>", -1) for s in symbols], np.int32)
        self.size = max(vocab.values()) + 1
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        self.made = np.array([c for _, _, c in pairs], np.int32)
        keys = np.array([a for a, _, _ in pairs], np.int64) * self.size + np.array([b for _, b, _ in pairs], np.int64)
        # hash tables: what collides in one goes to the next
        self.tables, rank, shift = [], np.arange(len(keys), dtype=np.int32), 64 - 17
        self.shift = np.uint64(shift)
        while len(keys):
            mix = np.uint64(0x9E3779B97F4A7C15 + 0xD1342543DE82EF94 * len(self.tables) & 0xFFFFFFFFFFFFFFFF | 1)
            slot = ((keys.astype(np.uint64) * mix) >> self.shift).astype(np.int64)
            _, keep = np.unique(slot, return_index=True)
            table, ranks = np.full(1 << 17, -1, np.int64), np.full(1 << 17, _NONE, np.int32)
            table[slot[keep]], ranks[slot[keep]] = keys[keep], rank[keep]
            self.tables.append((mix, table, ranks))
            left = np.ones(len(keys), bool)
            left[keep] = False
            keys, rank = keys[left], rank[left]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) * self.size + b).ravel()
        out, todo = np.full(len(key), _NONE, np.int32), np.flatnonzero(((a >= 0) & (b >= 0)).ravel())
        for mix, table, ranks in self.tables:
            k = key[todo]
            slot = ((k.astype(np.uint64) * mix) >> self.shift).astype(np.int64)
            there = table[slot]
            hit = there == k
            out[todo[hit]] = ranks[slot[hit]]
            todo = todo[~hit & (there >= 0)]
            if not len(todo):
                break
        return out.reshape(a.shape)

    def takes(self, word: bytes) -> bool:
        return len(word) <= LONGEST and (word.islower() and word.isalpha() or LETTERS.fullmatch(word) is not None)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids as packed little-endian 32-bit words, of words that takes() accepts; words of like length together are faster."""
        out: list[bytes] = []
        for i in range(0, len(words), 8192):
            out += self._batch([_CAPITALS.sub(lambda m: bytes([m[0][0], m[0][1] + 32]), w) if b"\xc3" in w else w for w in words[i : i + 8192]])
        return out

    def _batch(self, words: list[bytes]):
        size = np.array([len(w) for w in words])
        n, wide = len(words), int(size.max())
        at, w = np.arange(n), np.full((n, wide + 1), -1, np.int32)
        raw = np.frombuffer(b"".join(words), np.uint8)
        w[np.arange(wide + 1) < size[:, None]] = self.inner[raw]
        w[at, size - 1] = self.final[raw[np.cumsum(size) - 1]]
        rank = self.ranks(w[:, :-1], w[:, 1:])
        done, rows = w.copy(), at
        while len(rows):
            pos = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), pos]
            go = best < _NONE
            if not go.all():
                done[rows[~go], : w.shape[1]] = w[~go]
                done[rows[~go], w.shape[1] :] = -1
                rows, w, rank, pos, best = rows[go], w[go], rank[go], pos[go], best[go]
                if not len(rows):
                    break
            here = np.arange(len(rows))
            w[here, pos] = self.made[best]
            # the right half of the pair goes, and a rank with it: that of the pair, as those beside it are found anew
            stay = np.arange(rank.shape[1]) != pos[:, None]
            w = np.concatenate([w[:, :1], w[:, 1:][stay].reshape(len(rows), -1)], axis=1)
            rank = rank[stay].reshape(len(rows), -1) if rank.shape[1] > 1 else np.full((len(rows), 1), _NONE, np.int32)
            if w.shape[1] == 1:
                w = np.concatenate([w, np.full((len(rows), 1), -1, np.int32)], axis=1)
            for p, ok in ((pos, pos < rank.shape[1]), (pos - 1, pos > 0)):
                k = here[ok]
                rank[k, p[ok]] = self.ranks(w[k, p[ok]], w[k, p[ok] + 1])
        count = (done >= 0).sum(axis=1)
        flat, row = done.astype("<u4").tobytes(), 4 * done.shape[1]
        return [flat[i * row : i * row + 4 * c] for i, c in enumerate(count.tolist())]
