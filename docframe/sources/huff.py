"""Phrase compression of e-book records: canonical codes over a dictionary whose entries may be compressed themselves."""

from __future__ import annotations

import struct

DEEPEST, MOST_OUT = 32, 256 << 20


class Huff:
    def __init__(self, huff: bytes, dictionaries: list[bytes]):
        if huff[:4] != b"HUFF":
            raise ValueError("no code table")
        one, two = struct.unpack_from(">LL", huff, 8)
        self.short = struct.unpack_from(">256L", huff, one)
        pairs = struct.unpack_from(">64L", huff, two)
        # by code length: the least code and the greatest, aligned to 32 bits
        self.low = [0, *(pairs[2 * k] << (31 - k) for k in range(32))]
        self.high = [0, *((pairs[2 * k + 1] + 1 << (31 - k)) - 1 for k in range(32))]
        self.phrases: list[tuple[bytes, bool]] = []
        for d in dictionaries:
            if d[:4] != b"CDIC":
                raise ValueError("no dictionary")
            start, total, bits = struct.unpack_from(">LLL", d, 4)
            for k in range(min(1 << bits, total - len(self.phrases))):
                at = start + struct.unpack_from(">H", d, start + 2 * k)[0]
                size = struct.unpack_from(">H", d, at)[0]
                self.phrases.append((d[at + 2 : at + 2 + (size & 0x7FFF)], bool(size & 0x8000)))

    def unpack(self, data: bytes, depth: int = 0) -> bytes:
        if depth > DEEPEST:
            raise ValueError("phrases too deep")
        out, bits, at, size = bytearray(), int.from_bytes(data + bytes(8), "big"), 0, 8 * len(data)
        whole = size + 64
        while at < size:
            code = bits >> (whole - at - 32) & 0xFFFFFFFF
            entry = self.short[code >> 24]
            length = entry & 31
            if not length:
                break
            if entry & 0x80:
                high = ((entry >> 8) + 1 << (32 - length)) - 1
            else:
                while length < 32 and code < self.low[length]:
                    length += 1
                high = self.high[length]
            at += length
            if at > size:
                break
            k = (high - code & 0xFFFFFFFF) >> (32 - length)
            if k >= len(self.phrases):
                raise ValueError("no such phrase")
            phrase, plain = self.phrases[k]
            if not plain:
                self.phrases[k] = (b"", True)  # a phrase that holds itself is empty
                phrase = self.unpack(phrase, depth + 1)
                self.phrases[k] = (phrase, True)
            out += phrase
            if len(out) > MOST_OUT:
                raise ValueError("too long")
        return bytes(out)
