"""The standard security of PDF files: passwords to keys, RC4, and AES (decryption over all blocks at once)."""

from __future__ import annotations

import hashlib
import struct

import numpy as np

#: What passwords are padded with. Fixed values.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _tables():
    """The S-box from inverses in the field of 256 elements, its inverse, and multiplication."""

    def mul(a, b):
        p = 0
        while b:
            if b & 1:
                p ^= a
            a = a << 1 ^ (0x11B if a & 0x80 else 0)
            b >>= 1
        return p

    exp, x = [], 1
    for _ in range(255):
        exp.append(x)
        x = mul(x, 3)
    log = {v: k for k, v in enumerate(exp)}
    box = []
    for v in range(256):
        r = exp[-log[v] % 255] if v else 0
        out = 0x63
        for k in range(5):
            out ^= (r << k | r >> (8 - k)) & 255
        box.append(out)
    back = [0] * 256
    for k, v in enumerate(box):
        back[v] = k
    return box, back, {m: [mul(m, v) for v in range(256)] for m in (2, 3, 9, 11, 13, 14)}


_BOX, _BACK, _MUL = _tables()


def _schedule(key: bytes) -> list[list[int]]:
    n = len(key) // 4
    words, rcon = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
    for i in range(n, 4 * (n + 7)):
        w = list(words[-1])
        if i % n == 0:
            w = [_BOX[x] for x in w[1:] + w[:1]]
            w[0] ^= rcon
            rcon = rcon << 1 ^ (0x11B if rcon & 0x80 else 0)
        elif n > 6 and i % n == 4:
            w = [_BOX[x] for x in w]
        words.append([a ^ b for a, b in zip(w, words[i - n], strict=True)])
    return [sum(words[i : i + 4], []) for i in range(0, len(words), 4)]


_BACK_AT, _MUL_AT = np.array(_BACK, np.uint8), {m: np.array(v, np.uint8) for m, v in _MUL.items()}
#: Where each byte of a state goes when its rows are turned back.
_TURNED = np.array([(i - 4 * (i % 4)) % 16 for i in range(16)])


def _decrypt_blocks(blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """All blocks (rows of 16 bytes) at once."""
    s = blocks ^ keys[-1]
    for r in range(len(keys) - 2, -1, -1):
        s = _BACK_AT[s[:, _TURNED]] ^ keys[r]
        if r:
            columns = s.reshape(-1, 4, 4)
            m = {k: _MUL_AT[k][columns] for k in (9, 11, 13, 14)}
            s = np.stack([m[14][..., i] ^ m[11][..., (i + 1) % 4] ^ m[13][..., (i + 2) % 4] ^ m[9][..., (i + 3) % 4] for i in range(4)], axis=2).reshape(-1, 16)
    return s


#: A round's substitution and column mixing of one byte, as a word, by its row.
_ROUND = [[int.from_bytes(bytes(x[-k:] + x[:-k] if k else x), "big") for x in ([_MUL[2][v], v, v, _MUL[3][v]] for v in _BOX)] for k in range(4)]


def _encrypt_words(s: list[int], words: list[list[int]]) -> list[int]:
    """One block of four words."""
    t0, t1, t2, t3 = _ROUND
    a, b, c, d = (x ^ k for x, k in zip(s, words[0], strict=True))
    for k in words[1:-1]:
        a, b, c, d = (
            t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k[0], t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k[1],
            t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k[2], t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k[3],
        )
    box, k = _BOX, words[-1]
    last = lambda w, x, y, z, key: (box[w >> 24] << 24 | box[x >> 16 & 255] << 16 | box[y >> 8 & 255] << 8 | box[z & 255]) ^ key
    return [last(a, b, c, d, k[0]), last(b, c, d, a, k[1]), last(c, d, a, b, k[2]), last(d, a, b, c, k[3])]


def _encrypt_block(block, keys) -> bytes:
    return struct.pack(">4L", *_encrypt_words(struct.unpack(">4L", bytes(block)), [list(struct.unpack(">4L", bytes(k))) for k in keys]))


def aes_cbc(key: bytes, data: bytes, iv: bytes | None = None, unpad: bool = True) -> bytes:
    """Decrypts; without iv the first block is it. Padding that is none is left."""
    iv, data = (data[:16], data[16:]) if iv is None else (iv, data)
    n = len(data) // 16
    if not n or len(iv) < 16:
        return b""
    keys, out = np.array(_schedule(key), np.uint8), []
    blocks = np.frombuffer(data[: 16 * n], np.uint8).reshape(-1, 16)
    last = np.frombuffer(iv, np.uint8).reshape(1, 16)
    for i in range(0, n, 1 << 15):
        part = blocks[i : i + (1 << 15)]
        out.append((_decrypt_blocks(part, keys) ^ np.concatenate([last, part[:-1]])).tobytes())
        last = part[-1:]
    plain = b"".join(out)
    return plain[: -plain[-1]] if unpad and 1 <= plain[-1] <= 16 else plain


def aes_cbc_encrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    """Encrypts whole blocks; each needs the one before."""
    words, out = [list(struct.unpack(">4L", bytes(k))) for k in _schedule(key)], []
    last = struct.unpack(">4L", iv)
    plain = struct.unpack(f">{len(data) // 4}L", data)
    for i in range(0, len(plain), 4):
        last = _encrypt_words([plain[i] ^ last[0], plain[i + 1] ^ last[1], plain[i + 2] ^ last[2], plain[i + 3] ^ last[3]], words)
        out += last
    return struct.pack(f">{len(out)}L", *out)


def hash_r6(password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    k, n = hashlib.sha256(password + salt + user).digest(), 0
    while True:
        e = aes_cbc_encrypt(k[:16], (password + k + user) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        n += 1
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]


class Security:
    """The file key of a user or owner password, and per-object decryption."""

    def __init__(self, d: dict, file_id: bytes, password: bytes = b""):
        self.v, self.r = d.get("V", 0), d.get("R", 2)
        self.length = min(32, max(5, (d.get("Length", 40) if self.v > 1 else 40) // 8))
        self.meta = d.get("EncryptMetadata", True)
        cf = (d.get("CF") or {}).get(d.get("StmF", "Identity"), {}) if self.v >= 4 else {}
        self.method = {"V2": "rc4", "AESV2": "aes", "AESV3": "aes", "None": "none"}.get(cf.get("CFM", "None"), "none") if self.v >= 4 else "rc4"
        if self.v >= 4 and self.r < 5:
            self.length = 16
        self.key = self._key_r5(d, password[:127]) if self.r >= 5 else self._key_r4(d, file_id, password)

    def _from_user(self, d, file_id, password):
        h = hashlib.md5((password + PADDING)[:32] + d["O"][:32] + struct.pack("<I", d["P"] & 0xFFFFFFFF) + file_id + (b"\xff" * 4 if self.r >= 4 and not self.meta else b"")).digest()
        for _ in range(50 if self.r >= 3 else 0):
            h = hashlib.md5(h[: self.length]).digest()
        return h[: self.length]

    def _opens(self, d, file_id, key) -> bool:
        if self.r < 3:
            return rc4(key, PADDING) == d["U"][:32]
        x = rc4(key, hashlib.md5(PADDING + file_id).digest())
        for k in range(1, 20):
            x = rc4(bytes(c ^ k for c in key), x)
        return x == d["U"][:16]

    def _key_r4(self, d, file_id, password):
        key = self._from_user(d, file_id, password)
        if self._opens(d, file_id, key):
            return key
        h = hashlib.md5((password + PADDING)[:32]).digest()
        for _ in range(50 if self.r >= 3 else 0):
            h = hashlib.md5(h).digest()
        user = d["O"][:32]
        for k in range(19, -1, -1) if self.r >= 3 else (0,):
            user = rc4(bytes(c ^ k for c in h[: self.length]), user)
        key = self._from_user(d, file_id, user)
        return key if self._opens(d, file_id, key) else None

    def _key_r5(self, d, password):
        digest = hash_r6 if self.r >= 6 else lambda p, s, u=b"": hashlib.sha256(p + s + u).digest()
        u, o = d["U"][:48], d["O"][:48]
        if digest(password, u[32:40]) == u[:32]:
            return aes_cbc(digest(password, u[40:48]), d["UE"], bytes(16), False)
        if digest(password, o[32:40], u) == o[:32]:
            return aes_cbc(digest(password, o[40:48], u), d["OE"], bytes(16), False)
        return None

    def decrypt(self, num: int, gen: int, data: bytes) -> bytes:
        if self.method == "none":
            return data
        if self.r >= 5:
            return aes_cbc(self.key, data)
        k = self.key + struct.pack("<I", num)[:3] + struct.pack("<I", gen)[:2] + (b"sAlT" if self.method == "aes" else b"")
        k = hashlib.md5(k).digest()[: min(16, len(self.key) + 5)]
        return aes_cbc(k, data) if self.method == "aes" else rc4(k, data)
