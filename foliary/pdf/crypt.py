"""The standard security handler for reading: RC4 and AES, revisions 2 to 6."""

from __future__ import annotations

import hashlib

import numpy as np

# Fixed value: the specification's padding of passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for c in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(c ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def _times(a: int, b: int) -> int:
    """Product in the field of AES."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = a << 1 ^ (0x11B if a & 0x80 else 0), b >> 1
    return out


def _boxes() -> tuple[list[int], list[int]]:
    """The substitution box from its definition: the inverse, then an affine map."""
    box = []
    for x in range(256):
        y = next((z for z in range(256) if _times(x, z) == 1), 0)
        v = 0x63
        for shift in range(5):
            v ^= (y << shift | y >> (8 - shift)) & 255
        box.append(v)
    back = [0] * 256
    for i, v in enumerate(box):
        back[v] = i
    return box, back


_TABLES: dict[str, list] = {}


def tables() -> dict[str, list]:
    """Made on first use, as most files are not encrypted."""
    if not _TABLES:
        box, back = _boxes()
        _TABLES.update({"box": box, "back": back} | {f"x{k}": [_times(k, v) for v in range(256)] for k in (2, 3, 9, 11, 13, 14)})
    return _TABLES


class Aes:
    """One key of 16 or 32 bytes, in CBC mode."""

    def __init__(self, key: bytes):
        box, n = tables()["box"], len(key) // 4
        self.rounds = n + 6
        words, constant = [key[i : i + 4] for i in range(0, len(key), 4)], 1
        for i in range(n, 4 * (self.rounds + 1)):
            w = words[-1]
            if i % n == 0:
                w = bytes([box[w[1]] ^ constant, box[w[2]], box[w[3]], box[w[0]]])
                constant = _times(constant, 2)
            elif n > 6 and i % n == 4:
                w = bytes([box[c] for c in w])
            words.append(bytes([a ^ b for a, b in zip(words[i - n], w, strict=True)]))
        self.keys = [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]

    def encrypt_block(self, block: bytes) -> bytes:
        t = tables()
        box, x2, x3 = t["box"], t["x2"], t["x3"]
        s = [a ^ b for a, b in zip(block, self.keys[0], strict=True)]
        for r in range(1, self.rounds + 1):
            s = [box[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
            if r < self.rounds:
                s = [x2[s[c + i]] ^ x3[s[c + (i + 1) % 4]] ^ s[c + (i + 2) % 4] ^ s[c + (i + 3) % 4] for c in (0, 4, 8, 12) for i in range(4)]
            s = [a ^ b for a, b in zip(s, self.keys[r], strict=True)]
        return bytes(s)

    def decrypt_block(self, block: bytes) -> bytes:
        t = tables()
        back, x9, x11, x13, x14 = t["back"], t["x9"], t["x11"], t["x13"], t["x14"]
        s = [a ^ b for a, b in zip(block, self.keys[-1], strict=True)]
        for r in range(self.rounds - 1, -1, -1):
            s = [back[s[(i - 4 * (i % 4)) % 16]] ^ self.keys[r][i] for i in range(16)]
            if r:
                s = [x14[s[c + i]] ^ x11[s[c + (i + 1) % 4]] ^ x13[s[c + (i + 2) % 4]] ^ x9[s[c + (i + 3) % 4]] for c in (0, 4, 8, 12) for i in range(4)]
        return bytes(s)

    def cbc_decrypt(self, data: bytes, iv: bytes) -> bytes:
        """All blocks at once: each needs only its own bytes and those of the block before."""
        blocks = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
        if not len(blocks):
            return b""
        t, keys = tables(), [np.frombuffer(k, np.uint8) for k in self.keys]
        back, x9, x11, x13, x14 = (np.array(t[k], np.uint8) for k in ("back", "x9", "x11", "x13", "x14"))
        shift = [(i - 4 * (i % 4)) % 16 for i in range(16)]
        column = np.arange(16) // 4 * 4
        near = [column + (np.arange(16) + k) % 4 for k in range(4)]
        s = blocks ^ keys[-1]
        for r in range(self.rounds - 1, -1, -1):
            s = back[s[:, shift]] ^ keys[r]
            if r:
                s = x14[s[:, near[0]]] ^ x11[s[:, near[1]]] ^ x13[s[:, near[2]]] ^ x9[s[:, near[3]]]
        before = np.vstack([np.frombuffer(iv, np.uint8), blocks[:-1]])
        return (s ^ before).tobytes()

    def cbc_encrypt(self, data: bytes, iv: bytes) -> bytes:
        out = bytearray()
        for i in range(0, len(data), 16):
            iv = self.encrypt_block(bytes([a ^ b for a, b in zip(data[i : i + 16], iv, strict=True)]))
            out += iv
        return bytes(out)


def unpad(data: bytes) -> bytes:
    return data[: -data[-1]] if data and 1 <= data[-1] <= 16 else data


def hash_r6(password: bytes, salt: bytes, extra: bytes = b"") -> bytes:
    """The hardened hash of revision 6."""
    k, i = hashlib.sha256(password + salt + extra).digest(), 0
    while True:
        e = Aes(k[:16]).cbc_encrypt((password + k + extra) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Handler:
    """Keys and decryption; ``key`` is None if the password opens nothing."""

    def __init__(self, encrypt: dict, file_id: bytes, password: bytes = b""):
        self.version, self.revision = int(encrypt.get("V") or 0), int(encrypt.get("R") or 2)
        self.length = int(encrypt.get("Length") or 40) // 8 if self.version in (2, 3) else 16 if self.version == 4 else 5
        filters = encrypt.get("CF") if isinstance(encrypt.get("CF"), dict) else {}
        self.methods = {n: str((f or {}).get("CFM", "None")) for n, f in filters.items() if isinstance(f, dict)}
        self.stream, self.string = (self._method(encrypt.get(k)) for k in ("StmF", "StrF"))
        self.o, self.u, self.p = encrypt.get("O") or b"", encrypt.get("U") or b"", int(encrypt.get("P") or 0)
        self.id, self.metadata = file_id, encrypt.get("EncryptMetadata") is not False
        self.encrypt = encrypt
        self.key = self._key_new(password) if self.version >= 5 else self._user(password) or self._owner(password)

    def _method(self, name) -> str:
        if self.version < 4:
            return "V2"
        return "None" if name in (None, "Identity") else self.methods.get(str(name), "None")

    def _derive(self, password: bytes) -> bytes:
        seed = (password + PAD)[:32] + self.o[:32] + (self.p & 0xFFFFFFFF).to_bytes(4, "little") + self.id
        if self.revision >= 4 and not self.metadata:
            seed += b"\xff\xff\xff\xff"
        k = hashlib.md5(seed).digest()
        for _ in range(50 if self.revision >= 3 else 0):
            k = hashlib.md5(k[: self.length]).digest()
        return k[: self.length]

    def user_entry(self, key: bytes) -> bytes:
        if self.revision < 3:
            return rc4(key, PAD)
        x = hashlib.md5(PAD + self.id).digest()
        for i in range(20):
            x = rc4(bytes([c ^ i for c in key]), x)
        return x

    def _user(self, password: bytes) -> bytes | None:
        key = self._derive(password)
        n = 32 if self.revision < 3 else 16
        return key if self.user_entry(key)[:n] == self.u[:n] else None

    def owner_key(self, password: bytes) -> bytes:
        k = hashlib.md5((password + PAD)[:32]).digest()
        for _ in range(50 if self.revision >= 3 else 0):
            k = hashlib.md5(k).digest()
        return k[: self.length]

    def _owner(self, password: bytes) -> bytes | None:
        k, x = self.owner_key(password), self.o[:32]
        for i in range(19 if self.revision >= 3 else 0, -1, -1):
            x = rc4(bytes([c ^ i for c in k]), x)
        return self._user(x)

    def _key_new(self, password: bytes) -> bytes | None:
        hashed = hash_r6 if self.revision >= 6 else lambda p, s, e=b"": hashlib.sha256(p + s + e).digest()
        password, u = password[:127], self.u[:48]
        if hashed(password, self.u[32:40]) == self.u[:32]:
            return Aes(hashed(password, self.u[40:48])).cbc_decrypt(self.encrypt["UE"][:32], bytes(16))
        if hashed(password, self.o[32:40], u) == self.o[:32]:
            return Aes(hashed(password, self.o[40:48], u)).cbc_decrypt(self.encrypt["OE"][:32], bytes(16))
        return None

    def object_key(self, num: int, gen: int, method: str) -> bytes:
        if self.version >= 5:
            return self.key
        seed = self.key + num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if method == "AESV2" else b"")
        return hashlib.md5(seed).digest()[: min(16, len(self.key) + 5)]

    def decrypt(self, data: bytes, num: int, gen: int, method: str) -> bytes:
        if method == "None":
            return data
        key = self.object_key(num, gen, method)
        return rc4(key, data) if method == "V2" else unpad(Aes(key).cbc_decrypt(data[16:], data[:16]))

    def value(self, value, num: int, gen: int):
        """A value of an object with its strings decrypted."""
        if isinstance(value, bytes) and type(value) is bytes:
            return self.decrypt(value, num, gen, self.string)
        if isinstance(value, list):
            return [self.value(v, num, gen) for v in value]
        if isinstance(value, dict):
            return {k: self.value(v, num, gen) for k, v in value.items()}
        return value
