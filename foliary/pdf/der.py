"""DER and what signatures need of it: the signed digest, the signer's key, and RSA by Python's ``pow``."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

# Object identifiers.
DIGESTS = {
    "1.2.840.113549.2.5": "md5", "1.3.14.3.2.26": "sha1", "2.16.840.1.101.3.4.2.1": "sha256",
    "2.16.840.1.101.3.4.2.2": "sha384", "2.16.840.1.101.3.4.2.3": "sha512",
}
SIGNED_DATA, MESSAGE_DIGEST, RSA_KEY, DATA, CONTENT_TYPE = "1.2.840.113549.1.7.2", "1.2.840.113549.1.9.4", "1.2.840.113549.1.1.1", "1.2.840.113549.1.7.1", "1.2.840.113549.1.9.3"


class Node(NamedTuple):
    tag: int
    body: bytes
    whole: bytes

    def kids(self) -> list[Node]:
        return list(read(self.body))


def read(data: bytes) -> Iterator[Node]:
    """Elements one after another; damage ends them."""
    at = 0
    while at + 2 <= len(data):
        start, tag, size = at, data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 0 < n <= 4:
                return
            size = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + size > len(data):
            return
        yield Node(tag, data[at : at + size], data[start : at + size])
        at += size


def oid(body: bytes) -> str:
    numbers, held = [], 0
    for b in body:
        held = held << 7 | b & 0x7F
        if not b & 0x80:
            numbers.append(held)
            held = 0
    first = min(numbers[0] // 40, 2) if numbers else 0
    return ".".join(map(str, [first, numbers[0] - 40 * first, *numbers[1:]])) if numbers else ""


def put(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = len(body)
    if size < 128:
        return bytes([tag, size]) + body
    length = size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([tag, 0x80 | len(length)]) + length + body


def put_int(value: int) -> bytes:
    return put(2, value.to_bytes(value.bit_length() // 8 + 1, "big"))


def put_oid(name: str) -> bytes:
    numbers = list(map(int, name.split(".")))
    out = bytearray()
    for n in [40 * numbers[0] + numbers[1], *numbers[2:]]:
        septets = [n & 0x7F]
        while n := n >> 7:
            septets.append(n & 0x7F | 0x80)
        out += bytes(reversed(septets))
    return put(6, bytes(out))


class Signed(NamedTuple):
    """What a CMS signature says: digest algorithm, digest, what was signed, the signature, and RSA keys by (issuer, serial)."""

    algorithm: str
    digest: bytes | None
    attributes: bytes
    signature: bytes
    signer: tuple[bytes, bytes]
    keys: dict[tuple[bytes, bytes], tuple[int, int]]


def signed_data(contents: bytes) -> Signed | None:
    """The first signer of a SignedData; None if it is nothing of the kind."""
    top = next(read(contents), None)
    if top is None or top.tag != 0x30:
        return None
    kids = top.kids()
    if len(kids) < 2 or oid(kids[0].body) != SIGNED_DATA:
        return None
    parts = (kids[1].kids() or [Node(0, b"", b"")])[0].kids()
    signers = [p for p in parts if p.tag == 0x31]
    first = signers[-1].kids() if len(signers) > 1 else []
    if not first:
        return None
    info = first[0].kids()
    if len(info) < 5:
        return None
    signer = info[1].kids()
    algorithm = DIGESTS.get(oid(info[2].kids()[0].body), "")
    digest, attributes = None, b""
    if info[3].tag == 0xA0:
        attributes = b"\x31" + info[3].whole[1:]  # signed as a set, whatever its tag
        for a in info[3].kids():
            pair = a.kids()
            if len(pair) > 1 and oid(pair[0].body) == MESSAGE_DIGEST and pair[1].kids():
                digest = pair[1].kids()[0].body
    signature = next((x.body for x in info[4:] if x.tag == 4), b"")
    keys = {}
    for bag in (p for p in parts if p.tag == 0xA0):
        for certificate in bag.kids():
            if found := _key(certificate):
                keys[found[0]] = found[1]
    return Signed(algorithm, digest, attributes, signature, (signer[0].whole, signer[1].body) if len(signer) > 1 else (b"", b""), keys)


def _key(certificate: Node) -> tuple[tuple[bytes, bytes], tuple[int, int]] | None:
    """((issuer, serial), (modulus, exponent)) of an X.509 certificate with an RSA key."""
    body = certificate.kids()
    fields = body[0].kids() if body else []
    fields = fields[1:] if fields and fields[0].tag == 0xA0 else fields
    if len(fields) < 6:
        return None
    info = fields[5].kids()
    if len(info) < 2 or not info[0].kids() or oid(info[0].kids()[0].body) != RSA_KEY:
        return None
    numbers = [int.from_bytes(k.body, "big") for seq in read(info[1].body[1:]) for k in seq.kids()]
    return ((fields[2].whole, fields[0].body), (numbers[0], numbers[1])) if len(numbers) > 1 else None


def encoded_digest(algorithm: str, digest: bytes) -> bytes:
    name = next(k for k, v in DIGESTS.items() if v == algorithm)
    return put(0x30, put(0x30, put_oid(name), put(5)), put(4, digest))


def rsa_holds(algorithm: str, data: bytes, signature: bytes, key: tuple[int, int]) -> bool:
    """PKCS #1 v1.5, compared with the whole padded block."""
    modulus, exponent = key
    size = (modulus.bit_length() + 7) // 8
    if len(signature) != size or not algorithm:
        return False
    block = pow(int.from_bytes(signature, "big"), exponent, modulus).to_bytes(size, "big")
    inner = encoded_digest(algorithm, hashlib.new(algorithm, data).digest())
    return block == b"\x00\x01" + b"\xff" * (size - len(inner) - 3) + b"\x00" + inner


def check(contents: bytes, parts: list[bytes]) -> dict:
    """digest_ok, signature_ok and a verdict on signed bytes; trust in the certificate is not looked at.

    Null where there is nothing to compare: no CMS, an unknown digest, or no RSA key of the signer.
    """
    held = signed_data(contents)
    if held is None or held.digest is None:
        return {"digest_ok": None, "signature_ok": None, "verdict": "NO_SIGNED_DIGEST"}
    if not held.algorithm:
        return {"digest_ok": None, "signature_ok": None, "verdict": "UNKNOWN_DIGEST"}
    same = hashlib.new(held.algorithm, b"".join(parts)).digest() == held.digest
    key = held.keys.get(held.signer)
    holds = rsa_holds(held.algorithm, held.attributes, held.signature, key) if key else None
    verdict = "DIGEST_MISMATCH" if not same else "BAD_SIGNATURE" if holds is False else "INTACT"
    return {"digest_ok": same, "signature_ok": holds, "verdict": verdict}
