import hashlib

import pytest

from foliary.pdf.crypt import PAD, Aes, Handler, hash_r6, rc4, unpad
from foliary.pdf.document import Document, Encrypted
from foliary.pdf.syntax import Name, Ref, Stream, dump
from foliary.pdf.text import page_text


def test_known_answers():
    assert rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    key, block = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert Aes(key).encrypt_block(block).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    long = Aes(bytes(range(32)))
    assert long.encrypt_block(block).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert long.decrypt_block(long.encrypt_block(block)) == block
    assert unpad(b"abc" + b"\x0d" * 13) == b"abc"


def pad(data):
    n = 16 - len(data) % 16
    return data + bytes([n]) * n


def protected(version, password):
    """A one-page file under a user password, encrypted by this test."""
    file_id = b"0123456789abcdef"
    if version < 5:
        entry = {"Filter": Name("Standard"), "V": version, "R": 2 if version == 1 else 3 if version == 2 else 4, "Length": 128 if version > 1 else 40, "P": -44, "O": bytes(range(32)), "U": b""}
        if version == 4:
            entry |= {"CF": {"StdCF": {"CFM": Name("AESV2")}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
        handler = Handler(entry, file_id)
        handler.key = handler._derive(password)
        entry["U"] = handler.user_entry(handler.key).ljust(32, b"\0")
    else:
        key, hashed = bytes(range(100, 132)), hash_r6
        u = hashed(password, b"validate") + b"validatekeysalt."
        entry = {"Filter": Name("Standard"), "V": 5, "R": 6, "P": -44, "U": u, "UE": Aes(hashed(password, b"keysalt.")).cbc_encrypt(key, bytes(16)), "O": bytes(48), "OE": bytes(32),
                 "CF": {"StdCF": {"CFM": Name("AESV3")}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
        handler = Handler(entry, file_id)
        handler.key = key

    def sealed(data, num):
        key = handler.object_key(num, 0, handler.stream)
        return rc4(key, data) if handler.stream == "V2" else b"i" * 16 + Aes(key).cbc_encrypt(pad(data), b"i" * 16)

    objects = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1},
        3: {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(4, 0)}, 4: Stream({}, sealed(b"BT (secret) Tj ET", 4)),
        5: {"Title": sealed(b"hidden", 5)}, 6: entry,
    }
    out, at = bytearray(b"%PDF-1.7\n"), []
    for num, value in objects.items():
        at.append(len(out))
        out += b"%d 0 obj\n" % num + dump(value) + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 7\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % a for a in at)
    out += b"trailer\n" + dump({"Size": 7, "Root": Ref(1, 0), "Info": Ref(5, 0), "Encrypt": Ref(6, 0), "ID": [file_id, file_id]})
    return bytes(out + b"\nstartxref\n%d\n%%%%EOF" % start)


@pytest.mark.parametrize("version", [1, 2, 4, 5])
@pytest.mark.parametrize("password", ["", "user"])
def test_protected_files(version, password):
    data = protected(version, password.encode())
    doc = Document(data, password=password)
    assert page_text(doc, next(doc.pages())) == "secret" and doc.info() == {"Title": "hidden"}
    with pytest.raises(Encrypted):
        Document(data, password="wrong")


def test_padding_is_the_specification_s():
    assert len(PAD) == 32 and hashlib.md5(PAD).digest_size == 16
