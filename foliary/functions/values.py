"""Values of files as column expressions: numbers, times, fonts, escaping, keyed digests, and geometry."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: Column, default: float = 0.0) -> Column:
    """A number's value; the default for what isn't one."""
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(default))


def asn1_time(text: Column) -> Column:
    """UTCTime or GeneralizedTime as "YYYY-MM-DD HH:MM:SS UTC"; null if it is neither.

    Two-digit years from 50 up are of the twentieth century.
    """
    short = text.rlike(r"^[0-9]{12}Z$")
    century = F.when(F.substring(text, 1, 2).try_cast("int") >= 50, "19").otherwise("20")
    whole = F.when(short, F.concat(century, text)).when(text.rlike(r"^[0-9]{14}Z?"), text)
    part = lambda at, n: F.substring(whole, at, n)
    date = F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2))
    clock = F.concat_ws(":", part(9, 2), part(11, 2), part(13, 2))
    return F.when(whole.isNotNull(), F.concat(date, F.lit(" "), clock, F.lit(" UTC")))


# The fonts that every reader has.
STANDARD_14 = (
    "Courier", "Courier-Bold", "Courier-BoldOblique", "Courier-Oblique", "Helvetica", "Helvetica-Bold", "Helvetica-BoldOblique", "Helvetica-Oblique",
    "Symbol", "Times-Bold", "Times-BoldItalic", "Times-Italic", "Times-Roman", "ZapfDingbats",
)


def is_standard_14(name: Column) -> Column:
    return name.isin(*STANDARD_14)


def substitute(name: Column, table: list[tuple[str, str]], last: str = "sans-serif") -> Column:
    """A font's stand-in: by its whole name, else by the first entry that its name contains, else the last resort."""
    whole = F.create_map(*[F.lit(x) for pair in table for x in pair])
    listed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in table])
    within = F.get(F.filter(listed, lambda e: F.contains(name, e["a"])), F.lit(0))["b"]
    return F.coalesce(F.element_at(whole, name), within, F.lit(last))


def weight_distance(weight: Column, wanted: int) -> Column:
    """Order of weights by nearness; of two equally near, the bolder if 500 or more is wanted, else the lighter."""
    return F.struct(F.abs(weight - wanted).alias("far"), (-weight if wanted >= 500 else weight).alias("side"))


def yaml_escape(text: Column) -> Column:
    """A double-quoted YAML scalar."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), text, F.lit('"'))


def _flip(key_hex: Column, value: int) -> Column:
    """A hex key padded to a block of 64 bytes, every byte xor ``value``, in binary."""
    padded = F.rpad(key_hex, 128, "0")
    # Eight bytes at a time: 15 hex digits fit a long without its sign.
    mask = f"{value:02x}" * 4
    parts = [F.lpad(F.hex(F.conv(F.substring(padded, 1 + 8 * i, 8), 16, 10).cast("long").bitwiseXOR(F.lit(int(mask, 16)))), 8, "0") for i in range(16)]
    return F.unhex(F.concat(*parts))


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC with SHA-256 over binary columns, in hex; keys over 64 bytes are hashed first."""
    hexed = F.when(F.octet_length(key) > 64, F.sha2(key, 256)).otherwise(F.hex(key))
    inner = F.unhex(F.sha2(F.concat(_flip(hexed, 0x36), message), 256))
    return F.sha2(F.concat(_flip(hexed, 0x5C), inner), 256)


def pbkdf2_sha256(password: Column, salt: Column, rounds: int, length: int = 32) -> Column:
    """A key derived from binary columns; iterated, so in Arrow batches of Python's own."""

    @F.arrow_udf("binary")
    def derived(passwords: pa.Array, salts: pa.Array) -> pa.Array:
        pairs = zip(passwords.to_pylist(), salts.to_pylist(), strict=True)
        return pa.array([None if p is None or s is None else hashlib.pbkdf2_hmac("sha256", p, s, rounds, length) for p, s in pairs], pa.binary())

    return derived(password, salt)


def to_base64(raw: Column) -> Column:
    """Base64 in one line."""
    return F.translate(F.base64(raw), "\r\n", "")


def from_base64(text: Column) -> Column:
    """Bytes of base64 that may hold other characters and lack its padding."""
    clean = F.regexp_replace(text, "[^A-Za-z0-9+/]", "")
    whole = F.substring(clean, F.lit(1), F.length(clean) - F.when(F.length(clean) % 4 == 1, 1).otherwise(0))
    return F.unbase64(F.concat(whole, F.repeat(F.lit("="), F.pmod(-F.length(whole), F.lit(4)))))


def rotation(a: Column, b: Column) -> Column:
    """Degrees by which a matrix turns, from its first row."""
    return F.degrees(F.atan2(b, a))


def writing_mode(mode: Column) -> Column:
    return F.when(mode == 1, "vertical").otherwise("horizontal")


def concat_matrix(a: Column, b: Column) -> Column:
    """Arrays of six numbers: what ``a`` does, followed by ``b``."""
    return F.array(
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def appearance(kind: Column, contents: Column, rect: Column) -> Column:
    """The content stream that shows a note or a highlight; empty for other annotations."""
    w, h = rect[2] - rect[0], rect[3] - rect[1]
    number = lambda x: F.format_string("%.2f", x)
    note = F.concat(F.lit("q\n1 1 0.6 rg\n0 0 "), number(w), F.lit(" "), number(h), F.lit(" re\nf\nBT\n/Helv 10 Tf\n0 g\n2 "), number(h - 12), F.lit(" Td\n("), contents, F.lit(") Tj\nET\nQ\n"))
    mark = F.concat(F.lit("q\n1 1 0 rg\n0 0 "), number(w), F.lit(" "), number(h), F.lit(" re\nf\nQ\n"))
    return F.when(kind == "Text", note).when(kind == "Highlight", mark).otherwise("")


def icc_header(profile: Column) -> Column:
    """Size, version, class, colour space and connection space of an ICC profile; null if it is none."""
    word = lambda at: F.conv(F.hex(F.substring(profile, at + 1, 4)), 16, 10).cast("long")
    text = lambda at: F.trim(F.substring(profile, at + 1, 4).cast("string"))
    major = F.conv(F.hex(F.substring(profile, 9, 1)), 16, 10).cast("int")
    minor = F.substring(F.hex(F.substring(profile, 10, 1)), 1, 1)
    found = F.struct(
        word(0).alias("size"), F.concat_ws(".", major.cast("string"), minor).alias("version"), text(12).alias("device_class"),
        text(16).alias("space"), text(20).alias("connection"),
    )
    return F.when((F.octet_length(profile) >= 128) & (text(36) == "acsp"), found)


def rgb_to_xyz(rgb: Column, matrix: tuple) -> Column:
    """Linear RGB by a row-major 3 x 3 matrix."""
    return F.array(*[sum((rgb[j] * float(matrix[3 * i + j]) for j in range(3)), F.lit(0.0)) for i in range(3)])
