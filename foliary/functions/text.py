"""Text functions as column expressions: case folding, search positions, trigrams, escaping."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(text: Column) -> Column:
    """A-Z to lower case and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.transform(F.array(value), body)[0]


def _running(lengths: Column) -> Column:
    """Offsets at which pieces of these lengths begin."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    return F.aggregate(lengths, start, step, lambda a: a["out"])


def positions(text: Column, term: str, overlapping: bool = True) -> Column:
    """Offsets (code points, from 0) of a term. An empty term has none."""
    if not term:
        return F.array().cast("array<int>")
    if not overlapping:
        return _plain(text, term)
    # Cut before each occurrence: pieces begin where the term does, but for what precedes the first.
    pieces = F.split(text, f"(?={re.escape(term)})")
    at = _running(F.transform(pieces, F.length))
    return F.when(text.startswith(term), at).otherwise(F.slice(at, 2, F.greatest(F.size(at), F.lit(1))))


def _plain(text: Column, term: str) -> Column:
    """Offsets of occurrences that don't overlap, leftmost first."""
    ends = let(F.transform(F.split(text, re.escape(term)), F.length), lambda n: _running(F.transform(n, lambda x: x + len(term))))
    return F.transform(F.slice(ends, 2, F.greatest(F.size(ends), F.lit(1))), lambda x: x - len(term))


def count_overlapping(text: Column, term: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"(?=({re.escape(term)}))"), F.lit(1)))


def context(text: Column, at: Column, length: int, around: int = 30) -> Column:
    """The match with up to ``around`` characters on either side."""
    begin = F.greatest(at - around, F.lit(0))
    return F.substring(text, begin + 1, at + length + around - begin)


def trigrams(text: Column) -> Column:
    """All runs of three characters, in order; none for shorter texts."""
    chars = F.split(text, "")  # constant-time access, unlike substring on a long text
    return F.when(F.length(text) < 3, F.array().cast("array<string>")).otherwise(
        let(chars, lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(c[i], c[i + 1], c[i + 2])))
    )


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard index of two trigram arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance, ``most + 1`` where it is larger."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def xml_unescape(text: Column) -> Column:
    """The five predefined entities; &amp; last, so that nothing is decoded twice."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def json_escape(text: Column) -> Column:
    """A JSON string literal without its quotes."""
    return F.regexp_replace(F.to_json(F.struct(text.alias("v"))), r'^\{"v":"|"\}$', "")


def pdf_escape(text: Column) -> Column:
    """A PDF literal string's content."""
    for a, b in (("\\", "\\\\"), ("(", "\\("), (")", "\\)"), ("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def csv_field(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def codepoint_to_utf8(cp: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def utf16_text(raw: Column) -> Column:
    """A PDF text string: UTF-16BE after its byte-order mark, else one byte per character."""
    marked = F.substring(F.hex(raw), 1, 4) == "FEFF"
    return F.when(marked, F.decode(F.substring(raw, 3, 1 << 30), "UTF-16BE")).otherwise(F.decode(raw, "ISO-8859-1"))
