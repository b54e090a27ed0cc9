"""Glyph names and the encodings of simple fonts."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Names of signs that no rule gives, as "name character" pairs.
SIGNS = dict(
    pair.split(" ", 1)
    for pair in """exclam !|quotedbl "|numbersign #|dollar $|percent %|ampersand &|quotesingle '|parenleft (|parenright )|asterisk *|plus +|comma ,|hyphen -
period .|slash /|colon :|semicolon ;|less <|equal =|greater >|question ?|at @|bracketleft [|backslash \\|bracketright ]|asciicircum ^|underscore _|grave `
braceleft {|bar ||braceright }|asciitilde ~|exclamdown ¡|cent ¢|sterling £|currency ¤|yen ¥|brokenbar ¦|section §|dieresis ¨|copyright ©|ordfeminine ª
guillemotleft «|logicalnot ¬|registered ®|macron ¯|degree °|plusminus ±|acute ´|mu µ|paragraph ¶|periodcentered ·|cedilla ¸|ordmasculine º|guillemotright »
onequarter ¼|onehalf ½|threequarters ¾|questiondown ¿|multiply ×|divide ÷|AE Æ|ae æ|OE Œ|oe œ|Eth Ð|eth ð|Thorn Þ|thorn þ|germandbls ß|dotlessi ı|florin ƒ
circumflex ˆ|caron ˇ|breve ˘|dotaccent ˙|ring ˚|ogonek ˛|tilde ˜|hungarumlaut ˝|endash –|emdash —|quoteleft ‘|quoteright ’|quotesinglbase ‚|quotedblleft “
quotedblright ”|quotedblbase „|dagger †|daggerdbl ‡|bullet •|ellipsis …|perthousand ‰|guilsinglleft ‹|guilsinglright ›|fraction ⁄|Euro €|trademark ™|minus −
fi fi|fl fl|ff ff|ffi ffi|ffl ffl|infinity ∞|notequal ≠|lessequal ≤|greaterequal ≥|approxequal ≈|summation ∑|product ∏|integral ∫|radical √|partialdiff ∂
lozenge ◊|arrowleft ←|arrowup ↑|arrowright →|arrowdown ↓|nbspace  |softhyphen ­""".replace("\n", "|").replace("bar ||", "bar \x00|").split("|")
) | {"space": " ", "bar": "|"}
ACCENTS = {
    "acute": "ACUTE", "grave": "GRAVE", "circumflex": "CIRCUMFLEX", "dieresis": "DIAERESIS", "tilde": "TILDE", "ring": "RING ABOVE", "cedilla": "CEDILLA",
    "caron": "CARON", "macron": "MACRON", "breve": "BREVE", "ogonek": "OGONEK", "dotaccent": "DOT ABOVE", "hungarumlaut": "DOUBLE ACUTE",
    "slash": "STROKE", "croat": "STROKE", "bar": "STROKE", "commaaccent": "CEDILLA",
}
LETTER = re.compile(rf"([A-Za-z])({'|'.join(ACCENTS)})")
UNKNOWN = "�"

# Where StandardEncoding differs from ASCII, as first code and names from there on.
STANDARD = {
    0x27: "quoteright", 0x60: "quoteleft", 0xA1: "exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl",
    0xB1: "endash dagger daggerdbl periodcentered", 0xB6: "paragraph bullet quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand", 0xBF: "questiondown",
    0xC1: "grave acute circumflex tilde macron breve dotaccent dieresis", 0xCA: "ring cedilla", 0xCD: "hungarumlaut ogonek caron emdash", 0xE1: "AE", 0xE3: "ordfeminine",
    0xE8: "Lslash Oslash OE ordmasculine", 0xF1: "ae", 0xF5: "dotlessi", 0xF8: "lslash oslash oe germandbls",
}
# The Greek letters of the Symbol font from A and from a.
SYMBOL = {0x41: "ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ", 0x61: "αβχδεφγηιϕκλμνοπθρστυϖωξψζ"}


def _looked_up(name: str) -> str | None:
    try:
        return unicodedata.lookup(name)
    except KeyError:
        return None


@lru_cache(4096)
def glyph(name: str) -> str:
    """The text of a glyph name; U+FFFD for a name that says nothing.

    Signs come from a list; letters with accents, digits and Greek letters from their Unicode names;
    "uni" and "u" names say their codes; parts joined by "_" are taken one by one and what follows a
    "." is a variant's.
    """
    name = name.split(".", 1)[0] if not name.startswith(".") else ""
    if "_" in name:
        return "".join(map(glyph, name.split("_")))
    if len(name) == 1:
        return name
    if name in SIGNS:
        return SIGNS[name]
    if re.fullmatch("uni(?:[0-9A-F]{4})+", name):
        return "".join(chr(int(name[i : i + 4], 16)) for i in range(3, len(name), 4))
    if (m := re.fullmatch("u([0-9A-F]{4,6})", name)) and int(m[1], 16) < 0x110000:
        return chr(int(m[1], 16))
    if m := LETTER.fullmatch(name):
        size = "SMALL" if m[1].islower() else "CAPITAL"
        if found := _looked_up(f"LATIN {size} LETTER {m[1].upper()} WITH {ACCENTS[m[2]]}"):
            return found
    if m := re.fullmatch("afii([0-9]{5})", name):
        return _cyrillic(int(m[1]))
    if name.islower() and (found := _looked_up(f"DIGIT {name.upper()}")):
        return found
    if name.isalpha():
        size = "SMALL" if name.islower() else "CAPITAL"
        if found := _looked_up(f"GREEK {size} LETTER {'LAMDA' if name.lower() == 'lambda' else name.upper()}"):
            return found
    return UNKNOWN


def _cyrillic(number: int) -> str:
    """Russian letters by their numbers: capitals from 10017, small ones from 10065, each with Io in seventh place."""
    for first, start, io in ((10017, 0x410, "Ё"), (10065, 0x430, "ё")):
        at = number - first
        if 0 <= at < 33:
            return io if at == 6 else chr(start + at - (at > 6))
    return UNKNOWN


@lru_cache(8)
def encoding(name: str) -> tuple[str, ...]:
    """The text of each of 256 codes."""
    if name == "Symbol":
        table = [chr(c) if 32 <= c < 127 else UNKNOWN for c in range(256)]
        for first, letters in SYMBOL.items():
            table[first : first + len(letters)] = letters
        return tuple(table)
    if name == "StandardEncoding":
        table = [chr(c) if 32 <= c < 127 else UNKNOWN for c in range(256)]
        for first, names in STANDARD.items():
            for i, one in enumerate(names.split()):
                table[first + i] = glyph(one)
        return tuple(table)
    codec = {"MacRomanEncoding": "mac_roman", "WinAnsiEncoding": "cp1252"}.get(name, "latin-1")
    table = [bytes([c]).decode(codec, "replace") for c in range(256)]
    if name == "WinAnsiEncoding":  # unused codes from 41 up show a bullet
        table = [("•" if t == UNKNOWN and c > 0o40 else t) for c, t in enumerate(table)]
    return tuple(table)
