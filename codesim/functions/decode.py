"""Bytes to text: which character set a file is in, as Column expressions.

In this order: a byte order mark; UTF-16 without mark, if the bytes are pairs of which at least ``ZERO_SHARE`` have a zero
first (big-endian) or second (little-endian) byte, as texts of Latin letters have; UTF-8, if the bytes are valid; else the
statistics of the broken bytes decide: a text with more whole multi-byte characters than invalid stretches is damaged UTF-8 (each invalid
stretch becomes U+FFFD), any other is in a single-byte set, read as Windows-1252, of which Latin-1 text is a part.
All bytes are looked at.  Null stays null; no bytes are an empty text in UTF-8.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_SHARE = 0.4
#: The characters of Windows-1252 for the bytes 80 to 9F, where it differs from Latin-1; five bytes have none.
WINDOWS = {
    0x80: "\u20ac", 0x82: "\u201a", 0x83: "\u0192", 0x84: "\u201e", 0x85: "\u2026", 0x86: "\u2020", 0x87: "\u2021",
    0x88: "\u02c6", 0x89: "\u2030", 0x8A: "\u0160", 0x8B: "\u2039", 0x8C: "\u0152", 0x8E: "\u017d", 0x91: "\u2018",
    0x92: "\u2019", 0x93: "\u201c", 0x94: "\u201d", 0x95: "\u2022", 0x96: "\u2013", 0x97: "\u2014", 0x98: "\u02dc",
    0x99: "\u2122", 0x9A: "\u0161", 0x9B: "\u203a", 0x9C: "\u0153", 0x9E: "\u017e", 0x9F: "\u0178",
}


#: A well-formed run of big-endian units in hexadecimal digits, without lone surrogates.
UTF_16 = "\\A(?:(?!D[89A-F])[0-9A-F]{4}|D[89AB][0-9A-F]{2}D[C-F][0-9A-F]{2})*+\\z"
UTF_16_LE = "\\A(?:[0-9A-F]{2}(?!D[89A-F])[0-9A-F]{2}|[0-9A-F]{2}D[89AB][0-9A-F]{2}D[C-F])*+\\z"
UTF_32 = "\\A(?:(?!0000D[89A-F])00(?:0[0-9A-F]|10)[0-9A-F]{4})*+\\z"


def _units(data: Column, unit: str) -> Column:
    """How many of the two-byte units match ``unit``, four hexadecimal digits.  Every alternative takes a run of four digits each, so the
    matches stay on unit borders, and a text of one alphabet is few matches."""
    kept = F.regexp_replace(F.hex(data), f"((?:{unit})++)|(?:(?!{unit})[0-9A-F]{{4}})++", "$1")
    return F.length(kept) / 4


def _turned(digits: Column, size: int) -> Column:
    """Hexadecimal digits with the bytes of each unit of ``size`` bytes in the other order."""
    byte = "([0-9A-F]{2})"
    return F.regexp_replace(digits, byte * size, "".join(f"${i}" for i in range(size, 0, -1)))


def charset(data) -> Column:
    """UTF-8, UTF-16LE, UTF-16BE, UTF-32LE, UTF-32BE or windows-1252."""
    data = F.col(data) if isinstance(data, str) else data
    digits, head = F.hex(data), F.hex(F.substring(data, 1, 4))
    size, text = F.octet_length(data), data.cast("string")
    pairs = F.contains(data, F.lit(b"\x00")) & (size % 2 == 0)
    repaired = F.make_valid_utf8(text)
    stretches = F.length(repaired) - F.length(F.translate(repaired, "\ufffd", ""))
    whole = F.length(F.regexp_replace(repaired, "[\\x{0}-\\x{7f}\\x{fffd}]", ""))
    return (F.when(data.isNull(), None)
            .when((head == "FFFE0000") & _turned(digits, 4).rlike(UTF_32), "UTF-32LE")
            .when((head == "0000FEFF") & digits.rlike(UTF_32), "UTF-32BE")
            .when(F.startswith(head, F.lit("EFBBBF")), "UTF-8")
            .when(F.startswith(head, F.lit("FFFE")), "UTF-16LE").when(F.startswith(head, F.lit("FEFF")), "UTF-16BE")
            .when(pairs & (_units(data, "00[0-9A-F]{2}") >= ZERO_SHARE * size / 2), "UTF-16BE")
            .when(pairs & (_units(data, "[0-9A-F]{2}00") >= ZERO_SHARE * size / 2), "UTF-16LE")
            .when(F.is_valid_utf8(text), "UTF-8")
            .when(whole > stretches, "UTF-8")
            .otherwise("windows-1252"))


def _utf_16(digits: Column) -> Column:
    """The text of big-endian units; a lone surrogate, and a last single byte, become U+FFFD."""
    even = F.substring(digits, F.lit(1), F.length(digits) - F.length(digits) % 4)
    apart = F.regexp_replace(even, "([0-9A-F]{4})", "$1 ")
    mended = F.regexp_replace(F.regexp_replace(apart, "D[89AB][0-9A-F]{2} (?!D[C-F])", "FFFD "), "(?<!D[89AB][0-9A-F]{2} )D[C-F][0-9A-F]{2} ", "FFFD ")
    sound = F.when(even.rlike(UTF_16), even).otherwise(F.translate(mended, " ", ""))
    return F.concat(F.decode(F.unhex(sound), "UTF-16BE"), F.when(F.length(digits) % 4 == 0, "").otherwise("\ufffd"))


def _well_formed(data: Column, digits: Column, little: bool) -> Column:
    """The text of two-byte units: decoded as it is if nothing in it is broken, else mended first."""
    sound = (F.length(digits) % 4 == 0) & digits.rlike(UTF_16_LE if little else UTF_16)
    return F.when(sound, F.decode(data, "UTF-16LE" if little else "UTF-16BE")).otherwise(_utf_16(_turned(digits, 2) if little else digits))


def text_in(data, name) -> Column:
    """The text of ``data`` in the character set ``name``, without its byte order mark; broken stretches become U+FFFD."""
    data, name = (F.col(c) if isinstance(c, str) else c for c in (data, name))
    digits = F.hex(data)
    # Latin-1 turns every byte into the character of the same number
    single = F.translate(F.decode(data, "ISO-8859-1"), "".join(map(chr, WINDOWS)), "".join(WINDOWS.values()))
    text = (F.when(name == "windows-1252", single)
            .when(name == "UTF-16BE", _well_formed(data, digits, False)).when(name == "UTF-16LE", _well_formed(data, digits, True))
            .when(name.isin("UTF-32BE", "UTF-32LE"), F.decode(data, "UTF-32"))  # goes by its mark
            .otherwise(F.make_valid_utf8(data.cast("string"))))
    return F.regexp_replace(text, "\\A\\x{feff}", "")


def decoded(data) -> Column:
    """The text of ``data`` in the character set its bytes tell."""
    return text_in(data, charset(data))
