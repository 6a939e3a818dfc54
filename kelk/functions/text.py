"""Text expressions that stay inside the JVM: digits, letters, blanks, tokens, lexicon counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
WIDE_DIGITS = "０１２３４５６７８９"
#: Characters that take no room: soft hyphen, joiners, directional marks, byte order mark.
ZERO_WIDTH = "\u00ad\u061c\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2066\u2067\u2068\u2069\ufeff"
#: Forms of the blank other than U+0020.
BLANKS = "\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def ascii_digits(col: Column) -> Column:
    """Digits of any of the three foreign sets as 0-9; zero-width characters vanish, all blanks become U+0020."""
    source = PERSIAN_DIGITS + ARABIC_DIGITS + WIDE_DIGITS + BLANKS + ZERO_WIDTH
    return F.translate(col, source, "0123456789" * 3 + " " * len(BLANKS))


def plain_letters(col: Column) -> Column:
    """The Arabic yeh, alef maksura and kaf as their Persian counterparts."""
    return F.translate(col, "يىك", "ییک")


def squeeze(col: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def is_blank(col: Column) -> Column:
    """True for null, empty and white space only."""
    return F.coalesce(F.regexp_replace(col, r"(?U)\s+", "") == "", F.lit(True))


def words(col: Column, pattern: str = r"(?U)\S+") -> Column:
    """All matches of the word pattern, in order; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def alternation(terms: Sequence[str]) -> str:
    """A pattern of the terms, longest first, each quoted."""
    import re

    ordered = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    return "|".join(re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", t) for t in ordered)


def guarded(terms: Sequence[str]) -> str:
    """The alternation behind a look ahead at the range of its first characters, which rules out most places at once."""
    firsts = sorted({ord(t[0]) for t in terms if t})
    ranges = [part for part in ([c for c in firsts if c < 0x10000], [c for c in firsts if c >= 0x10000]) if part]
    shown = "".join(f"\\x{{{part[0]:x}}}-\\x{{{part[-1]:x}}}" for part in ranges)
    return f"(?=[{shown}])(?:{alternation(terms)})"


def count_any(col: Column, terms: Sequence[str]) -> Column:
    """Non-overlapping occurrences of any term, longest first; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(guarded(terms))), F.lit(0)).cast("bigint")


def count_in(tokens: Column, terms: Sequence[str]) -> Column:
    """Tokens of an array that belong to the terms."""
    lexicon = F.array(*[F.lit(t) for t in sorted(set(terms))])
    return F.size(F.filter(tokens, lambda t: F.array_contains(lexicon, t))).cast("bigint")


def drop_decimal_zero(col: Column) -> Column:
    """'123.0' as '123': ids that went through a floating point column."""
    return F.regexp_replace(F.trim(col), r"^([+-]?\d+)\.0+$", "$1")
