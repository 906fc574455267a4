"""Text keys: accent folding, the match keys made of it, FNV-1a, issue slugs."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript has it, for character classes.
SPACES = "\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: A word boundary that knows ASCII words only.
BOUNDARY = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _fold_table() -> tuple[str, str]:
    """Latin letters that decompose into a base letter and marks, and their base letters."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all(map(unicodedata.combining, marks)):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _fold_table()


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def clean_text(x: Column) -> Column:
    """Null as '', runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(_text(x), f"[{SPACES}]+", " "))


def fold(x: Column) -> Column:
    """Without accents; the barred d becomes d."""
    return F.regexp_replace(F.translate(_text(x), _FROM + "đĐ", _TO + "dD"), "[\u0300-\u036f]", "")


def match_key(x: Column) -> Column:
    """Lower case, folded, letters and digits only."""
    return F.regexp_replace(fold(F.lower(x)), "[^a-z0-9]", "")


def learning_key(x: Column) -> Column:
    """Lower case, folded, runs of anything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(fold(F.lower(x)), "[^a-z0-9]+", " "))


def web_key(x: Column) -> Column:
    """As match_key but the barred d is dropped, at most 140 characters."""
    plain = F.regexp_replace(F.translate(F.lower(_text(x)), _FROM, _TO), "[^a-z0-9]", "")
    return F.substring(plain, 1, 140)


def sku_key(x: Column) -> Column:
    """Lower case without blanks, dashes, slashes, dots and underscores; accents stay."""
    return F.regexp_replace(F.lower(_text(x)), f"[{SPACES}\\-/._]", "")


def slug(x: Column, most: int = 48) -> Column:
    """Folded words joined by underscores."""
    return F.substring(F.regexp_replace(F.regexp_replace(fold(F.lower(x)), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, most)


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a over characters, as 8 hex digits."""
    codes = F.transform(F.filter(F.split(_text(x), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    value = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.lpad(F.hex(value), 8, "0"))
