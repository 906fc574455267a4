"""Regular expressions that Spark and an ASCII-boundary engine read alike."""

from __future__ import annotations

from pyspark.sql import Column

from tessella.functions.text import BOUNDARY, clean_text, fold
from pyspark.sql import functions as F


def hits(x: Column, pattern: str) -> Column:
    """Whether a pattern occurs in a text, whatever the case; its word boundaries know ASCII words only."""
    return F.coalesce(x, F.lit("")).rlike("(?iu)" + pattern.replace(r"\b", BOUNDARY))


def plain(x: Column) -> Column:
    """Single blanks, no accents, lower case; punctuation stays."""
    return F.lower(fold(clean_text(x)))


def joined(*columns: Column) -> Column:
    """The texts that are not empty, with blanks between."""
    return F.array_join(F.filter(F.array(*columns), lambda t: F.coalesce(t, F.lit("")) != ""), " ")


def first_of(x: Column, rules: list[tuple[str, str]], test=hits) -> Column:
    """The name of the first rule whose pattern fits, else null."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        found = F.when(test(x, pattern), F.lit(name)).otherwise(found)
    return found
