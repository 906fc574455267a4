"""Prices, codes and quantities out of product texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import BOUNDARY

LOWEST, HIGHEST = 1_000, 1_000_000_000

# The shape of a product code, words that are none, and known prefixes.
CODE = r"(?:[A-Z]{2,}[A-Z0-9]*[-_/][A-Z0-9][A-Z0-9._\-/]{1,}|[A-Z]{2,}\d{2,}[A-Z0-9._\-/]*|[A-Z0-9]{2,}-[A-Z0-9]{2,}(?:[-_/][A-Z0-9]{1,})*)"
NO_CODES = "^(VAT|TEL|HOTLINE|EMAIL|WWW|HTTP|HTTPS|MODEL|CODE|SKU)$"
KNOWN_CODES = r"^(OSN|DDL|SBX|K\d|R\d|LM|LS|SNT|KBT|NVR|DVR|DS|IPC|HAC|HD|MS|AQA|LUMI)"


def price_candidates(text: Column) -> Column:
    """All prices in a text, ascending, repeats kept: grouped thousands, and plain runs of 5 to 10 digits."""
    text = F.coalesce(text, F.lit(""))
    grouped = F.regexp_extract_all(text, F.lit(r"[0-9]{1,3}(?:[.,][0-9]{3}){1,4}"), F.lit(0))
    plain = F.regexp_extract_all(text, F.lit(BOUNDARY + "[0-9]{5,10}" + BOUNDARY), F.lit(0))
    numbers = F.transform(F.concat(grouped, plain), lambda x: F.regexp_replace(x, "[.,]", "").cast("long"))
    return F.array_sort(F.filter(numbers, lambda n: n.between(LOWEST, HIGHEST)))


def safe_price(text: Column) -> Column:
    """The smallest price of a text, else 0."""
    return F.coalesce(F.get(price_candidates(text), F.lit(0)), F.lit(0).cast("long"))


def code_candidates(text: Column) -> Column:
    """Product codes in a text in the order in which they first occur."""
    plain = F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[\u00a0\t\r\n|]+", " ")
    found = F.regexp_extract_all(plain, F.lit(BOUNDARY + CODE + BOUNDARY), F.lit(0))
    trimmed = F.transform(found, lambda c: F.regexp_replace(c, r"^[^A-Z0-9]+|[^A-Z0-9._\-/]+$", ""))
    good = lambda c: ~c.rlike(NO_CODES) & F.length(c).between(4, 40) & c.rlike("[A-Z]") & c.rlike("[0-9]")
    return F.array_distinct(F.filter(trimmed, good))


def code_score(c: Column) -> Column:
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    return (
        points(c.rlike("[-_/]"), 8) + points(c.rlike("^[A-Z]{2,}[-_/]"), 4) + points(c.rlike("^[A-Z]{2,}[0-9]"), 2)
        + points(F.length(c).between(6, 22), 2) + points(F.length(c) > 28, -3) + points(c.rlike(KNOWN_CODES), 2)
    )


def best_code(text: Column) -> Column:
    """The code with the highest score, then the shortest, then the first; '' without any."""
    ranked = F.transform(code_candidates(text), lambda c, i: F.struct(code_score(c).alias("score"), (-F.length(c)).alias("short"), (-i).alias("first"), c.alias("code")))
    return F.coalesce(F.array_max(ranked)["code"], F.lit(""))


def quantity(text: Column) -> Column:
    """The first number of a text with a comma as decimal point; null for dates, for none, below or at 0 and above 100,000."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit("."))
    number = F.regexp_extract(plain, r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")
    return F.when(~plain.rlike(r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}") & (number > 0) & (number <= 100_000), number)


def money_values(line: Column) -> Column:
    """Amounts of 5 to 10 digits from 10,000 to 999,000,000 in the order in which they first occur."""
    found = F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit("(?:[0-9]{1,3}(?:[.,][0-9]{3}){1,3}|[0-9]{5,10})"), F.lit(0))
    digits = F.filter(F.transform(found, lambda x: F.regexp_replace(x, "[.,]", "")), lambda d: F.length(d).between(5, 10))
    return F.array_distinct(F.filter(F.transform(digits, lambda d: d.cast("long")), lambda n: n.between(10_000, 999_000_000)))


def price_fields(values: Column) -> Column:
    """Of distinct amounts: the least as cost, the greatest of several as list price, the second of three or more as least retail price; else 0."""
    up, none = F.array_sort(values), F.lit(0).cast("long")
    at = lambda k: F.coalesce(F.get(up, F.lit(k)), none)
    n = F.size(up)
    return F.struct(
        at(0).alias("cost"), F.when(n > 1, F.element_at(up, -1)).otherwise(none).alias("listed"), F.when(n > 2, at(1)).otherwise(none).alias("retail")
    )
