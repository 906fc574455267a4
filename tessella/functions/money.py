"""Prices as whole VND: rounding, sale prices, list prices, percentages, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity, also below zero: -2.5 becomes -2."""
    return F.floor(x + F.lit(0.5))


def round_thousand(x: Column) -> Column:
    return half_up(x / 1000) * 1000


def sale_price(mode: Column, cost: Column, listed: Column, factor: Column) -> Column:
    """Fixed products sell at their list price whatever the factor; others at cost times factor (1 if none) to the thousand."""
    factor = F.when(F.coalesce(factor, F.lit(0)) == 0, F.lit(1.0)).otherwise(factor)
    return F.when(mode == "fixed", listed.cast("double")).otherwise(round_thousand(F.coalesce(cost, F.lit(0)) * factor).cast("double"))


def first_price(*columns: Column) -> Column:
    """The first of the columns that is neither null nor zero, else zero."""
    return F.coalesce(*(F.nullif(c.cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))


def change_percent(old: Column, new: Column) -> Column:
    """Whole percent by which a price moved; 0 where there was none before."""
    return F.when(F.coalesce(old, F.lit(0)) == 0, F.lit(0)).otherwise(half_up((new - old) / old * 100)).cast("long")


def vnd(x: Column) -> Column:
    """Whole number with dots between thousands."""
    return F.translate(F.format_number(x, 0), ",", ".")


def bulk_percent(text: Column) -> Column:
    """'+5,5 %' as 5.5; null where it is no signed decimal."""
    plain = F.replace(F.replace(F.trim(text), F.lit("%"), F.lit("")), F.lit(","), F.lit("."))
    return plain.try_cast("double")
