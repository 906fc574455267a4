"""Lines of a page out of runs of glyphs with positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import SPACES, clean_text

#: Runs closer than this in height belong to one line.
NEAR = 2.0
PAGE_CHARS = 26_000


def tenths(x: Column) -> Column:
    return F.floor(F.coalesce(x, F.lit(0.0)) * 10 + 0.5) / 10


def page_lines(runs: DataFrame, page: list[str], order: str, text: str = "str", x: str = "x", y: str = "y") -> DataFrame:
    """Lines of each page, from the top: page columns, line (from 0), y, text.

    Runs are taken in their order; each joins the first line there is whose first run is less than 2 away in height, else begins
    one. So a line's place depends on what came before. Runs of one height share a line, and a line that comes later changes
    nothing for those before it: only a page's distinct heights are folded, into those that begin lines, and then each run finds its own.
    In a line runs stand by x, equal ones in their order; of lines of equal height the older comes first. Blank runs are left
    out, missing positions count as 0; runs of equal order are taken by height, x and text.
    """
    run = F.struct(F.col(order).alias("o"), tenths(F.col(y)).alias("y"), tenths(F.col(x)).alias("x"), F.col(text).alias("str"))
    pages = runs.where(F.col(text).rlike(f"[^{SPACES}]")).groupBy(*page).agg(F.sort_array(F.collect_list(run)).alias("runs"))
    near = lambda a, b: F.abs(a - b) < NEAR
    add = lambda firsts, h: F.when(F.exists(firsts, lambda f: near(f, h)), firsts).otherwise(F.concat(firsts, F.array(h)))
    firsts = F.aggregate(F.array_distinct(F.col("runs.y")), F.array().cast("array<double>"), add)
    at = lambda r: F.array_position(F.transform("firsts", lambda f: near(f, r["y"])), F.lit(True)).cast("int") - 1
    placed = F.sort_array(F.transform("runs", lambda r, k: F.struct(at(r).alias("i"), r["x"].alias("x"), k.alias("k"), r["str"].alias("str"))))
    lines = pages.select(*page, "runs", firsts.alias("firsts")).select(*page, "firsts", placed.alias("placed"))
    whole = lambda i: F.array_join(F.transform(F.filter("placed", lambda p: p["i"] == i), lambda p: p["str"]), " ")
    ranked = F.sort_array(F.transform("firsts", lambda h, i: F.struct((-h).alias("down"), i.alias("i"), whole(i).alias("text"))))
    out = lines.select(*page, F.posexplode(ranked).alias("line", "l"))
    return out.select(*page, "line", (-F.col("l.down")).alias("y"), clean_text(F.col("l.text")).alias("text"))


def page_text(x: Column) -> Column:
    """A page's text without nulls, with single blanks and at most one empty line, 26,000 characters at most."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "\x00", ""), "[\t ]+", " ")
    return F.substring(F.regexp_replace(F.regexp_replace(plain, "\n{3,}", "\n\n"), r"^\s+|\s+$", ""), 1, PAGE_CHARS)
