"""Page text cut into chunks of whole lines for an extractor, and chunks cut in half."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import clean_text
from tessella.operators.staging import kept

CHARS, LINES, SPLITTABLE = 850, 8, 160
# A block of lines is 2 ** BLOCK_BITS of them at most.
BLOCK_BITS = 11


def smart_lines(text: Column) -> Column:
    """The lines that are not blank, with single blanks."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n+"), lambda x: clean_text(x)), lambda x: x != "")


def _next_starts(sizes: list[int], ahead: list[int], chars: int, most: int) -> list[int]:
    """For each line of a block, where the chunk after one that starts there would start; it may lie among the lines ahead."""
    ends = np.cumsum([0, *sizes, *ahead])
    starts = np.arange(len(sizes))
    fit = np.searchsorted(ends, ends[: len(sizes)] + chars, side="right") - 1
    return np.maximum(starts + 1, np.minimum(starts + most, fit)).tolist()


def _passage(sizes: list[int], ahead: list[int], chars: int, most: int) -> tuple[list[int], list[int]]:
    """For each place where a chunk may start first in a block: where the first one behind it starts, and how many start within."""
    n, after = len(sizes), _next_starts(sizes, ahead, chars, most)
    out, count = list(range(-n, most)), [0] * (n + most)
    for i in range(n - 1, -1, -1):
        out[i], count[i] = out[after[i]], count[after[i]] + 1
    return out[:most], count[:most]


def _parts(sizes: list[int], ahead: list[int], first: int, before: int, chars: int, most: int) -> list[int]:
    """The chunk of each line of a block whose first start is `first`, after `before` chunks of the page."""
    after, part, i = _next_starts(sizes, ahead, chars, most), np.zeros(len(sizes), np.int64), first
    while i < len(sizes):
        part[i] += 1
        i = after[i]
    return (np.cumsum(part) + before - 1).tolist()


def chunk_lines(lines: DataFrame, chars: int = CHARS, most: int = LINES) -> DataFrame:
    """(file, page, chunk, text, n_lines) of lines (file, page, n, line), n their order in a page; as `chunk_pages`.

    Lines are sorted over all tasks and cut into blocks of some 2,000. Where a chunk starts depends on the one before,
    but the first to start in a block is one of its first `most` lines: each block says for each of these where the
    next block's first start is, and a page is a fold over its blocks. No task holds more than blocks, whatever a page has.
    """
    clean = lines.select("file", "page", "n", clean_text(F.col("line")).alias("line")).where("line <> ''")
    placed = clean.repartitionByRange("file", "page", "n").sortWithinPartitions("file", "page", "n").withColumn("pos", F.monotonically_increasing_id())
    placed = kept(placed.select("file", "page", "pos", "line"))
    here = ["file", "page", F.shiftright("pos", BLOCK_BITS).alias("block")]
    of = placed.groupBy(*here).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("of"))
    sized = of.withColumn("sizes", F.transform("of", lambda x: F.length(x["line"]) + 1))
    following = Window.partitionBy("file", "page").orderBy("block").rowsBetween(1, most)
    # a row a block here: some lines ahead of it, however few the next blocks have
    ahead = sized.select("file", "page", "block", "sizes").withColumn("ahead", F.slice(F.flatten(F.collect_list(F.slice("sizes", 1, most)).over(following)), 1, most))

    @F.pandas_udf("out array<int>, count array<int>")
    def passage(sizes: pd.Series, then: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_passage(list(s), list(t), chars, most) for s, t in zip(sizes, then, strict=True)], columns=["out", "count"])

    @F.pandas_udf("array<bigint>")
    def parts(sizes: pd.Series, then: pd.Series, first: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([_parts(list(s), list(t), f, b, chars, most) for s, t, f, b in zip(sizes, then, first, before, strict=True)])

    blocks = ahead.withColumn("p", passage("sizes", "ahead"))
    begin = F.struct(F.lit(0).alias("first"), F.lit(0).cast("long").alias("before"), F.array().cast("array<struct<block:bigint,first:int,before:bigint>>").alias("of"))

    def step(s: Column, x: Column) -> Column:
        entry = F.struct(x["block"].alias("block"), s["first"].alias("first"), s["before"].alias("before"))
        return F.struct(F.get(x["out"], s["first"]).alias("first"), (s["before"] + F.get(x["count"], s["first"])).alias("before"), F.concat(s["of"], F.array(entry)).alias("of"))

    pages = blocks.groupBy("file", "page").agg(F.array_sort(F.collect_list(F.struct("block", "p.out", "p.count"))).alias("b")).withColumn("s", F.aggregate("b", begin, step))
    pages = kept(pages.select("file", "page", "s.of", F.col("s.before").alias("n_chunks")))
    earlier = F.coalesce(F.sum("n_chunks").over(Window.partitionBy("file").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    entries = pages.withColumn("earlier", earlier).select(F.col("file").alias("f"), F.col("page").alias("g"), "earlier", F.inline("of")).withColumnRenamed("block", "b")
    same = F.col("file").eqNullSafe(F.col("f")) & F.col("page").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b"))
    numbered = ahead.join(entries, same).select("file", "page", "block", "earlier", parts("sizes", "ahead", "first", "before").alias("parts"))
    both = of.alias("o").join(numbered.alias("m"), F.col("o.file").eqNullSafe(F.col("m.file")) & F.col("o.page").eqNullSafe(F.col("m.page")) & (F.col("o.block") == F.col("m.block")))
    rows = both.select("o.file", "o.page", "earlier", F.inline(F.arrays_zip("of", "parts"))).select("file", "page", "earlier", F.col("parts").alias("part"), "of")
    chunks = rows.groupBy("file", "page", "part").agg(F.first("earlier").alias("earlier"), F.array_sort(F.collect_list("of")).alias("mine"))
    return chunks.select("file", "page", (F.col("earlier") + F.col("part") + 1).cast("int").alias("chunk"), F.array_join(F.transform("mine", lambda x: x["line"]), "\n").alias("text"), F.size("mine").alias("n_lines"))


def chunk_pages(pages: DataFrame, chars: int = CHARS, most: int = LINES) -> DataFrame:
    """(file, page, chunk, text, n_lines) of pages (file, page, text): chunks count from 1 in a file and never reach over a page.

    A chunk ends before the line that would make it longer than `chars` (each line and
    its end counted) or than `most` lines; a longer line is a chunk of its own. Pages without lines give nothing.
    """
    return chunk_lines(pages.select("file", "page", F.posexplode(smart_lines(F.col("text"))).alias("n", "line")), chars, most)


def halves(text: Column) -> Column:
    """The first and the second half of a chunk's lines as two texts; null for a short chunk or one line."""
    lines = smart_lines(text)
    n = F.size(lines)
    mid = F.greatest(F.lit(1), F.floor(n / 2).cast("int"))
    short = ((n < 4) & (F.length(text) < SPLITTABLE)) | (n < 2)
    part = lambda begin, length: F.array_join(F.slice(lines, begin, length), "\n")
    return F.when(~short, F.array(part(F.lit(1), mid), part(mid + 1, F.greatest(n - mid, F.lit(0)))))
