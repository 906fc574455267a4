"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks of `block` units (characters, tokens or rows).
With weight w, block k of a source, counted from 0, is released at slot
floor(k / w) and due before slot ceil((k + 1) / w). In each slot the released
block with the earliest deadline goes (then the heavier source, then its name).
Weights are whole shares of `period`, so the schedule repeats after `period` slots
and only one period is ever worked out, whatever the corpus: block k of a source
with p shares is block k mod p of period k div p. At every slot each source is
less than one block away from its share.

Block numbers come from running sums in two levels, ranges of a uniform hash and
rows inside a range, so a source with a third of all rows is numbered by many
tasks.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import stage

#: The driver works out one period, of MOST_SLOTS slots at most unless there are more sources.
PERIOD, MOST_SLOTS, RANGE_ROWS = 10_000, 1 << 20, 20_000


def shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole shares that add up to the period, by largest remainders; a positive weight has one at least."""
    if not weights:
        return {}
    if len(weights) > period or min(weights.values()) < 0 or not sum(weights.values()):
        raise ValueError("weights must be 0 or more, not all 0, and no more than the period has slots")
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(int(x), int(x > 0)) for s, x in exact.items()}
    while (left := period - sum(out.values())) != 0:
        up = left > 0
        free = [s for s in exact if exact[s] > 0 and (up or out[s] > 1)]
        s = min(free, key=lambda s: (out[s] - exact[s], s)) if up else max(free, key=lambda s: (out[s] - exact[s], s))
        out[s] += 1 if up else -1
    return out


def pfair(parts: dict[str, int], period: int = PERIOD) -> list[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of one period, earliest deadline first."""
    waiting = [(0, s, 0) for s in sorted(parts) if parts[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // parts[s]), -parts[s], s, k, release))
        if not ready:
            continue
        due, _, s, k, release = heapq.heappop(ready)
        out.append((s, k, release, due, slot))
        if k + 1 < parts[s]:
            heapq.heappush(waiting, ((k + 1) * period // parts[s], s, k + 1))
    return out


def source_sizes(docs: DataFrame, source_col: str = "source", size: Column | None = None) -> dict[str, int]:
    """Each source's size; sources without any are left out. One row a source comes to the driver."""
    size = F.lit(1) if size is None else size
    rows = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("s")).agg(F.sum(size).alias("n")).where("n > 0").collect()
    return {r["s"]: r["n"] for r in rows}


def tempered_weights(docs: DataFrame, power: float = 0.5, source_col: str = "source", size: Column | None = None) -> dict[str, float]:
    """Each source's size to a power: below 1 it lifts small sources."""
    return {s: float(n) ** power for s, n in source_sizes(docs, source_col, size).items()}


def period_for(sizes: dict[str, int], weights: dict[str, float], block: int) -> int:
    """A period as long as the slots that the sources' blocks take at these weights, between PERIOD and MOST_SLOTS; two slots a source at least."""
    total = sum(weights.values())
    last = max((math.ceil(sizes[s] / block) * total / w for s, w in weights.items() if w > 0 and s in sizes), default=0)
    return max(PERIOD, 2 * len(weights), math.ceil(min(last, MOST_SLOTS)))


def schedule(
    docs: DataFrame, weights: dict[str, float], block: int, period: int = PERIOD, id_col: str = "doc_id", source_col: str = "source",
    size: Column | None = None, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """doc_id, source, units, block_no, release, deadline, slot, in_mix for every row.

    Rows of a source come in the order of a hash of their id (then id and size), rows
    without an id in that of a hash of their place in the table; a
    row belongs to the block in which its first unit falls. in_mix says that the
    slot lies before the first one at which a source of the table has no more
    blocks: up to there the mix has its target weights, and rows behind it, or of
    sources without a weight, are not part of it. A weight whose source has no rows
    leaves its slots empty.
    Null sources are the source ''; a null or negative size is 0. Rows with equal
    ids are placed each on its own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    size = F.lit(1) if size is None else size
    plain = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("units"), F.when(F.col(id_col).isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(F.col(id_col))).alias("h"),
    )
    ranges = max(1, -(-docs.count() // range_rows))
    ranged = stage(plain.withColumn("r", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * ranges).cast("int")), "mix")
    part = ranged.groupBy("source", "r").agg(F.sum("units").alias("n"))
    over = Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("source", "r", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    rows = Window.partitionBy("source", "r").orderBy("h", "doc_id", "units").rowsBetween(Window.unboundedPreceding, -1)
    begun = ranged.withColumn("own", F.coalesce(F.sum("units").over(rows), F.lit(0))).join(part, ["source", "r"])
    blocks = begun.withColumn("block_no", F.floor((F.col("before") + F.col("own")) / F.lit(block)))

    parts = shares(weights, period)
    # One period at most: `period` rows by construction, whatever the data.
    kinds = {"source": pa.string(), "k": pa.int64(), "r0": pa.int64(), "d0": pa.int64(), "s0": pa.int64()}
    columns = list(zip(*pfair(parts, period))) or [()] * len(kinds)
    table = spark.createDataFrame(pa.table({c: pa.array(v, k) for (c, k), v in zip(kinds.items(), columns, strict=True)}))
    sizes = spark.createDataFrame(list(parts.items()), "source string, p long").where("p > 0")
    ends = ranged.groupBy("source").agg(F.sum("units").alias("n")).join(sizes, "source")
    # the slot of the first block that a source does not have any more
    short = ends.select("source", "p", F.ceil(F.col("n") / F.lit(block)).alias("next")).withColumn("k", F.col("next") % F.col("p"))
    horizon = short.join(table, ["source", "k"]).agg(F.min(F.floor(F.col("next") / F.col("p")) * period + F.col("s0")).alias("stop"))
    placed = (
        blocks.join(F.broadcast(sizes), "source", "left")
        .withColumns({"k": F.col("block_no") % F.col("p"), "cycle": F.floor(F.col("block_no") / F.col("p")) * period})
        .join(F.broadcast(table) if period <= 10 * PERIOD else table, ["source", "k"], "left")
    )
    at = lambda c: (F.col("cycle") + F.col(c)).cast("long")
    slot = at("s0")
    stop = horizon.first()["stop"]
    return placed.select(
        "doc_id", "source", "units", "block_no", at("r0").alias("release"), at("d0").alias("deadline"), slot.alias("slot"),
        F.coalesce(slot < F.lit(stop if stop is not None else 1 << 62), F.lit(False)).alias("in_mix"),
    )
