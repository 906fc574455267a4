"""Best-fit packing of documents into sequences, with conflicts.

Documents are dealt by a hash of their place in the table, so that neither equal ids
nor equal rows meet in one task, into shards of a bounded number of rows; each shard is packed by one task, largest piece first. Open bins are kept
in order of their residual. A piece asks for the successor of its length in that
order, the tightest bin that can hold it, and goes on to the next one while the
bin's bitmaps show a conflict: a bin never holds two documents of the same
duplicate cluster, nor more than `per_source` of the same source. If no bin is
compatible a new one is opened. Within its shard the choice is exact.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, SHARD_ROWS = 4096, 8192


class Bins:
    """Open bins of one shard, by residual; bitmaps of the sources and clusters that each holds."""

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []
        self.sources: list[list[int]] = []  # level k has the sources that occur more than k times
        self.clusters: list[int] = []
        self.used: list[int] = []

    def put(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece; source and cluster are single bits."""
        last = self.per_source - 1
        for at in range(bisect_left(self.order, (length, -1)), len(self.order)):
            residual, b = self.order[at]
            if not (self.sources[b][last] & source or self.clusters[b] & cluster):
                del self.order[at]
                break
        else:
            residual, b = self.capacity, len(self.used)
            self.sources.append([0] * self.per_source)
            self.clusters.append(0)
            self.used.append(0)
        carry = source
        for k, held in enumerate(self.sources[b]):
            self.sources[b][k], carry = held | carry, held & carry
        self.clusters[b] |= cluster
        offset = self.used[b]
        self.used[b] += length
        if residual > length:
            insort(self.order, (residual - length, b))
        return b, offset


def _pack(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, alone: np.ndarray, capacity: int, per_source: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; pieces come largest first. Pieces alone and clusters that occur once have no bit."""
    bins = Bins(capacity, per_source)
    source_bit = pd.factorize(sources)[0]
    code, _ = pd.factorize(clusters)
    seen = np.bincount(code, minlength=1)
    bit = np.where(alone, -1, np.where(seen > 1, np.cumsum(seen > 1) - 1, -1)[code]) if len(code) else code
    out = np.empty((len(lengths), 2), dtype=np.int64)
    for i, (n, s, c) in enumerate(zip(lengths.tolist(), source_bit.tolist(), bit.tolist(), strict=True)):
        out[i] = bins.put(n, 1 << s, 1 << c if c >= 0 else 0)
    return out[:, 0], out[:, 1]


def best_fit(
    items: DataFrame, capacity: int = CAPACITY, per_source: int = 2, shard_rows: int = SHARD_ROWS,
    id_col: str = "doc_id", length_col: str = "n_tokens", source_col: str = "source", cluster_col: str = "cluster",
    order_col: str | None = None,
) -> DataFrame:
    """Where each piece of each document goes: shard, bin, doc_id, piece, first_token, n_tokens, bin_offset.

    A document longer than `capacity` is cut into pieces of `capacity` and a rest;
    full pieces fill a bin each, and pieces of one document never share a bin. A
    null length or one below 1 counts as 1 (the end token). Null sources are one
    source; a null cluster conflicts with nothing. Rows with equal ids are packed
    each on its own, in order of length, source and cluster. An empty table gives
    no rows. Other columns are ignored. The number of shards follows the number of
    rows; a task holds about `shard_rows` rows of a few numbers each. With `order_col`, numbers from 0 without gaps,
    a shard holds consecutive rows, of equal lengths the earlier go first, and shards and the bins in each are
    numbered by the earliest row in them.
    """
    plain = items.select(
        F.coalesce(F.col(id_col), F.lit(0)).alias("doc_id"), F.col(id_col).isNull().alias("no_id"), F.greatest(F.coalesce(F.col(length_col), F.lit(1)), F.lit(1)).cast("long").alias("length"),
        F.coalesce(F.xxhash64(F.col(source_col)), F.lit(0)).alias("source"),
        F.xxhash64(F.lit(0), F.col(cluster_col)).alias("cluster"), F.col(cluster_col).isNull().alias("alone"), (F.col(order_col).cast("long") if order_col else F.monotonically_increasing_id()).alias("row"),
    )
    shards = max(1, -(-items.count() // shard_rows))
    shard = F.floor(F.col("row") / shard_rows) if order_col else F.pmod(F.xxhash64("row"), F.lit(shards))
    dealt = plain.withColumn("shard", shard.cast("int"))
    kind = dealt.select("doc_id").dtypes[0][1]

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        ties = ["row"] if order_col else ["no_id", "doc_id", "source", "cluster", "row"]
        rows = rows.sort_values(["length", *ties], ascending=[False, *(True for _ in ties)], kind="stable")
        length, full = rows["length"].to_numpy(), rows["length"].to_numpy() // capacity
        rest = length - full * capacity
        count = full + (rest > 0)
        at = np.repeat(np.arange(len(rows)), count)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        size = np.where(piece < full[at], capacity, rest[at])
        out = pd.DataFrame({"shard": rows["shard"].to_numpy()[at], "bin": np.int64(0), "doc_id": rows["doc_id"].to_numpy()[at], "no_id": rows["no_id"].to_numpy()[at], "piece": piece, "first_token": piece * capacity, "n_tokens": size, "bin_offset": np.int64(0)})
        part = np.flatnonzero(size < capacity)
        part = part[np.argsort(-size[part], kind="stable")]
        bins, offsets = _pack(size[part], rows["source"].to_numpy()[at[part]], rows["cluster"].to_numpy()[at[part]], rows["alone"].to_numpy()[at[part]], capacity, per_source)
        opened = int(bins.max()) + 1 if len(bins) else 0
        whole = np.flatnonzero(size == capacity)
        number = np.empty(len(at), dtype=np.int64)
        number[part], number[whole] = bins, opened + np.arange(len(whole))
        place = np.zeros(len(at), dtype=np.int64)
        place[part] = offsets
        if order_col:
            first = pd.Series(rows["row"].to_numpy()[at]).groupby(number).transform("min").to_numpy()
            number = pd.factorize(pd.Series(list(zip(first.tolist(), number.tolist(), strict=True))), sort=True)[0].astype(np.int64)
        return out.assign(bin=number, bin_offset=place)

    packed = dealt.groupBy("shard").applyInPandas(work, f"shard int, bin long, doc_id {kind}, no_id boolean, piece long, first_token long, n_tokens long, bin_offset long")
    named = packed.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
    return named.select(F.concat_ws("-", "shard", "bin").alias("bin_id"), *named.columns)
