"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c lie at squared distance 2 - 2c. The vectors are rotated
to the principal axes of a bounded sample and split into low-dimensional blocks,
each with a share of the squared-distance budget in proportion to its part of the
variance. If a pair is within the whole budget it is within budget in at least one
block, so the union of the blocks' range joins has every link, and each candidate
is checked exactly on the whole vectors.

A block's range join uses a grid over its two leading coordinates with cells as
wide as the block's budget allows: a vector is at home in one cell and a guest in
four neighbours, so each pair of cells meets once. A cell with more vectors than
`PANEL` is cut into panels that meet pairwise in tasks of their own. A pair that is
within budget in several blocks counts in the first of them only; rotated
coordinates are whole numbers (in units of 2**-20), so that choice is exact.
Tasks return one row a linked vector, its number of links and the smallest vector
that it reaches there, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import arrow_rows, stage
from tessella.llm.components import connected_components

THRESHOLD, BLOCK, SAMPLE, PANEL, SCALE = 0.95, 8, 2_000, 16_384, float(1 << 20)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _rotated(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return np.rint((x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes * SCALE)


def _stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest that it reaches over the edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def fit(vectors: DataFrame, dim: int, threshold: float, block: int, sample: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Axes, blocks and squared budgets (in whole units) from `sample` vectors in order of a hash."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    x = _matrix(rows["embedding"])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    value, axes = np.linalg.eigh(x.T @ x / len(x))
    value, axes = np.maximum(value[::-1], 0), axes[:, ::-1]
    blocks = [(a, min(a + block, dim)) for a in range(0, dim, block)]
    energy = np.array([value[a:b].sum() for a, b in blocks]) + 1e-3 * value.sum() / len(blocks)
    whole = (np.sqrt(max(2 - 2 * threshold, 0.0)) + 1e-4) ** 2  # rounding of coordinates and of the norm included
    return axes, blocks, np.ceil(whole * energy / energy.sum() * SCALE**2)


def _meet(x: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, block: int, model: tuple, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of rows of x, left with right, for which `block` is the first block within budget."""
    axes, blocks, budget = model
    q = _rotated(x, axes)
    norm = np.linalg.norm(x, axis=1)
    a, b = blocks[block]
    sub, square = q[:, a:b], (q[:, a:b] ** 2).sum(axis=1)
    starts = [lo for lo, _ in blocks]
    for k in range(0, len(left), 256):
        rows = left[k : k + 256]
        far = square[rows][:, None] + square[right] - 2 * (sub[rows] @ sub[right].T)
        i, j = np.nonzero(far <= budget[block])
        i, j = rows[i], right[j]
        if same:
            i, j = i[i < j], j[i < j]
        for c in range(0, len(i), 50_000):
            u, v = i[c : c + 50_000], j[c : c + 50_000]
            cosine = np.einsum("ij,ij->i", x[u], x[v]) / (norm[u] * norm[v])
            u, v = u[cosine >= threshold], v[cosine >= threshold]
            if not len(u):
                continue
            within = np.add.reduceat((q[u] - q[v]) ** 2, starts, axis=1) <= budget
            first = within.argmax(axis=1) == block
            yield u[first], v[first]


def _links(vectors: DataFrame, dim: int, threshold: float, block: int, sample: int, panel: int) -> DataFrame:
    """vec_id, n_links, low: partial numbers of links, and the smallest vector reached."""
    axes, blocks, budget = model = fit(vectors, dim, threshold, block, sample)
    kind, listed = vectors.select("vec_id").dtypes[0][1], vectors.select("embedding").dtypes[0][1]
    width = np.sqrt(budget)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            q = _rotated(_matrix(batch.column(1)), axes)
            for k, (a, b) in enumerate(blocks):
                x = np.floor(q[:, a] / width[k]).astype(np.int32)
                y = np.floor(q[:, a + 1] / width[k]).astype(np.int32) if b - a > 1 else np.zeros(len(q), np.int32)
                for guest, (dx, dy) in enumerate(((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))):
                    cols = [pa.array(np.full(len(q), k, np.int32)), pa.array(x + np.int32(dx)), pa.array(y + np.int32(dy)), pa.array(np.full(len(q), guest > 0)), *batch.columns]
                    yield pa.RecordBatch.from_arrays(cols, names=["block", "x", "y", "guest", "vec_id", "embedding"])

    placed = vectors.select("vec_id", "embedding").mapInArrow(cells, f"block int, x int, y int, guest boolean, vec_id {kind}, embedding {listed}")
    sizes = placed.groupBy("block", "x", "y").agg(F.count_if(~F.col("guest")).alias("home"), F.count_if("guest").alias("guests")).where("home > 0")
    up = lambda c: F.ceil(F.col(c) / F.lit(panel)).cast("int")
    sizes = stage(sizes.select("block", "x", "y", up("home").alias("homes"), up("guests").alias("visits")), "cells")
    spread = placed.join(sizes, ["block", "x", "y"])
    # a home panel meets itself, later home panels and the guests' panels; a guest panel meets all home panels
    number = F.pmod(F.xxhash64("vec_id"), F.when(F.col("guest"), F.col("visits")).otherwise(F.col("homes")))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda h: F.struct(h.alias("a"), (F.col("homes") + F.col("mine")).cast("int").alias("b"), F.lit(True).alias("right")))
    left = F.transform(F.sequence(F.col("mine"), F.col("homes") + F.col("visits") - 1), lambda p: F.struct(F.col("mine").alias("a"), p.cast("int").alias("b"), F.lit(False).alias("right")))
    right = F.transform(F.expr("sequence(0, mine)"), lambda h: F.struct(h.cast("int").alias("a"), F.col("mine").alias("b"), F.lit(True).alias("right")))
    tasks = F.when(F.col("guest"), as_guest).otherwise(F.concat(left, F.filter(right, lambda t: t["a"] < t["b"])))
    dealt = spread.withColumn("mine", number.cast("int")).select("block", "x", "y", F.explode(tasks).alias("t"), "vec_id", "embedding")

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        x, side = _matrix(table["embedding"]), table["right"].to_numpy()
        first = table["a"][0].as_py() == table["b"][0].as_py()
        left = np.flatnonzero(~side)
        right = left if first else np.flatnonzero(side)
        n = np.zeros(len(x), dtype=np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for u, v in _meet(x, left, right, first, table["block"][0].as_py(), model, threshold):
            n += np.bincount(u, minlength=len(x)) + np.bincount(v, minlength=len(x))
            low = _stars(u, v, len(x))
            moved = np.flatnonzero(low != np.arange(len(x)))
            ends.append((moved, low[moved]))
        low = _stars(*map(np.concatenate, zip(*ends, strict=True)), len(x))
        at = np.flatnonzero(n)
        ids = table["vec_id"].combine_chunks() if isinstance(table["vec_id"], pa.ChunkedArray) else table["vec_id"]
        return pa.Table.from_arrays([ids.take(pa.array(at)), pa.array(n[at]), ids.take(pa.array(low[at]))], names=["vec_id", "n_links", "low"])

    grouped = dealt.select("block", "x", "y", "t.*", "vec_id", "embedding").groupBy("block", "x", "y", "a", "b")
    return grouped.applyInArrow(work, f"vec_id {kind}, n_links long, low {kind}")


def embedding_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, sample: int = SAMPLE, panel: int = PANEL
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Two vectors are linked where the cosine of their components, in double
    precision, is at least `threshold` (above 0). Null vectors, those of no length
    or with null, infinite or undefined components, and rows with a null id link
    with nothing; vectors are compared with those of the same dimension. Rows with
    equal ids have the links of both. component_id is the smallest id that links
    reach; kept says that it is the row's own. An empty table gives no rows. Other
    columns are ignored.
    """
    arrow_rows(vectors.sparkSession, 1024)
    plain = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    real = plain.where(F.col("vec_id").isNotNull() & whole & F.exists("embedding", lambda c: c != 0))
    # one row a dimension
    dims = sorted(r["d"] for r in real.select(F.size("embedding").alias("d")).distinct().collect())
    found = [_links(real.where(F.size("embedding") == d), d, threshold, block, sample, panel) for d in dims]
    if not found:
        return plain.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    links = stage(links, "links")
    counts = links.groupBy("vec_id").agg(F.sum("n_links").alias("n"))
    whole_ids = connected_components(links.where("vec_id <> low"), "vec_id", "low").withColumnRenamed("node", "vec_id")
    out = plain.select("vec_id").join(counts, "vec_id", "left").join(whole_ids, "vec_id", "left")
    own = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))
