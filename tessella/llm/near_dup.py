"""MinHash near-duplicate detection with min-max signatures.

Each permutation of the shingle hashes yields two signature values, its minimum
and its maximum, so a signature of 216 values costs 108 hash evaluations a
shingle. Bands of six values give candidates: two documents of Jaccard
similarity 0.8 share none of the 36 bands with probability (1 - 0.8**6)**36,
which is 2 in 100,000, and less above. Candidates are then confirmed on the full
sets of shingle hashes, so nothing below the threshold is linked.

Scale. Equal word sequences collapse to one representative first, whatever the
size of their group. A band bucket never emits all its pairs: its members are
compared with one pivot, the member that shares the most buckets with others
(the text that a group's copies were made from, as a rule). What a bucket still
holds outside its pivot's component is then joined with the other members, but
only where sizes and the triangle inequality of the Jaccard distance leave a
link possible; both bounds are exact. There, a longer min-max sketch of 2,048 bits
is compared before the sets are: a pair of similarity 0.8 differs in more bits than
is let through with probability below one in a million, one of 0.7 nearly always. A pair
of several common buckets comes out of the least of them only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import arrow_rows, distinct_per_row, list_column, mix, seeds, slices, stage, windows, word_hashes
from tessella.llm.components import connected_components

SHINGLE, PERCENT, BANDS, ROWS = 5, 80, 36, 6
#: Shingles whose minima are taken at once.
MINIMA = 1 << 17
#: 64-bit words of the sketch that outer members of a bucket are compared by.
SKETCH = 32


def _shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row from, row to, distinct shingles, their first by row, words, words' first by row) of slices of a column."""
    for row, flat, at in slices(column):
        words, first = word_hashes(flat, at)
        runs, starts = windows(words, first, width)
        values, _, begins = distinct_per_row(runs, starts)
        yield row, row + len(at) - 1, values, begins, words, first


def min_max(values: np.ndarray, begins: np.ndarray, permutations: int) -> np.ndarray:
    """Signatures of rows that all have values: for each permutation of the hashes' upper halves the row's minimum and maximum."""
    factor, shift = (seeds(permutations, 1) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds(permutations, 2) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((2 * permutations, len(begins) - 1), dtype=np.uint32)
    short, step = (values >> np.uint64(32)).astype(np.uint32), np.array([15], np.uint32)
    i = 0
    while i < len(begins) - 1:  # some rows at a time, so that each step finds its numbers near
        j = max(i + 1, int(np.searchsorted(begins, begins[i] + MINIMA, side="right")) - 1)
        part, at = short[begins[i] : begins[j]], begins[i:j] - begins[i]
        h, high = np.empty_like(part), np.empty_like(part)
        for k in range(permutations):
            by = factor[k : k + 1]
            np.bitwise_xor(part, shift[k : k + 1], out=h)
            np.multiply(h, by, out=h)
            np.right_shift(h, step, out=high)
            np.bitwise_xor(h, high, out=h)
            np.multiply(h, by, out=h)
            np.minimum.reduceat(h, at, out=out[2 * k, i:j])
            np.maximum.reduceat(h, at, out=out[2 * k + 1, i:j])
        i = j
    return out.T.astype(np.uint64)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` signature values; the band's number is part of it."""
    values = np.ascontiguousarray(signature[:, : bands * rows].T).reshape(bands, rows, len(signature))
    key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[:, None], len(signature), axis=1)
    for r in range(rows):
        key = mix(key * np.uint64(0x100000001B3) + values[:, r])
    return np.ascontiguousarray(key.T)


def _text_keys(words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two halves of a key of each row's word sequence; 0 without words."""
    full, out = np.flatnonzero(np.diff(first)), []
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    for salt in seeds(2, 3):
        key = np.zeros(len(first) - 1, dtype=np.uint64)
        if len(full):
            key[full] = np.add.reduceat(mix(words + (place.astype(np.uint64) + np.uint64(1)) * salt), first[full])
        out.append(key)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, two halves of a key of the word sequence, and the band keys (none for an empty set)."""
    permutations = -(-bands * rows // 2)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, values, begins, words, first in _shingle_sets(batch.column(1), width):
                n = np.diff(begins)
                full = np.flatnonzero(n)
                keys = _text_keys(words, first)
                held = np.zeros((0, bands), dtype=np.uint64)
                if len(full):
                    held = band_hashes(min_max(values, np.append(begins[full], len(values)), permutations), bands, rows)
                at = np.zeros(j - i + 1, dtype=np.int64)
                at[1:] = np.cumsum(np.where(n > 0, bands, 0))
                yield pa.RecordBatch.from_arrays(
                    [ids[i:j], pa.array(n.astype(np.int64)), *(pa.array(k.view(np.int64)) for k in keys), list_column(held.ravel(), at)],
                    names=["doc_id", "n_shingles", "k1", "k2", "bands"],
                )

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        work, f"doc_id {kind}, n_shingles long, k1 long, k2 long, bands array<long>"
    )


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, the key of the word sequence, and the distinct shingle hashes in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, values, begins, words, first in _shingle_sets(batch.column(1), width):
                keys = _text_keys(words, first)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *(pa.array(k.view(np.int64)) for k in keys), list_column(values, begins)], names=["doc_id", "k1", "k2", "shingles"])

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, f"doc_id {kind}, k1 long, k2 long, shingles array<long>")


def sketches(sets: DataFrame, words: int = SKETCH) -> DataFrame:
    """doc_id and `words` numbers of 64 bits: one bit of the minimum and one of the maximum of each permutation."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            column = batch.column(1)
            begins = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            values = column.flatten().to_numpy().view(np.uint64)
            bits = (mix(min_max(values, begins, 32 * words)) >> np.uint64(63)).astype(np.uint8)
            packed = np.packbits(np.ascontiguousarray(bits), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(packed[:, k].copy()) for k in range(words))], names=names)

    names = ["doc_id", *(f"s{k}" for k in range(words))]
    kind = sets.select("doc_id").dtypes[0][1]
    return sets.select("doc_id", "shingles").mapInArrow(work, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:]))


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, y with the exact sizes of their sets' intersection and union. Both joins are split where a document is hot."""
    left = sets.select(F.col("doc_id").alias("x"), F.col("shingles").alias("sx"))
    right = sets.select(F.col("doc_id").alias("y"), F.col("shingles").alias("sy"))
    common = F.size(F.array_intersect("sx", "sy")).cast("long")
    return (
        pairs.join(right, "y").join(left, "x").select("x", "y", common.alias("common"), (F.size("sx") + F.size("sy") - common).cast("long").alias("whole"))
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Documents are linked where 100 * |intersection| >= percent * |union| of their
    distinct `width`-word shingles (A-Z lower-cased; fewer words than `width` are
    one shingle). component_id is the smallest id that links reach; kept says that
    a row is its component's first. A null or blank text has no shingles and links
    with nothing. A row with a null id links with nothing, has a null component
    and is kept. Different texts under one id are texts of their own: each row has the
    component of its text, and is kept where that is its id; equal rows stay rows. An empty table gives none.
    Columns other than the id and the text are ignored, whatever their names.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    signed = stage(signatures(docs, id_col, text_col, width, bands, rows), "signatures")
    real = signed.where("n_shingles > 0 and doc_id is not null")
    first = real.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("r")).select("k1", "k2", F.col("r.doc_id").alias("first_id"), "r.n_shingles", "r.bands")
    first = stage(first, "texts")
    # a text goes by its smallest id; where one id has several texts, all go by their keys
    shared = not first.groupBy("first_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    first = first.withColumn("doc_id", F.concat_ws("-", F.hex("k1"), F.hex("k2")) if shared else F.col("first_id"))

    banded = first.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.count("*").alias("crowd")).where("crowd > 1")
    members = stage(banded.join(crowded, "bucket"), "members")
    degree = members.groupBy("doc_id").agg(F.sum("crowd").alias("degree"))
    pivots = members.join(degree, "doc_id").groupBy("bucket").agg(F.max(F.struct("degree", "doc_id", "n_shingles")).alias("m"))
    pivots = pivots.select("bucket", F.col("m.doc_id").alias("pivot"), F.col("m.n_shingles").alias("pivot_n"))
    spoked = stage(members.join(pivots, "bucket").select("bucket", "doc_id", "n_shingles", "pivot", "pivot_n"), "spokes")

    spokes = spoked.where("doc_id <> pivot").select(F.col("doc_id").alias("x"), F.col("pivot").alias("y")).distinct()
    wanted = first.select("first_id", "k1", "k2", "doc_id").join(spoked.select("doc_id").distinct(), "doc_id", "left_semi")
    known = docs.select(F.col(id_col).alias("first_id"), F.col(text_col).alias("text")).join(wanted.select("first_id").distinct(), "first_id", "left_semi")
    sets = shingle_sets(known, "first_id", "text", width).withColumnRenamed("doc_id", "first_id").join(wanted, ["first_id", "k1", "k2"])
    sets = stage(sets.select("doc_id", "shingles").dropDuplicates(["doc_id"]), "sets")
    measured = stage(_confirm(spokes, sets), "measured")
    links = measured.where(100 * F.col("common") >= percent * F.col("whole")).select("x", "y")
    found = stage(connected_components(links, "x", "y"), "found")

    # What is outside its bucket's pivot's component meets the other members, where a link is still possible.
    near = (
        spoked.join(measured.withColumnsRenamed({"x": "doc_id", "y": "pivot"}), ["doc_id", "pivot"], "left")
        .join(found.withColumnsRenamed({"node": "doc_id", "component": "own"}), "doc_id", "left")
        .join(found.withColumnsRenamed({"node": "pivot", "component": "theirs"}), "pivot", "left")
        .select(
            "bucket", "doc_id", "n_shingles", F.coalesce("own", "doc_id").alias("own"), F.coalesce("theirs", "pivot").alias("theirs"),
            F.when(F.col("doc_id") == F.col("pivot"), 0.0).otherwise(1 - F.col("common") / F.col("whole")).alias("far"),
        )
    )
    near = stage(near, "near")
    # Shingles that no other text of an unfinished bucket has can't be in common: too many of them rule a text out.
    unfinished = near.join(near.where("own <> theirs").select("bucket").distinct(), "bucket", "left_semi")
    shingles = sets.join(unfinished.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.explode("shingles").alias("shingle"))
    single = shingles.groupBy("shingle").agg(F.count("*").alias("texts"), F.min("doc_id").alias("doc_id")).where("texts = 1")
    single = single.groupBy("doc_id").agg(F.count("*").alias("single"))
    open_to_links = (
        unfinished.join(single, "doc_id", "left")
        .withColumn("shared", F.col("n_shingles") - F.coalesce("single", F.lit(0)))
        .where(100 * F.col("shared") >= percent * F.col("n_shingles"))
    )
    open_sets = sets.join(open_to_links.select("doc_id").distinct(), "doc_id", "left_semi")
    held = open_to_links.groupBy("doc_id").agg(F.collect_list("bucket").alias("buckets"))  # `bands` at most
    open_to_links = stage(open_to_links.join(sketches(open_sets).join(held, "doc_id"), "doc_id"), "open")
    # half of the bits of unlike values differ; five standard deviations more than that of a link at the threshold
    unlike = (1 - percent / 100) / 2
    most = 64 * SKETCH * unlike + 5 * (64 * SKETCH * unlike * (1 - unlike)) ** 0.5
    differing = sum(F.bit_count(F.col(f"o.s{k}").bitwiseXOR(F.col(f"i.s{k}"))) for k in range(SKETCH))
    outer = open_to_links.where("own <> theirs")
    # far is 1 - J; two linked documents differ in it by at most the largest distance of a link
    reach = 1 - percent / 100 + 1e-9
    enough = (100 + percent) * F.least("o.shared", "i.shared") >= percent * (F.col("o.n_shingles") + F.col("i.n_shingles"))
    # sizes of linked texts differ by the threshold at most, so they are in the same class or in neighbours
    size_class = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(-math.log(percent / 100)) + 1e-9) if percent < 100 else F.col("n_shingles")
    inner = open_to_links.withColumn("size_class", size_class).alias("i")
    outer = outer.withColumn("size_class", F.explode(F.sequence(size_class - 1, size_class + 1))).alias("o")
    rest = (
        outer.join(inner, (F.col("o.bucket") == F.col("i.bucket")) & (F.col("o.size_class") == F.col("i.size_class")))
        .where(
            (F.col("o.own") != F.col("i.own"))
            & enough
            & (F.abs(F.col("o.far") - F.col("i.far")) <= reach)
            & ((F.col("i.own") == F.col("i.theirs")) | (F.col("o.doc_id") < F.col("i.doc_id")))
            & (F.col("i.far") > 0)
            & (differing <= most)
            & (F.array_min(F.array_intersect("o.buckets", "i.buckets")) == F.col("o.bucket"))
        )
        .select(F.least("o.doc_id", "i.doc_id").alias("x"), F.greatest("o.doc_id", "i.doc_id").alias("y"))
        .distinct()
    )
    more = _confirm(rest, sets).where(100 * F.col("common") >= percent * F.col("whole")).select("x", "y")
    every = stage(links.union(more), "links")
    whole = connected_components(every, "x", "y").withColumnsRenamed({"node": "text_id", "component": "linked"})

    texts = first.select("k1", "k2", "first_id", F.col("doc_id").alias("text_id")).join(whole, "text_id", "left")
    texts = texts.select("k1", "k2", "first_id", F.coalesce("linked", "text_id").alias("reached"))
    if shared:
        texts = texts.join(texts.groupBy("reached").agg(F.min("first_id").alias("low")), "reached").select("k1", "k2", F.col("low").alias("reached"))
    texts = texts.select("k1", "k2", "reached")
    alone = F.when(F.col("n_shingles") > 0, F.col("reached"))
    out = signed.select("doc_id", "n_shingles", *(F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col(k)).alias(k) for k in ("k1", "k2")))
    return out.join(texts, ["k1", "k2"], "left").select(
        "doc_id", "n_shingles", F.coalesce(alone, "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce(alone, "doc_id"), F.lit(True)).alias("kept")
    )
