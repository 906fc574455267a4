"""Document fingerprints by consistent weighted sampling.

A text's weighted terms are its five-word shingles, each weighted by how often it
occurs. For sample k every term has fixed r and c from Gamma(2, 1) and b from
U(0, 1), and with t = floor(ln S / r + b) for its weight S the term's value is
ln c - r (t - b) - r; the term with the least value is the sample. Two texts share
a sample with probability sum min(S) / sum max(S), their generalised Jaccard
similarity. A sample is named by 16 bits of its least value, which only the same
term with the same t reaches; unlike values share them in one of 65,536 cases.

The r, b and c of a term are looked up by three different parts of its 64-bit hash
in tables of 2**15 rows that a worker draws once from a fixed seed, so a sample costs
three look-ups a term and 2**45 terms differ. Most terms occur once, where t is 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import arrow_rows, distinct_per_row, slices, windows, word_hashes

SAMPLES, WIDTH, BITS, SEED, STEP = 64, 5, 15, 20240229, 1 << 13
#: Ranges of ids that tasks work on, whose cuts and heads pass through the driver.
MOST_RANGES = 20_000
_tables: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}


def tables(samples: int, bits: int) -> tuple[np.ndarray, ...]:
    """r, b - 1 and ln c, one column a sample."""
    if (samples, bits) not in _tables:
        g = np.random.Generator(np.random.PCG64(SEED))
        shape = (1 << bits, samples)
        r = g.gamma(2.0, size=shape).astype(np.float32)
        c = np.log(g.gamma(2.0, size=shape)).astype(np.float32)
        b = g.random(shape, dtype=np.float32) - np.float32(1)
        _tables[samples, bits] = r, b, c
    return _tables[samples, bits]


def signatures(flat: np.ndarray, at: np.ndarray, samples: int = SAMPLES, width: int = WIDTH, bits: int = BITS) -> np.ndarray:
    """A row of samples for each text, 16 bits each; a text without words has zeros."""
    tables_r, tables_b, tables_c = tables(samples, bits)
    words, first = word_hashes(flat, at)
    runs, starts = windows(words, first, width)
    terms, weights, begins = distinct_per_row(runs, starts)
    low = np.full((len(at) - 1, samples), np.float32(np.inf))
    part = lambda k: (terms[lo:hi] >> np.uint64(64 - bits * k) & np.uint64((1 << bits) - 1)).astype(np.int64)
    for lo in range(0, len(terms), STEP):
        hi = min(lo + STEP, len(terms))
        r, b = tables_r.take(part(1), axis=0), tables_b.take(part(2), axis=0)
        value = tables_c.take(part(3), axis=0)
        if len(heavy := np.flatnonzero(weights[lo:hi] > 1)):
            t = np.floor(np.log(weights[lo:hi][heavy].astype(np.float32))[:, None] / r[heavy] + (b[heavy] + np.float32(1)))
            b[heavy] -= t
        r *= b
        value += r
        # the rows whose terms lie in this step; a row that goes on keeps its least value so far
        rows = np.arange(np.searchsorted(begins, lo, side="right") - 1, np.searchsorted(begins, hi))
        rows = rows[begins[rows + 1] > begins[rows]]
        np.minimum.at(low, rows, np.minimum.reduceat(value, np.maximum(begins[rows] - lo, 0), axis=0))
    value = low.view(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(13) & np.uint64(0xFFFF)
    return np.where(np.isinf(low), 0, np.maximum(value, 1)).astype(np.uint16)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row: 1 for two texts without words, 0 for one of them and any other."""
    return (x == y).mean(axis=1)


def fingerprint_text(signature: np.ndarray) -> str:
    """The samples in hex, four digits each."""
    return signature.astype(">u2").tobytes().hex()


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row. Equal texts have equal fingerprints; null texts are empty ones, of all zeros."""
    arrow_rows(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint_text(row) for _, flat, at in slices(batch.column(1)) for row in signatures(flat, at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, f"doc_id {kind}, fingerprint string")


def _ranges(docs: DataFrame, rows: int) -> DataFrame:
    """The rows with `part`, ranges of falling id, and each range's last neighbour as a further row with `guest`.

    The neighbour of a range's smallest id is the largest id of the next range that
    has rows, and of the last range the largest of all. Ranges have about `rows` rows,
    more where there would be more than MOST_RANGES of them: only their cuts and heads
    are gathered. Rows without an id are cut by their tie-breaking hash.
    """
    n, unnamed = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    rows = max(rows, -(-n // MOST_RANGES))
    parts, tail = max(1, -(-(n - unnamed) // rows)), max(1, -(-unnamed // rows))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * max(parts, 1000))).first()[0] if parts > 1 else []
    cuts = np.array(sorted({c for c in cuts or [] if c is not None}), dtype=np.int64)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        """How many cuts lie at or above the id."""
        return pd.Series(len(cuts) - np.searchsorted(cuts, ids.to_numpy(np.int64)), dtype="int32")

    last = F.lit(len(cuts) + 1) + F.floor((1 - F.conv(F.substring("tie", 1, 7), 16, 10).cast("double") / (1 << 28)) * tail).cast("int")
    ranged = docs.withColumn("part", F.when(F.col("doc_id").isNull(), last).otherwise(part(F.coalesce("doc_id", F.lit(0).cast("long")))))
    heads = [(r["part"], r["head"]) for r in ranged.groupBy("part").agg(F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "tie")).alias("head")).collect()]
    heads.sort()
    if not heads:
        return ranged.withColumn("guest", F.lit(False))
    # the head of each range is also a guest of the range before it; that of the first range, of the last
    to = {heads[k][0]: heads[k - 1][0] for k in range(len(heads))}
    spark = docs.sparkSession
    guests = spark.createDataFrame([(p, to[p], h["doc_id"], h["tie"]) for p, h in heads], "part int, into int, head long, head_tie string")
    copies = (
        ranged.join(F.broadcast(guests), "part").where(F.col("doc_id").eqNullSafe(F.col("head")) & F.col("tie").eqNullSafe(F.col("head_tie")))
        .select(F.col("into").alias("part"), "doc_id", "text", "tie").dropDuplicates(["part"]).withColumn("guest", F.lit(True))
    )
    return ranged.select("part", "doc_id", "text", "tie", F.lit(False).alias("guest")).union(copies)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 5_000) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has the last floor(n_chars / 3) code points replaced by the
    first as many (or all) of the next document in descending order of id; the last
    document's next is the first, and a lone document's is itself. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null texts are empty; null ids come last; rows with equal ids follow each other
    by a hash of their text. An empty table gives no rows. Other columns are ignored.
    """
    arrow_rows(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = _ranges(plain.withColumn("tie", F.md5("text")), rows)

    def row_of(column: pa.Array) -> np.ndarray:
        return np.concatenate([signatures(flat, at) for _, flat, at in slices(column)])

    def result(name: list, texts: list[str], marks: np.ndarray) -> pa.RecordBatch:
        """For all rows but the last, whose text is only the last one's next."""
        edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for t, after in zip(texts, texts[1:])]
        changed = row_of(pa.array(edited, pa.large_string()))
        cols = [
            name[:-1], [len(t) for t in texts[:-1]], [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            [fingerprint_text(m) for m in marks[:-1]], [fingerprint_text(m) for m in changed], likeness(marks[:-1], changed), likeness(marks[:-1], marks[1:]),
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, whose next is not known yet
        for batch in batches:
            part, names, texts, guest = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            marks = row_of(batch.column(2))
            if held:
                part, names, texts, guest, marks = [held[0], *part], [held[1], *names], [held[2], *texts], [held[3], *guest], np.vstack([held[4], marks])
            i = 0
            while i < len(part):  # runs of one range, each ending with its guest
                j = i
                while j < len(part) and part[j] == part[i] and not guest[j]:
                    j += 1
                if j < len(part):
                    if j > i:
                        yield result(names[i : j + 1], texts[i : j + 1], marks[i : j + 1])
                    i = j + 1
                else:
                    if j - i > 1:
                        yield result(names[i:j], texts[i:j], marks[i:j])
                    break
            held = (part[-1], names[-1], texts[-1], guest[-1], marks[-1:]) if i < len(part) else None

    order = [F.col("part"), F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    ready = dealt.repartition("part").sortWithinPartitions(*order).select("part", "doc_id", "text", "guest")
    return ready.mapInArrow(
        work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
