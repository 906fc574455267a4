"""Pieces that the corpus operators share: scratch tables, hashing kernels, Arrow helpers.

Everything here runs inside Spark tasks or only declares Spark plans. Scratch
data goes to the folder in ``spark.checkpoint.dir``, which all executors share,
so a lost executor never takes the only copy of an intermediate table with it.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handed to Python. Documents have unbounded length, so the
#: default of 10,000 rows could be gigabytes.
ARROW_ROWS = 512
#: Bytes of text that a hashing kernel works on at once.
SLICE_BYTES = 1 << 20
#: Bytes of rows handed to Python at once, whatever their number.
ARROW_BYTES = 64 << 20
#: Longer words are hashed one by one.
LONG_SPAN = 64


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the Arrow batches of this session's Python stages, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set, as in tests."""
    sc = spark.sparkContext
    there = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(there)
    return there.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, nothing is recomputed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the public splitmix64 constants), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed 64-bit numbers that depend on the salt only."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


#: Numbers that a kernel works on at once where it goes over them many times.
RUN = 1 << 15
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SOLID = (~SPACE).astype(np.uint8)


def translated(flat: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[flat] for bytes, which indexing does much slower."""
    return np.frombuffer(flat.tobytes().translate(table.tobytes()), np.uint8)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about `most` bytes, one row at least."""
    flat, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, flat[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_spans(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of anything but space and 0x09-0x0D), and each row's first word."""
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = translated(flat, SOLID).view(bool)
    cut = np.zeros(len(flat) + 1, dtype=bool)
    cut[at] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | cut[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


def blocks(flat: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    return np.ndarray((len(flat) + 1,), "<u8", padded, strides=(1,))


#: Keeps the first k bytes of eight.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span. Eight bytes a round go through a mixing that is not linear; long spans are hashed by BLAKE2b."""
    size, at = ends - starts, blocks(flat)
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    todo = np.arange(len(size))
    for k in range(0, LONG_SPAN, 8):
        if k:
            todo = todo[size[todo] > k]
        if not len(todo):
            break
        left = np.minimum(size[todo] - k, 8)
        out[todo] = mix((out[todo] ^ (at[starts[todo] + k] & KEEP[left])) * np.uint64(0x9FB21C651E98DF25) + np.uint64(k + 1))
    for i in np.flatnonzero(size > LONG_SPAN):
        out[i] = int.from_bytes(hashlib.blake2b(flat[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def same_spans(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span has the same bytes as the span whose number `other` gives for it."""
    size, at = ends - starts, blocks(flat)
    if (size != size[other]).any():
        return False
    todo, k = np.arange(len(size)), 0
    while len(todo := todo[size[todo] > k]):
        if len(todo) < 8:  # the few long ones as bytes
            return all(np.array_equal(flat[starts[i] + k : ends[i]], flat[starts[j] + k : ends[j]]) for i, j in zip(todo, other[todo], strict=True))
        keep = KEEP[np.minimum(size[todo] - k, 8)]
        if ((at[starts[todo] + k] ^ at[starts[other[todo]] + k]) & keep).any():
            return False
        k += 8
    return True


def word_hashes(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word with A-Z lower-cased, and the first word of each row."""
    starts, ends, first = word_spans(flat, at)
    return span_hashes(translated(flat, LOWER), starts, ends), first


def windows(words: np.ndarray, first: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words inside a row, and each row's first run.

    A row with fewer words than `width` but one at least has its whole sequence
    as its one run if `short`. A run's hash depends on its words and their order.
    """
    lens = np.diff(first)
    count = np.maximum(lens - width + 1, ((lens > 0) & short).astype(lens.dtype))
    starts = np.concatenate([[0], np.cumsum(count)])
    total = int(starts[-1])
    if not total:
        return np.zeros(0, np.uint64), starts
    whole = np.flatnonzero(lens >= width)
    out = np.zeros(total, dtype=np.uint64)
    if len(whole):
        value, h, high = np.zeros(max(len(words) - width + 1, 0), np.uint64), np.empty(RUN, np.uint64), np.empty(RUN, np.uint64)
        for a in range(0, len(value), RUN):  # all runs, those that leave their row too
            part = value[a : a + RUN]
            n = len(part)
            for k in range(width):
                np.multiply(part, np.uint64(0x100000001B3), out=h[:n])
                np.add(h[:n], words[a + k : a + k + n], out=h[:n])
                part[:] = _mixed(h[:n], high[:n])
        size = np.where(lens >= width, count, 0)
        inside = np.zeros(len(value) + 1, np.int64)
        np.add.at(inside, first[:-1][whole], 1)
        np.add.at(inside, first[:-1][whole] + size[whole], -1)
        inside = np.cumsum(inside[:-1]) > 0
        to = np.repeat(lens >= width, count) if len(whole) < np.count_nonzero(count) else slice(None)
        out[to] = value[inside]
    few = np.flatnonzero((count > 0) & (lens < width))
    if len(few):
        h = np.zeros(len(few), np.uint64)
        for k in range(width):
            more = lens[few] > k
            h[more] = mix(h[more] * np.uint64(0x100000001B3) + words[first[:-1][few[more]] + k])
        out[starts[few]] = h
    return out, starts


def _mixed(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """mix() in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        np.bitwise_xor(x, np.right_shift(x, np.uint64(shift), out=spare), out=x)
        if factor:
            np.multiply(x, np.uint64(factor), out=x)
    return x


def distinct_per_row(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values sorted and distinct inside each row, how often each occurs, and each row's first one."""
    n = len(starts) - 1
    if not len(values):
        return values, np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    v, at = values.copy(), starts.tolist()
    for i, j in zip(at, at[1:]):
        if j - i > 1:
            v[i:j].sort()
    new = np.ones(len(v), dtype=bool)
    new[1:] = v[1:] != v[:-1]
    new[starts[:-1][starts[:-1] < len(v)]] = True
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(v)))
    return v[first], counts, np.searchsorted(first, starts)


def list_column(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A list<int64> column over 64-bit hashes."""
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int64)))


class Recent(dict):
    """A dictionary of bounded size: when half is full, only what is met again stays."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.half, self.old = size // 2, {}

    def find(self, key):
        value = self.old.get(key)
        return value if value is None else self.put(key, value)

    def put(self, key, value):
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def text_key(column):
    """A key of a text's words: equal for texts with the same lower-cased words in the same order."""
    # a blank alone is left as it is: replacing each would take most of the time
    words = F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")
    return F.xxhash64(F.trim(words))
