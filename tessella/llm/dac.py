"""Directly addressable codes: token ids as chunk levels with continuation bitmaps and rank directories.

A segment holds the ids of consecutive documents. Level 0 has the low `widths[0]`
bits of every id, packed without gaps; a bitmap says which ids go on, and level 1
has the next `widths[1]` bits of those only, and so on. A directory has the number
of set bits before every 512th bit of a bitmap, so the place of an id's next chunk
is one directory entry plus at most 64 bytes of bit counts: any id is read from a
few bytes of its segment, and nothing is decoded around it.

Layout, little-endian: magic "DAC1", u32 number of levels, u64 number of ids; for
each level u32 width, u32 zero, u64 number of chunks; then for each level its
packed chunks, its bitmap (absent on the last level) and its directory of u32.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import arrow_rows, scratch_path
from tessella.llm.tokens import default_path, encoder

WIDTHS, DIRECTORY, END_ID, SEGMENT_IDS = (9, 7), 512, 2, 1 << 20
#: Pieces that a worker keeps while it writes, about 200 MB: nothing else runs beside it, and sf0.1 alone has 356,241 kinds.
KEPT_PIECES = 1_000_000
#: Parts whose totals are broadcast: 16 bytes each.
FEW_PARTS = 1 << 20
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def _pack(values: np.ndarray, width: int) -> bytes:
    """Values of `width` bits without gaps, lowest bit first; eight of them fill `width` bytes."""
    groups = -(-len(values) // 8)
    v = np.zeros(groups * 8, dtype=np.uint32)
    v[: len(values)] = values
    v = v.reshape(groups, 8)
    out = np.empty((groups, width), dtype=np.uint8)
    for k in range(width):
        byte = np.zeros(groups, dtype=np.uint32)
        for j in range(8 * k // width, (8 * k + 7) // width + 1):
            shift = j * width - 8 * k
            byte |= v[:, j] << np.uint32(shift) if shift >= 0 else v[:, j] >> np.uint32(-shift)
        out[:, k] = byte & np.uint32(255)
    return out.tobytes()[: -(-len(values) * width // 8)]


def _unpack(data: np.ndarray, n: int, width: int) -> np.ndarray:
    groups = -(-n // 8)
    d = np.zeros(groups * width, dtype=np.uint8)
    d[: len(data)] = data
    d = d.reshape(groups, width)
    out = np.empty((groups, 8), dtype=np.uint32)
    for j in range(8):
        v = np.zeros(groups, dtype=np.uint64)
        for k in range(j * width // 8, (j * width + width - 1) // 8 + 1):
            shift = 8 * k - j * width
            byte = d[:, k].astype(np.uint64)
            v |= byte << np.uint64(shift) if shift >= 0 else byte >> np.uint64(-shift)
        out[:, j] = v & np.uint64((1 << width) - 1)
    return out.ravel()[:n]


def encode(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """A segment of any unsigned 32-bit ids; the last width repeats until every id ends."""
    rest, levels, k = ids.astype(np.uint32), [], 0
    while True:
        width = min(widths[min(k, len(widths) - 1)], 31)
        chunk, rest = rest & np.uint32((1 << width) - 1), rest >> np.uint32(width)
        more = rest > 0
        levels.append((width, chunk, more))
        if not more.any():
            break
        rest, k = rest[more], k + 1
    head = [b"DAC1", np.uint32(len(levels)).tobytes(), np.uint64(len(ids)).tobytes()]
    body = []
    for i, (width, chunk, more) in enumerate(levels):
        head += [np.array([width, 0], "<u4").tobytes(), np.uint64(len(chunk)).tobytes()]
        body.append(_pack(chunk, width))
        if i + 1 < len(levels):
            ones = np.concatenate([[0], np.cumsum(more, dtype=np.int64)])
            body += [np.packbits(more, bitorder="little").tobytes(), ones[: len(more) : DIRECTORY].astype("<u4").tobytes()]
    return b"".join([*head, *body])


class Segment:
    """Reads ids from an encoded segment, all at once or any of them on its own."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data, np.uint8)
        if bytes(raw[:4]) != b"DAC1":
            raise ValueError("not a DAC1 segment")
        levels = int(raw[4:8].view("<u4")[0])
        self.n, at, self.levels = int(raw[8:16].view("<u8")[0]), 16 + 16 * levels, []
        for i in range(levels):
            head = raw[16 + 16 * i : 32 + 16 * i]
            width, n = int(head[:4].view("<u4")[0]), int(head[8:].view("<u8")[0])
            size = -(-n * width // 8)
            chunks, at = raw[at : at + size], at + size
            bits = ranks = None
            if i + 1 < levels:
                bits, at = raw[at : at + -(-n // 8)], at + -(-n // 8)
                count = -(-n // DIRECTORY)
                ranks, at = np.frombuffer(data, "<u4", count, at), at + 4 * count
            self.levels.append((width, n, chunks, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """The id at place i, from a few bytes of each level that it has."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for width, _, chunks, bits, ranks in self.levels:
            low, high = i * width // 8, -(-(i + 1) * width // 8)
            value |= (int.from_bytes(chunks[low:high].tobytes(), "little") >> (i * width - 8 * low) & (1 << width) - 1) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                return value
            first = i // DIRECTORY * (DIRECTORY // 8)
            before = int(_ONES[bits[first : i >> 3]].sum()) + int(_ONES[bits[i >> 3] & ((1 << (i & 7)) - 1)])
            i, shift = int(ranks[i // DIRECTORY]) + before, shift + width
        return value

    def all(self) -> np.ndarray:
        """Every id in order."""
        out, live, shift = np.zeros(self.n, np.uint32), np.arange(self.n), 0
        for width, n, chunks, bits, _ in self.levels:
            out[live] |= _unpack(chunks, n, width) << np.uint32(shift)
            if bits is not None:
                live = live[np.unpackbits(bits, count=n, bitorder="little").astype(bool)]
            shift += width
        return out


def write_token_files(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID,
    widths: tuple[int, ...] = WIDTHS, segment_ids: int = SEGMENT_IDS,
) -> None:
    """Write the ids of every document, in ascending order of id, as segments below a folder.

    A null text is an empty one; every document ends with `end_id`. Null ids come
    first; rows with equal ids follow each other, ordered by text. A segment ends
    with the document that brings it to `segment_ids`; a longer document has a
    segment to itself. An empty table writes no segment. Other columns are ignored.
    """
    tokenizer = tokenizer or default_path()
    arrow_rows(docs.sparkSession)
    sorted_docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, offset = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []

        def out() -> pa.RecordBatch:
            lens = [len(x) for x in ids]
            row = [[part], [number], [offset], [sum(lens)], [names[:]], [lens], [encode(np.concatenate(ids), widths)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["part", "segment", "offset", "n_ids", "doc_ids", "lengths", "payload"])

        held = 0
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for name, got in zip(batch.column(0).to_pylist(), encoder(tokenizer, KEPT_PIECES)(batch.column(1)), strict=True):
                ids.append(np.concatenate([got.astype(np.uint32), end]))
                names.append(name)
                held += len(got) + 1
                if held >= segment_ids:
                    yield out()
                    number, offset, held = number + 1, offset + held, 0
                    ids.clear()
                    names.clear()
        if ids:
            yield out()

    # Payloads stay as they are: a compressed page would have to be decoded before an id in it could be read.
    sorted_docs.mapInArrow(work, "part int, segment int, offset long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary").write.option(
        "compression", "none"
    ).parquet(path)


def segments(spark, path: str) -> DataFrame:
    """The segments with `start`, the number of ids before them: those of earlier parts, and those before it in its own part, which its writer knew.

    Only the totals of parts, one row a written partition, are added up and joined; they are broadcast if there are few enough.
    """
    read = spark.read.parquet(path)
    parts = read.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = parts.select("part", before.alias("before"))
    if parts.count() <= FEW_PARTS:
        before = F.broadcast(before)
    return read.join(before, "part").withColumn("start", F.col("before") + F.col("offset")).drop("before")


def read_digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = Segment(row["payload"]).all().astype("<u4")
                at = np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int64)
                crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(at, at[1:])]
                cols = [row["doc_ids"], at[:-1] + row["start"], row["lengths"], crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    arrow_rows(spark, 8)
    plain = segments(spark, path).select("start", "doc_ids", "lengths", "payload")
    return plain.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(positions: DataFrame, path: str, column: str = "position") -> DataFrame:
    """The positions with `token_id`: each is read alone from its segment. A position outside the files has none.

    Positions meet their segment by number, so a payload goes to one task once, whatever is asked of it.
    """
    spark = positions.sparkSession
    read, grain = segments(spark, path), SEGMENT_IDS
    where = read.select("part", "segment", "start", (F.col("start") + F.col("n_ids")).alias("stop"))
    cells = where.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / grain), F.floor((F.col("stop") - 1) / grain))))
    asked = positions.select(F.col(column).cast("long").alias("position")).distinct().withColumn("cell", F.floor(F.col("position") / grain))
    hit = asked.join(cells, "cell").where("position >= start and position < stop")
    hit = hit.select(F.col("part").alias("in_part"), F.col("segment").alias("in_segment"), "position", (F.col("position") - F.col("start")).alias("place"))

    def work(asked: pa.Table, payloads: pa.Table) -> pa.Table:
        if not len(asked):
            return pa.table({"position": pa.array([], pa.int64()), "token_id": pa.array([], pa.int64())})
        segment = Segment(payloads["payload"][0].as_py())
        return pa.table({"position": asked["position"], "token_id": pa.array([segment[i] for i in asked["place"].to_pylist()], pa.int64())})

    wanted = hit.select("in_part", "in_segment").distinct()
    payloads = read.select("part", "segment", "payload").join(wanted, (F.col("part") == F.col("in_part")) & (F.col("segment") == F.col("in_segment")), "left_semi")
    got = hit.groupBy("in_part", "in_segment").cogroup(payloads.groupBy("part", "segment")).applyInArrow(work, "position long, token_id long")
    return positions.join(got.withColumnRenamed("position", "__position"), F.col(column) == F.col("__position"), "left").drop("__position")


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write the token files (to `path`, else to the shared folder) and return each document's digest as read back."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, id_col, text_col, tokenizer)
    return read_digests(docs.sparkSession, path)
