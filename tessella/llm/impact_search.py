"""Ranked lexical search over a bit-sliced impact index.

A term's impact on a document is the integer that it adds to a score. The index
holds, for each block of documents and each term, which documents have the term and
one bitmap for each bit of their impacts. A query's scores in a block are the sum of
its terms' bitmaps, added by carry arithmetic on 64 documents at a time; the k
highest are found by going down the slices of the sum from the most significant one:
documents with the bit are taken together while they are fewer than the places left,
else the others are left out. What remains at the end are ties, of which the lowest
ids are taken.

Score of document d for a query: the sum over the query's terms, repeats included, of
w * ((10**9 * tf) div (1000 * tf + 8 * m)) with w = floor(1000 * ln((2N + 2) / (2df + 1)))
and m = 100 - 75 + (75 * n * N) div L. N is the number of documents with a term, L and n the
numbers of terms of all and of one, repeats included. Terms are runs of letters A-Z
and a-z, digits and characters beyond ASCII, with only A-Z lower-cased, and are told
apart by a 64-bit hash.

The texts are read twice: once for N, L and the documents of each asked term, once
for the index, which is a table in the shared folder with one row a block. Rows are
cut into blocks where they are read, so nothing is shuffled but at most k rows a
query and block. A block ends at 16,384 documents or 64 MB of text, so its bitmaps
stay in cache while they are added. Queries are taken in batches of about 2**18
entries, a few MB for each worker; each batch has its own index of its terms.

Nulls: a null text has no terms, neither matches nor counts; a null query has no
rows; documents without an id come last among equal scores. Rows that repeat an id
are documents or queries of their own. Fewer than k rows come where fewer documents
score above 0, none for a query without known terms. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from tessella.llm.common import LOWER, Recent, arrow_rows, slices, span_hashes, stage

BLOCK_ROWS, BLOCK_BYTES, BATCH_ENTRIES = 1 << 14, 64 << 20, 1 << 18
TERM = np.zeros(256, dtype=bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True
#: Terms of a block whose bitmaps are kept while its queries run: about 20 MB.
KEPT_TERMS = 512
#: No id: after all others.
NO_ID = np.iinfo(np.int64).max


def terms_of(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term, and the first term of each row."""
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = TERM[flat]
    cut = np.zeros(len(flat) + 1, dtype=bool)
    cut[at] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return span_hashes(LOWER[flat], starts, np.flatnonzero(ends) + 1), np.searchsorted(starts, at)


def postings(vocabulary: np.ndarray, terms: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term's place in the sorted vocabulary, row, occurrences) by term, then row."""
    place = np.minimum(np.searchsorted(vocabulary, terms), max(len(vocabulary) - 1, 0))
    known = np.flatnonzero(vocabulary[place] == terms) if len(vocabulary) else np.zeros(0, np.int64)
    rows = len(first) - 1
    row = np.searchsorted(first, known, side="right") - 1
    keys, tf = np.unique(place[known] * np.int64(rows) + row, return_counts=True)
    return keys // max(rows, 1), keys % max(rows, 1), tf


def bitmap(rows: np.ndarray, words: int) -> np.ndarray:
    """64 rows a word, the lowest first."""
    out = np.zeros(words * 64, dtype=np.uint8)
    out[rows] = 1
    return np.packbits(out, bitorder="little").view("<u8")


def sliced(values: np.ndarray) -> list[np.ndarray]:
    """One bitmap over the values for each bit, the lowest first."""
    size = -(-len(values) // 64) * 64
    bits = [np.zeros(size, np.uint8) for _ in range(int(values.max()).bit_length())]
    for k, out in enumerate(bits):
        out[: len(values)] = (values >> k) & 1
    return [np.packbits(b, bitorder="little").view("<u8") for b in bits]


def carry_add(total: list[np.ndarray], added: list[np.ndarray], words: int) -> None:
    """Add sliced numbers to sliced sums: exclusive or for the bit, majority for the carry."""
    carry = np.zeros(words, "<u8")
    for k in range(max(len(total), len(added)) + 1):
        if k >= len(added) and not carry.any():
            return
        if k == len(total):
            total.append(np.zeros(words, "<u8"))
        x = total[k]
        if k < len(added):
            either = x ^ added[k]
            total[k], carry = either ^ carry, (x & added[k]) | (either & carry)
        else:
            total[k], carry = x ^ carry, x & carry


def positions(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def highest(total: list[np.ndarray], words: int, k: int) -> np.ndarray:
    """Rows of the k highest sums above 0; of equal ones at the border the lowest rows."""
    some = np.zeros(words, "<u8")
    for t in total:
        some |= t
    taken, open_ = np.zeros(words, "<u8"), some
    left = k
    for t in reversed(total):
        having = open_ & t
        n = int(np.bitwise_count(having).sum())
        if n > left:
            open_ = having
        else:
            taken |= having
            open_ &= ~t
            left -= n
    return np.concatenate([positions(taken), positions(open_)[:left]])


def sums_at(total: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    for k, t in enumerate(total):
        out |= ((t[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << k
    return out


class Block:
    """Postings of consecutive documents, and their index when they are complete."""

    def __init__(self) -> None:
        self.ids, self.bytes, self.parts = [], 0, []

    def add(self, ids: list, first: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], size: int) -> None:
        term, row, tf = found
        self.parts.append((term, row + len(self.ids), tf, np.diff(first)[row]))
        self.ids += ids
        self.bytes += size

    def index(self, weights: np.ndarray, documents: int, terms: int) -> tuple[bytes, bytes]:
        """Ids in rising order; then for each term with an impact: its place, documents and bits, its documents' places, and its slices."""
        ids = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term, row, tf, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        tf = tf.astype(np.int64)
        m = 25 + np.array([75 * int(v) * documents // terms for v in np.unique(n)], np.int64)[np.unique(n, return_inverse=True)[1]] if len(n) else n
        impact = weights[term] * ((10**9 * tf) // (1000 * tf + 8 * m))
        row = place[row]
        keep = np.flatnonzero(impact > 0)
        keep = keep[np.lexsort((row[keep], term[keep]))]
        term, row, impact = term[keep], row[keep], impact[keep]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(term)) + 1, [len(term)]]) if len(term) else np.zeros(1, np.int64)
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            bits = sliced(impact[a:b])
            out += [np.array([term[a], b - a, len(bits)], "<i8").tobytes(), row[a:b].astype("<i4").tobytes() + b"\0" * (4 * ((b - a) % 2)), *(x.tobytes() for x in bits)]
        return ids[order].tobytes(), b"".join(out)


class Reader:
    """A block's index: each term's slices over all rows of the block, those used lately kept."""

    def __init__(self, data: bytes, words: int) -> None:
        self.data, self.words, self.at, self.kept = data, words, {}, Recent(KEPT_TERMS)
        at = 0
        while at < len(data):
            term, n, bits = np.frombuffer(data, "<i8", 3, at).tolist()
            self.at[term] = (at + 24, n, bits)
            at += 24 + 4 * (n + n % 2) + 8 * bits * -(-n // 64)

    def slices(self, term: int) -> list[np.ndarray] | None:
        if term not in self.at:
            return None
        found = self.kept.get(term) or self.kept.find(term)
        if found is None:
            at, n, bits = self.at[term]
            rows, own = np.frombuffer(self.data, "<i4", n, at), -(-n // 64)
            packed = np.frombuffer(self.data, "<u8", bits * own, at + 4 * (n + n % 2)).reshape(bits, own)
            found = self.kept.put(term, [bitmap(rows[positions(b)], self.words) for b in packed])
        return found


def _statistics(texts: DataFrame, vocabulary: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms with repeats, and the documents of each term of the vocabulary."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, having, terms_seen = shared.value, 0, 0
        df = np.zeros(len(words), np.int64)
        for batch in batches:
            for _, flat, at in slices(batch.columns[0]):
                terms, first = terms_of(flat, at)
                having += int((np.diff(first) > 0).sum())
                terms_seen += len(terms)
                df += np.bincount(postings(words, terms, first)[0], minlength=len(words))
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, [-1, -2])), pa.array(np.append(df[found], [having, terms_seen]))], names=["term", "n"])

    counted = texts.mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    shared.unpersist()
    df, totals = np.zeros(len(vocabulary), np.int64), {}
    for r in counted:  # at most one row a term of the batch, and two
        if r.term < 0:
            totals[r.term] = r.n
        else:
            df[r.term] = r.n
    return totals.get(-1, 0), totals.get(-2, 0), df


def build_index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Index of the documents (doc_id, text) for terms given by sorted hashes: a staged table of doc_ids and index, one row a block."""
    texts = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    documents, terms_seen, df = _statistics(texts.select("text"), vocabulary)
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, w = shared.value

        def done(block: Block) -> pa.RecordBatch:
            ids, index = block.index(w, documents, max(terms_seen, 1))
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([index], pa.binary())], names=["doc_ids", "index"])

        block = Block()
        for batch in batches:
            ids = batch.columns[1].to_pylist()
            for start, flat, at in slices(batch.columns[0]):
                if len(block.ids) + len(at) - 1 > BLOCK_ROWS or block.bytes + len(flat) > BLOCK_BYTES:
                    if block.ids:
                        yield done(block)
                    block = Block()
                terms, first = terms_of(flat, at)
                block.add(ids[start : start + len(at) - 1], first, postings(words, terms, first), len(flat))
        if block.ids:
            yield done(block)

    return stage(texts.mapInArrow(work, StructType([StructField("doc_ids", BinaryType()), StructField("index", BinaryType())])), "impacts")


def search(index: DataFrame, queries: list[dict[int, int]], k: int) -> DataFrame:
    """The k best documents of each block for each query (place of a term in the vocabulary -> repeats): query, doc_id, score."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(ids, np.int64)
                words = -(-len(ids) // 64)
                reader, out = Reader(data, words), []
                for q, asked in enumerate(shared.value):
                    total: list[np.ndarray] = []
                    for term, repeats in asked.items():
                        added = reader.slices(term)
                        if added is None:
                            continue
                        for shift in range(repeats.bit_length()):  # a repeated term by the bits of its repeats
                            if repeats >> shift & 1:
                                carry_add(total, [np.zeros(words, "<u8")] * shift + added, words)
                    if total:
                        rows = highest(total, words, k)
                        out.append((np.full(len(rows), q), ids[rows], sums_at(total, rows)))
                q, found, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(found, mask=found == NO_ID), pa.array(score)], names=["query", "doc_id", "score"])

    arrow_rows(index.sparkSession, 1)  # a block may have tens of MB
    return index.mapInArrow(work, "query long, doc_id long, score long")


def _asked(items: DataFrame) -> DataFrame:
    """Terms of each query with their repeats: query, item_id, term."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, flat, at in slices(batch.columns[2]):
                terms, first = terms_of(flat, at)
                row = np.repeat(np.arange(len(at) - 1) + start, np.diff(first))
                yield pa.RecordBatch.from_arrays([batch.columns[0].take(pa.array(row)), batch.columns[1].take(pa.array(row)), pa.array(terms.view(np.int64))], names=["query", "item_id", "term"])

    numbered = items.select(F.monotonically_increasing_id().alias("query"), "item_id", "text")
    kind = StructType([StructField("query", LongType()), items.schema["item_id"], StructField("term", LongType())])
    return numbered.mapInArrow(work, kind).groupBy("query", "item_id", "term").agg(F.count("*").alias("repeats"))


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """For each item (item_id, text) its k highest-scoring documents: item_id, rank from 1, doc_id, score."""
    spark: SparkSession = docs.sparkSession
    arrow_rows(spark)
    asked = stage(_asked(items), "asked")
    batches = max(1, -(-asked.count() // BATCH_ENTRIES))
    found = None
    for b in range(batches):
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(batches)) == b).collect()  # about BATCH_ENTRIES of them
        vocabulary = np.unique(np.array([r.term for r in rows], np.int64).view(np.uint64))
        place = np.searchsorted(vocabulary, np.array([r.term for r in rows], np.int64).view(np.uint64)).tolist()
        names: dict[int, int] = {}
        queries: list[dict[int, int]] = []
        for r, p in zip(rows, place, strict=True):
            if r.query not in names:
                names[r.query] = len(queries)
                queries.append({})
            queries[names[r.query]][p] = r.repeats
        best = search(build_index(docs, vocabulary), queries, k)
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        numbers = spark.createDataFrame(list(enumerate(names)), "query long, number long")
        best = best.join(F.broadcast(numbers), "query").select(F.col("number").alias("query"), "rank", "doc_id", "score")
        best = stage(best, "ranked")
        arrow_rows(spark)
        found = best if found is None else found.unionByName(best)
    named = asked.select("query", "item_id").distinct()
    return found.join(named, "query").select("item_id", F.col("rank").cast(IntegerType()).alias("rank"), "doc_id", "score")
