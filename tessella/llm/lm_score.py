"""Stupid-backoff language-model scores of every document, against all other documents.

The score of a word is count(n-gram) / count(its context) for the longest n-gram
that occurs in another document, times 0.4 for every order that had to be given
up; a word of no other document counts as one occurrence. A document's own
n-grams are taken out of the counts, or each would be its own evidence.

Rows of a partition that follow each other form chunks of about `CHUNK_WORDS` words.
A chunk's n-grams are exploded and counted in the chunk first, so a frequent n-gram
leaves it once, whatever its share of the corpus. An n-gram's key is a 46-bit hash
of order and words; its upper bits, the bucket, partition the count table, a
DataFrame of (bucket, rest, chunk, n) whose totals by (bucket, rest) are joined to
its rows. Those of n-grams of two chunks or more go back to the chunk, where they
are joined to the n-grams and summed by document. The table is made level by level: an n-gram of three
words or more can only occur elsewhere if both of its shorter ones do, so only those
are counted. That is exact. Between stages the n-grams of a chunk and bucket travel
as arrays in one row, a few bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.common import arrow_rows, mix, slices, word_hashes, word_spans

ORDER, BACKOFF, CHUNK_WORDS, PART_KEYS = 3, 0.4, 2_000_000, 1_200_000
#: Bits of a key that name its bucket; 32 more follow.
BUCKET_BITS = 14
#: Counts up to this one travel as bytes, others in rows of their own.
FEW = 127
QUESTION = "bucket int, chunk long, rest array<int>, few array<tinyint>, many array<long>"


def _chunks(docs: DataFrame, chunk_words: int) -> DataFrame:
    """(chunk, payload): runs of rows as compressed Arrow streams of doc_id and text; a chunk closes once it has its words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            words = np.concatenate([np.zeros(0, np.int64), *(np.diff(word_spans(flat, at)[2]) for _, flat, at in slices(batch.column(1)))])
            i = 0
            while i < len(batch):
                n = int(np.searchsorted(held + np.cumsum(words[i:]), chunk_words)) + 1
                piece = batch.slice(i, n)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in piece.columns], schema=piece.schema))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "payload"])
                held += int(words[i : i + n].sum())
                i += n
                if held >= chunk_words:
                    chunk, held = chunk + 1, 0

    return docs.mapInArrow(work, "chunk long, payload binary")


def _rows(table: pa.Table) -> pa.Table:
    """The documents of a chunk."""
    # payloads in an order of their own, so that rows come in the same order each time
    return pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in sorted(table["payload"].to_pylist())).combine_chunks()


class _Words:
    """Word hashes of a chunk's documents, and their n-grams."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        words, firsts, base = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
        for _, flat, at in slices(column):
            w, first = word_hashes(flat, at)
            words.append(w)
            firsts.append(first[1:] + base)
            base += len(w)
        self.hashes, self.first = np.concatenate(words), np.concatenate(firsts)
        self.row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all n-grams of k words and the places of their last words."""
        n = len(self.hashes) - k + 1
        if n < 1:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = mix(out * np.uint64(0x100000001B3) + self.hashes[j : n + j])
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 :])  # those inside one document
        return mix(out[at] + np.uint64(k)) >> np.uint64(32 - BUCKET_BITS), at + k - 1

    def open_grams(self, k: int, elsewhere: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Those that may occur in another document: both of their shorter n-grams do."""
        keys, place = self.grams(k)
        if k > 2:
            seen = elsewhere[k - 1] > 0
            at = np.flatnonzero(seen[place] & seen[place - 1])
            keys, place = keys[at], place[at]
        return keys, place

    def elsewhere(self, totals: tuple[np.ndarray, np.ndarray], most: int) -> dict[int, np.ndarray]:
        """By order, and by place of the last word, how often an n-gram occurs in other documents; totals are (sorted keys, counts) of keys that other chunks have too."""
        out: dict[int, np.ndarray] = {}
        for k in range(1, most + 1):
            keys, place = self.open_grams(k, out)
            code, names = pd.factorize(keys)
            count = np.bincount(code, minlength=len(names))
            if len(totals[0]) and len(names):
                at = np.minimum(np.searchsorted(totals[0], names), len(totals[0]) - 1)
                count = np.where(totals[0][at] == names, totals[1][at], count)
            left = count[code]
            # what the document itself has; a total of one is its own
            many = np.flatnonzero(left > 1)
            pair, _ = pd.factorize(code[many] * len(self.first) + self.row[place[many]])
            own = np.ones(len(left), np.int64)
            own[many] = np.bincount(pair, minlength=1)[pair] if len(pair) else 0
            out[k] = np.zeros(len(self.row), np.int64)
            out[k][place] = left - own
        return out


def _question(chunk: int, keys: np.ndarray) -> pa.Table:
    """One row a bucket with the rests of the chunk's distinct keys and how often each occurs; one more for those that occur often."""
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("rest", pa.list_(pa.int32())), ("few", pa.list_(pa.int8())), ("many", pa.list_(pa.int64()))])
    keys, n = np.unique(keys, return_counts=True)

    def rows(at: np.ndarray, often: bool) -> pa.Table:
        bucket, first = np.unique(keys[at] >> np.uint64(32), return_index=True)
        ends = pa.array(np.append(first, len(at)), pa.int32())
        rest = pa.array((keys[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
        none = pa.array(np.zeros(len(bucket) + 1, np.int32))
        counts = [pa.ListArray.from_arrays(none if often else ends, pa.array(n[at] if not often else [], pa.int8())), pa.ListArray.from_arrays(ends if often else none, pa.array(n[at] if often else [], pa.int64()))]
        return pa.Table.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(np.full(len(bucket), chunk)), pa.ListArray.from_arrays(ends, rest), *counts], schema=schema)

    return pa.concat_tables([rows(np.flatnonzero(n <= FEW), False), rows(np.flatnonzero(n > FEW), True)])


def _totals(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, counts) of a chunk's answers."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for rest, count in (("few_rest", "few"), ("many_rest", "many")):
        lists = table[rest].combine_chunks() if len(table) else pa.array([], pa.list_(pa.int32()))
        low = lists.flatten().to_numpy().view(np.uint32).astype(np.uint64)
        keys.append(np.repeat(table["bucket"].to_numpy().astype(np.uint64) << np.uint64(32), lists.value_lengths().to_numpy()) | low)
        counts.append(table[count].combine_chunks().flatten().to_numpy().astype(np.int64) if len(table) else np.zeros(0, np.int64))
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    return key[order], count[order]


def _counted(questions: DataFrame, parts: int, chunk_parts: int) -> DataFrame:
    """(bucket, chunk, few_rest, few, many_rest, many): the corpus totals of those n-grams of each chunk that another chunk has too."""
    # the count table, each n-gram's total joined to the chunks that have it: a window, so that one exchange serves both
    packed = questions.repartition(parts, "bucket")
    grams = packed.select("bucket", "chunk", F.inline(F.arrays_zip("rest", "few", "many"))).select("bucket", "chunk", "rest", F.coalesce(F.col("few").cast("long"), "many").alias("n"))
    total = F.sum("n").over(Window.partitionBy("bucket", "rest"))
    # an n-gram of one chunk needs no answer, as the chunk has counted it
    shared = grams.withColumn("total", total).where("total > n")
    often = F.col("total") > FEW
    few, many = F.struct("rest", F.col("total").cast("tinyint").alias("total")), F.struct("rest", "total")
    answers = shared.groupBy("bucket", "chunk").agg(F.collect_list(F.when(~often, few)).alias("f"), F.collect_list(F.when(often, many)).alias("m"))
    columns = (F.col(f"{c}.{x}").alias(name) for c, x, name in (("f", "rest", "few_rest"), ("f", "total", "few"), ("m", "rest", "many_rest"), ("m", "total", "many")))
    return answers.select("bucket", "chunk", *columns).repartition(chunk_parts, "chunk")


def _number_of_words(docs: DataFrame) -> int:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(len(word_spans(flat, at)[0]) for batch in batches for _, flat, at in slices(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return docs.select("text").mapInArrow(work, "n long").agg(F.sum("n")).first()[0] or 0


def _log_scores(elsewhere: dict[int, np.ndarray], words: _Words, total: int, order: int, backoff: float) -> np.ndarray:
    """Log-score of every word, from counts in other documents by order and place of last word."""
    place = np.arange(len(words.row)) - words.first[:-1][words.row]  # place in the document
    others = (total - np.diff(words.first))[words.row].astype(np.float64)
    score = np.maximum(elsewhere[1], 1) / np.maximum(others, 1)
    used = np.ones(len(place), dtype=np.int64)
    for k in range(2, order + 1):
        at = np.flatnonzero(elsewhere[k] > 0)
        score[at] = elsewhere[k][at] / elsewhere[k - 1][at - 1]
        used[at] = k
    return np.log(score) + np.log(backoff) * (np.minimum(place + 1, order) - used)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """doc_id, n_words, log_score (sum over words, natural log), score (its mean) for every row.

    Words are runs of anything but white space, A-Z lower-cased. A null or blank
    text has no words, log_score 0 and a null score. Rows are documents of their
    own, also with equal or null ids. In a corpus of one document nothing is seen
    elsewhere, so each word scores as one occurrence in one. An empty table gives
    no rows. Other columns are ignored. N-grams are told apart by 46 bits of a hash: in
    half a gigabyte of text, of a million n-grams that no other document has about two are
    taken for one that some has.
    """
    arrow_rows(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = _number_of_words(plain)
    chunk_parts, parts = max(1, -(-2 * total // chunk_words)), max(1, -(-total // PART_KEYS))
    texts = _chunks(plain, chunk_words).repartition(chunk_parts, "chunk")
    result = pa.schema([("doc_id", to_arrow_type(plain.schema["doc_id"].dataType)), ("n_words", pa.int64()), ("log_score", pa.float64()), ("score", pa.float64())])

    def first_question(table: pa.Table) -> pa.Table:
        words = _Words(_rows(table)["text"])
        return _question(table["chunk"][0].as_py(), np.concatenate([words.grams(k)[0] for k in range(1, min(order, 2) + 1)]))

    def next_question(k: int):
        def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
            words = _Words(_rows(table)["text"])
            return _question(table["chunk"][0].as_py(), words.open_grams(k, words.elsewhere(_totals(answers), k - 1))[0])

        return ask

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _rows(table)
        words = _Words(rows["text"])
        each = _log_scores(words.elsewhere(_totals(answers), order), words, total, order, backoff)
        n_words = np.diff(words.first)
        log_score = np.bincount(words.row, each, len(rows)) if len(each) else np.zeros(len(rows))
        mean = pa.array(log_score / np.maximum(n_words, 1), mask=n_words == 0)
        return pa.Table.from_arrays([rows["doc_id"], pa.array(n_words), pa.array(log_score), mean], schema=result)

    answers = _counted(texts.groupBy("chunk").applyInArrow(first_question, QUESTION), parts, chunk_parts)
    for k in range(3, order + 1):
        more = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(next_question(k), QUESTION)
        answers = answers.union(_counted(more, parts, chunk_parts))
    kind = plain.dtypes[0][1]
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, f"doc_id {kind}, n_words long, log_score double, score double")
