"""Alignment of two tokenizers' tokens over the same bytes.

A tokenising stage gives each text the ids of its tokens under both tokenizers and
the byte offsets at which they end. All that follows are Spark's own functions:

* places where tokens of both end (``array_intersect`` of the two arrays of ends) cut
  the text into groups;
* a pair of tokens is linked where their bytes overlap. Two tokens overlap in one run
  of bytes, which ends where one of them ends, so the links are the tokens of both
  sides that hold the last byte before each end; the token of each byte comes from
  ``transform`` over the ends. Arrays of a text are linear in its bytes.

Both tokenizers end a token before white space that follows other bytes, and between
an ASCII letter and punctuation. So tokens, groups and links of a text are those of
its words, cut there, one after another; whether the sentencepiece vocabulary keeps
to that is looked up when it is read. Texts are dealt into chunks of up to 4 MB where
they are read, and a chunk has each distinct word once, with how often it occurs, and
its texts as numbers of words. Words are aligned as texts would be; a text's figures are
sums over its words, its groups those of its words. Texts that must not be cut (other white
space, strings of added tokens, bytes that a tokenizer does not keep) are one word each.

Counts of linked pairs over all texts are joined back to the links. Links lie as rows of
a table bucketed by chunk, so counting a chunk's pairs, looking their totals up again,
and summing by word and text need no shuffle of links: what is shuffled are the distinct
pairs of each chunk, at most once a chunk for the most frequent pair.

A text that is null or empty, or that the two tokenizers do not keep byte for byte,
has no tokens, groups or links. Rows that repeat an id are rows of their own.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.bpe import byte_letters
from tessella.llm.common import ARROW_ROWS, arrow_rows, shared_dir, slices, stage
from tessella.llm.tokens import LETTER, PUNCTUATION, WHITE, Encoder

#: Bytes of text in a chunk, one text at least.
CHUNK_BYTES = 4 << 20
#: Texts handed to sentencepiece at once.
FEW = 64
#: Words in a row: array functions cost more by row than by token.
RUN = 256
#: Words whose tokens a worker keeps: about 150 MB.
KEPT_WORDS = 500_000


class Bytes:
    """The bytes of each id of a vocabulary, one after another, with offsets."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])

    def ends(self, ids: np.ndarray, text: bytes) -> np.ndarray | None:
        """Where each token ends; None unless the tokens are the text."""
        size = self.at[ids + 1] - self.at[ids]
        ends = np.cumsum(size)
        if not len(ids) or ends[-1] != len(text):
            return None
        joined = self.flat[np.repeat(self.at[ids] - (ends - size), size) + np.arange(len(text))]
        return ends if np.array_equal(joined, np.frombuffer(text, np.uint8)) else None


class Words(Encoder):
    """Tokens of words under both tokenizers: ids of A and of B, None for B where one of them does not keep the bytes."""

    opens = WHITE.copy()
    opens[13] = False  # pieces of B end in it

    def add(self, bytes_a: Bytes, b, bytes_b: Bytes, normal: list[int]) -> None:
        """The second tokenizer. `normal`: its ids that merges make; if one of them reaches over a cut, texts are not cut."""
        self.bytes_a, self.b, self.bytes_b = bytes_a, b, bytes_b
        flat, at = bytes_b.flat, bytes_b.at
        over = np.append((self.opens[flat[1:]] & ~WHITE[flat[:-1]]) | (LETTER[flat[:-1]] & PUNCTUATION[flat[1:]]), False)
        over = np.concatenate([[0], np.cumsum(over)])
        normal = np.array(normal, np.int64)
        normal = normal[at[normal + 1] > at[normal]]
        self.by_piece = self.by_piece and b.encode("a") == b.encode("a b")[:-1] and not (over[at[normal + 1] - 1] > over[at[normal]]).any()
        self.before_b = len(b.encode("x"))

    def _encode_pieces(self, keys: list[bytes]) -> list:
        ids_a = super()._encode_pieces(keys)
        # B puts a blank before what it reads: that of the word, or one before a letter whose tokens are left out
        own = [len(key) > 1 and key[0] == 32 for key in keys]
        ids_b = self.b.encode([key[1:].decode() if mine else "x" + key.decode() for key, mine in zip(keys, own, strict=True)], num_threads=1)
        ids_b = [ids if mine else ids[self.before_b :] for ids, mine in zip(ids_b, own, strict=True)]
        count = np.fromiter(map(len, ids_b), np.int64, len(ids_b))
        flat_a, flat_b = np.frombuffer(b"".join(ids_a), self.kind), np.fromiter(chain.from_iterable(ids_b), np.int32, int(count.sum()))
        good = self._kept(keys, flat_a, np.fromiter(map(len, ids_a), np.int64, len(ids_a)) // self.kind.itemsize, self.bytes_a)
        good &= self._kept(keys, flat_b, count, self.bytes_b)
        raw, bounds = flat_b.tobytes(), [0, *(4 * np.cumsum(count)).tolist()]
        return [(a, raw[i:j] if ok else None) for a, i, j, ok in zip(ids_a, bounds, bounds[1:], good.tolist(), strict=False)]

    @staticmethod
    def _kept(keys: list[bytes], flat: np.ndarray, count: np.ndarray, table: Bytes) -> np.ndarray:
        """Whether the tokens of each word, `count` of those in `flat`, are its bytes."""
        lens = np.fromiter(map(len, keys), np.int64, len(keys))
        size, word = table.at[flat.astype(np.int64) + 1] - table.at[flat], np.repeat(np.arange(len(keys)), count)
        good = np.bincount(word, size, len(keys)).astype(np.int64) == lens
        flat, size = flat[good[word]], size[good[word]]
        ends = np.cumsum(size)
        joined = table.flat[np.repeat(table.at[flat] - (ends - size), size) + np.arange(size.sum())]
        unlike = joined != np.frombuffer(b"".join([key for key, ok in zip(keys, good.tolist(), strict=True) if ok]), np.uint8)
        good[np.repeat(np.flatnonzero(good), lens[good])[unlike]] = False
        return good


class Pair:
    """Both tokenizers of a worker."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = Words(path_a, KEPT_WORDS)
        self.a.tokenizer.encode_special_tokens = True  # their strings are plain text
        byte, vocab = byte_letters(), self.a.tokenizer.get_vocab(with_added_tokens=True)
        pieces = [b""] * (max(vocab.values()) + 1)
        for piece, k in vocab.items():
            pieces[k] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        self.bytes_a = Bytes(pieces)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = Bytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)])
        normal = [k for k in range(len(pieces)) if not (self.b.is_byte(k) or self.b.is_control(k) or self.b.is_unknown(k) or self.b.is_unused(k))]
        self.a.add(self.bytes_a, self.b, self.bytes_b, normal)

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, ...] | None]:
        """(A's ids, their ends, B's ids, their ends) of each text, or None."""
        for k in range(0, len(texts), FEW):
            some = texts[k : k + FEW]
            ids_b = self.b.encode(some, num_threads=1)
            ids_a = self.a.tokenizer.encode_batch_fast([" " + t for t in some], add_special_tokens=False)
            for text, a, b in zip(some, ids_a, ids_b, strict=True):
                whole, a, b = (" " + text).encode(), np.array(a.ids, np.int64), np.array(b, np.int64)
                ends_a = self.bytes_a.ends(a, whole) if text else None
                ends_b = None if ends_a is None else self.bytes_b.ends(b, whole)
                yield None if ends_b is None else (a, ends_a, b, ends_b)


_pairs: dict[tuple[str, str], Pair] = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def token_ends(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Tokens of each text under both tokenizers: chunk, row, doc_id, a, a_ends, b, b_ends (arrays, empty without tokens).

    A byte-level tokenizer of the tokenizers library reads a blank and the text, a sentencepiece model the text.
    """
    paths = paths or default_paths()
    arrow_rows(docs.sparkSession)
    arrays = ["a", "a_ends", "b", "b_ends"]
    empty = (np.zeros(0, np.int64),) * 4

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if paths not in _pairs:
            _pairs[paths] = Pair(*paths)
        # the same rows have the same chunks when a lost task runs again
        chunk, row, filled = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            texts = [t or "" for t in batch.columns[1].to_pylist()]
            chunks, rows, found = [], [], []
            for text, tokens in zip(texts, _pairs[paths](texts), strict=True):
                found.append(tokens or empty)
                if filled and filled + len(text) > CHUNK_BYTES:
                    chunk, row, filled = chunk + 1, 0, 0
                chunks.append(chunk)
                rows.append(row)
                row, filled = row + 1, filled + len(text)
            lists = []
            for part in zip(*found, strict=True):
                at = np.cumsum([0, *map(len, part)]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*part, empty[0]]).astype(np.int32))))
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(rows, pa.int64()), batch.columns[0], *lists], names=["chunk", "row", "doc_id", *arrays])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"chunk long, row long, doc_id {kind}, " + ", ".join(f"{c} array<int>" for c in arrays))


def token_words(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Texts as words: rows of words, whose doc_id and ``words`` are null, and rows of texts.

    A chunk's distinct words are numbered from 0. Up to `RUN` of them are a row, numbered by the first, with tokens as
    `token_ends` has them: each word and after it a token of one byte, -1 on both sides. ``w_ends`` has the byte offsets
    at which words end with that token, ``ns`` how often each occurs in the chunk. A text's row has the numbers of its
    ``words``, none if it has no tokens, and how many ``tokens_a`` and ``tokens_b`` it has.
    """
    paths = paths or default_paths()
    arrow_rows(docs.sparkSession, 4 * ARROW_ROWS)  # a chunk is part of a batch
    names = ["chunk", "row", "doc_id", "words", "tokens_a", "tokens_b", "ns", "w_ends", "a", "a_ends", "b", "b_ends"]
    most, lists = CHUNK_BYTES, pa.list_(pa.int32())

    def nested(values: np.ndarray, count: np.ndarray) -> pa.Array:
        at = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(values.astype(np.int32)))

    def sized(found: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(found), kind).astype(np.int32), np.fromiter(map(len, found), np.int64, len(found)) // kind.itemsize

    def tokens(ids: np.ndarray, count: np.ndarray, table: Bytes, starts: np.ndarray, runs: np.ndarray) -> list[pa.Array]:
        """Ids with -1 after each word, and their ends from the start of the run."""
        marked = np.insert(ids, np.cumsum(count), -1)
        size = np.insert(table.at[ids + 1] - table.at[ids], np.cumsum(count), 1)
        ends, count = np.cumsum(size), np.add.reduceat(count + 1, runs)
        return [nested(marked, count), nested(ends - np.repeat(starts, count), count)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if paths not in _pairs:
            _pairs[paths] = Pair(*paths)
        pair = _pairs[paths]
        # the same rows have the same chunks when a lost task runs again
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.columns[1].to_pylist()
            for i, flat, at in slices(pa.array([f" {t or ''}" for t in texts], pa.large_string()), most):
                rows = len(at) - 1
                empty = np.array([not t for t in texts[i : i + rows]])
                cut = pair.a._pieces(flat, at) if pair.a.by_piece else None
                codes, found, first = cut or (np.zeros(0, np.int64), [], np.zeros(rows + 1, np.int64))
                whole = ~empty if cut is None else np.zeros(rows, bool)
                odd = np.array([b is None for _, b in found], bool)
                row = np.repeat(np.arange(rows), np.diff(first))
                whole[row[odd[codes]]] = True
                whole[[int(np.searchsorted(at, m.start(), side="right")) - 1 for m in pair.a.whole.finditer(flat.tobytes())]] = True
                whole &= ~empty
                cut_rows = ~(whole | empty)[row]
                codes, row = codes[cut_rows], row[cut_rows]
                at_whole = np.flatnonzero(whole)
                for k, ids in zip(at_whole.tolist(), pair([texts[i + k] for k in at_whole]), strict=True):
                    if ids is not None:
                        codes, row = np.append(codes, len(found)), np.append(row, k)
                        found.append((ids[0].astype(pair.a.kind).tobytes(), ids[2].astype(np.int32).tobytes()))
                codes, count = codes[np.argsort(row, kind="stable")], np.bincount(row, minlength=rows)
                n = np.bincount(codes, minlength=len(found))
                used = np.flatnonzero(n)
                codes = (np.cumsum(n > 0) - 1)[codes]
                found = [found[k] for k in used.tolist()]
                ids_a, count_a = sized([x for x, _ in found], pair.a.kind)
                ids_b, count_b = sized([x for _, x in found], np.dtype(np.int32))
                of_text = [np.bincount(np.repeat(np.arange(rows), count), c[codes], rows).astype(np.int64) for c in (count_a, count_b)]
                ids, none = batch.columns[0], pa.array([[]] * rows, lists)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, chunk)), pa.array(np.arange(rows)), ids[i : i + rows], nested(codes, count), *map(pa.array, of_text), *[none] * 6], names=names)
                if found:
                    runs = np.arange(0, len(found), RUN)
                    in_run = np.diff(np.append(runs, len(found)))
                    ends = np.cumsum(np.bincount(np.repeat(np.arange(len(found)), count_a), pair.bytes_a.at[ids_a + 1] - pair.bytes_a.at[ids_a], len(found)).astype(np.int64) + 1)
                    starts = np.append(0, ends)[runs]
                    texts_only = [pa.nulls(len(runs), kind) for kind in (ids.type, lists, pa.int64(), pa.int64())]
                    of_words = [nested(n[used], in_run), nested(ends - np.repeat(starts, in_run), in_run)]
                    sides = [*tokens(ids_a, count_a, pair.bytes_a, starts, runs), *tokens(ids_b, count_b, pair.bytes_b, starts, runs)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(runs), chunk)), pa.array(runs), *texts_only, *of_words, *sides], names=names)
                chunk += 1

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"chunk long, row long, doc_id {kind}, words array<int>, tokens_a long, tokens_b long, " + ", ".join(f"{c} array<int>" for c in names[6:]))


def _let(value: Column, use) -> Column:
    """A value named inside an expression, so that it is made once a row however often a lambda reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _steps(ends: Column) -> Column:
    """Rising numbers as their differences, the first from 0."""
    return F.zip_with(ends, F.slice(F.concat(F.array(F.lit(0)), ends), 1, F.size(ends)), lambda e, before: e - before)


def _token_of_byte(ends: Column) -> Column:
    """For each byte the place (from 0) of the token that holds it."""
    return F.flatten(F.transform(_steps(ends), lambda size, k: F.array_repeat(k, size)))


def align(tokens: DataFrame, *others: str) -> DataFrame:
    """Groups of each row of `token_ends` or `token_words`, with its `others`: ``cuts_a`` and ``cuts_b`` count the tokens of both sides up to the end of each group.

    ``at_a`` and ``at_b`` (the place of each byte's token) and ``ends`` (of both sides, each once) serve `links`.
    """
    places = tokens.withColumns({"at_a": _token_of_byte(F.col("a_ends")), "at_b": _token_of_byte(F.col("b_ends"))})
    known = F.struct("at_a", "at_b", F.array_intersect("a_ends", "b_ends").alias("common"))

    def cut(s: Column, c: str) -> Column:
        return F.transform(s["common"], lambda e: F.get(s[f"at_{c}"], e - 1) + 1).alias(c)

    cuts = _let(known, lambda s: F.struct(cut(s, "a"), cut(s, "b")))
    sizes = [F.size(c).cast("long").alias(f"n_{c}") for c in ("a", "b")]
    out = places.select("chunk", "row", "doc_id", *others, *sizes, "a", "at_a", "b", "at_b", cuts.alias("cuts"), F.array_union("a_ends", "b_ends").alias("ends"))
    return out.withColumns({"cuts_a": F.col("cuts.a"), "cuts_b": F.col("cuts.b")}).drop("cuts")


def groups() -> Column:
    """The groups of an aligned row: an array of (a, b), the ids of both sides in order."""

    def side(c: str) -> Column:
        return _let(F.struct(c, f"cuts_{c}"), lambda s: F.zip_with(s[f"cuts_{c}"], _steps(s[f"cuts_{c}"]), lambda end, n: F.slice(s[c], end - n + 1, n)))

    return F.zip_with(side("a"), side("b"), lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def group_text() -> Column:
    """The groups of an aligned row as decimal ids: ``a1,a2|b1;a3|b2,b3``."""

    def side(s: Column, c: str) -> Column:
        def ids(end: Column, n: Column) -> Column:  # most groups have one token of a side
            return F.when(n == 1, F.get(s[c], end - 1)).otherwise(F.array_join(F.slice(s[c], end - n + 1, n), ","))

        return F.zip_with(s[f"cuts_{c}"], _steps(s[f"cuts_{c}"]), ids)

    # ids become text once a row; lambdas run expression by expression, so they do as little as they can
    known = F.struct(*(F.col(c).cast("array<string>").alias(c) for c in ("a", "b")), "cuts_a", "cuts_b")
    return _let(known, lambda s: F.array_join(F.zip_with(side(s, "a"), side(s, "b"), lambda x, y: F.concat(x, F.lit("|"), y)), ";"))


def links(aligned: DataFrame, *others: str, words: bool = False) -> DataFrame:
    """A row for each overlap of two tokens: chunk, row, ``pair`` as ``(a << 32) | b``; of a text's rows the first also has its ``others``.

    A text without links has one row, whose pair is null. With `words`, rows have the ``word`` they are in and its ``n`` of ``ns``.
    """
    rows = aligned.select("chunk", "row", "a", "at_a", "b", "at_b", *(("at_w", "ns") if words else ()), *others, F.posexplode_outer("ends").alias("pos", "end"))
    a, b = (F.get(F.col(c), F.get(F.col(f"at_{c}"), F.col("end") - 1)).cast("long") for c in ("a", "b"))
    first = F.coalesce("pos", F.lit(0)) == 0
    word = F.get("at_w", F.col("end") - 1)
    of_word = [(F.col("row") + word).alias("word"), F.get("ns", word).cast("long").alias("n")] if words else []
    return rows.select("chunk", "row", *of_word, F.shiftleft(a, 32).bitwiseOR(b).alias("pair"), first.alias("first"), *(F.when(first, F.col(c)).alias(c) for c in others))


def alignment_digests(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Per document its tokens, groups and links, how often its linked pairs are linked in all documents, and SHA-256 of its groups.

    ``n_best`` counts the links whose pair is linked as often as any pair of its B id; ``count_sum`` adds up the pairs' counts over the links.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    of_text = ["doc_id", "words", "tokens_a", "tokens_b"]
    aligned = align(token_words(docs, paths), *of_text[1:], "ns", "w_ends")
    by_word = F.slice(F.split(group_text(), r";-1\|-1;?"), 1, F.size("ns"))
    aligned = aligned.select("chunk", "row", *of_text, "ns", "a", "at_a", "b", "at_b", _token_of_byte(F.col("w_ends")).alias("at_w"), "ends", F.when(F.col("words").isNull(), by_word).alias("groups"))
    table = f"token_links_{uuid.uuid4().hex}"
    own = {
        "spark.sql.maxConcurrentOutputFileWriters": str(parts),  # a task's few chunks go to their buckets without sorting the links
        "spark.sql.requireAllClusterKeysForCoPartition": "false",  # a table dealt by chunk serves joins by chunk and pair as it lies
    }
    before = {key: spark.conf.get(key) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        rows = links(aligned, *of_text, "groups", words=True).where("pair is null or pair <> -1")
        rows.write.bucketBy(parts, "chunk").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
        linked = spark.table(table).where("pair is not null").select("chunk", "word", "pair", "n")
        pairs = stage(linked.groupBy("chunk", "pair").agg(F.sum("n").alias("n")), "pairs")
        counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
        counts = stage(counts, "counts")
        best = counts.groupBy("b").agg(F.max("count").alias("most"))  # at most one row an id of B's vocabulary
        ranked = counts.join(F.broadcast(best), "b").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
        known = pairs.join(ranked, "pair").select("chunk", "pair", "count", "best")
        sums = linked.join(known.hint("shuffle_hash"), ["chunk", "pair"]).groupBy("chunk", "word").agg(F.count("*").alias("n_links"), F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
        # of a chunk, up to CHUNK_BYTES of text
        sums = sums.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("word", "n_links", "n_best", "count_sum"))).alias("sums"))
        groups = spark.table(table).where("groups is not null").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("row", "groups"))).alias("runs"))
        texts = spark.table(table).where("words is not null").groupBy("chunk").agg(F.collect_list(F.struct(*of_text)).alias("texts"))
        summed = ["n_links", "n_best", "count_sum"]
        known = F.struct("texts", *(F.col(f"sums.{c}").alias(c) for c in summed), F.flatten("runs.groups").alias("groups"))

        def total(of: Column, text: Column) -> Column:
            return F.aggregate(text["words"], F.lit(0).cast("long"), lambda so_far, k: so_far + F.get(of, k))

        def figures(s: Column, text: Column) -> Column:
            groups = F.array_join(F.transform(text["words"], lambda k: F.get(s["groups"], k)), ";")
            return F.struct(*(text[c].alias(c) for c in of_text), *(total(s[c], text).alias(c) for c in summed), groups.alias("groups"))

        out = texts.join(groups, "chunk", "left").join(sums, "chunk", "left").select(F.inline(_let(known, lambda s: F.transform(s["texts"], lambda text: figures(s, text)))))
        n_groups = (F.octet_length("groups") - F.octet_length(F.replace("groups", F.lit("|"), F.lit("")))).cast("long")  # a bar each
        digest = F.when(F.size("words") > 0, F.sha2("groups", 256)).otherwise("")
        out = out.select("doc_id", F.col("tokens_a").alias("n_a"), F.col("tokens_b").alias("n_b"), n_groups.alias("n_groups"), *summed, digest.alias("groups_sha256"))
        return stage(out, "aligned")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
        spark.sql(f"DROP TABLE IF EXISTS {table}")
