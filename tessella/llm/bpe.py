"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A text's words (what the file's splitting pattern finds after its normaliser) are
encoded one by one. An Aho-Corasick automaton over all tokens gives the longest
token that begins at each byte of a word. The encoder takes it if it is compatible
with the token before it, else the next shorter token that is a prefix of it, and
goes back one token where none is left; a place that was left so is never entered
again, so a word takes linear time. Two neighbours are compatible if merging would
never join across their border. That is read off the merges once for each pair that
turns up and kept in a table. Neighbours that are all compatible are exactly what
applying the merges in order gives.

Decoding joins the strings of tokens, all of which lie one after another in one
array of bytes with an array of offsets.

Files are those of the tokenizers library with a BPE model whose pre-tokenizer keeps
the matches of a pattern, as bytes; the normaliser may compose, collapse white space
and lower-case; strings of added tokens are their ids wherever they stand. Unused
truncation and padding are not applied. Nulls are empty texts and have no ids.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tessella.llm.common import Recent, arrow_rows

#: Words that a worker keeps, and pairs of tokens; the halves met lately stay known.
KEPT, KEPT_PAIRS = 250_000, 1_000_000
#: Characters of a word that is kept; longer ones are encoded each time.
LONGEST = 100
#: Characters of a text that are split into words at once, up to the next white space.
CHUNK = 1 << 20
#: Ids that are joined at once.
JOINED = 1 << 18
_WHITE = re.compile(r"[ \t\r\n]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """A vocabulary and its merges as tables; `encode` gives the ids of one word."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = "") -> None:
        import ahocorasick

        byte = byte_letters()
        self.mark = "Ā" if suffix else ""
        self.base = max(vocab.values()) + 1
        keys = {t: chr(byte[t[:1]]) + self.mark * (len(t) > 1) for t in vocab if t[:1] in byte and t[1:] in ("", suffix)}
        self.left, self.right, self.rank, self.join = {}, {}, {}, {}
        for k, pair in enumerate(merges):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            token = vocab[x + y]
            if token in self.rank or x + y in keys:
                raise ValueError(f"{x + y!r} is made in two ways")
            keys[x + y] = keys[x] + keys[y]
            self.left[token], self.right[token], self.rank[token] = vocab[x], vocab[y], k
            self.join[vocab[x] * self.base + vocab[y]] = k
        ids = {key: vocab[t] for t, key in keys.items()}
        self.size = {token: len(key) for key, token in ids.items()}
        self.shorter = {token: next((ids[key[:n]] for n in range(len(key) - 1, 0, -1) if key[:n] in ids), -1) for key, token in ids.items()}
        self.tokens = ahocorasick.Automaton()
        for key, token in ids.items():
            self.tokens.add_word(key, (token, len(key)))
        self.tokens.make_automaton()
        self.pairs = Recent(KEPT_PAIRS)

    def _border(self, token: int, side: dict[int, int]) -> list[tuple[int, float]]:
        """What stands at one end of a token while it is merged, each with the merge that takes it away."""
        out, gone = [], float("inf")
        while True:
            out.append((token, gone))
            if token not in side:
                return out
            token, gone = side[token], self.rank[token]

    def compatible(self, x: int, y: int) -> bool:
        """Whether no merge joins a piece at the end of x with one at the start of y while both stand there.

        Of equal merges the left one comes first, so a piece of y is still there for its own merge, a piece of x no longer.
        """
        key = x * self.base + y
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs.find(key)
        if known is None:
            starts = self._border(y, self.left)
            known = True
            for end, end_gone in self._border(x, self.right):
                for start, start_gone in starts:
                    at = self.join.get(end * self.base + start)
                    if at is not None and at < end_gone and at <= start_gone:
                        known = False
            self.pairs.put(key, known)
        return known

    def encode(self, word: str) -> list[int]:
        key = word.encode().decode("latin-1") + self.mark
        longest = [-1] * len(key)
        for end, (token, size) in self.tokens.iter(key):
            longest[end - size + 1] = token
        out: list[int] = []
        at, left = 0, bytearray(len(key) + 1)
        token = longest[0] if key else -1
        while at < len(key):
            while token >= 0 and (left[at + self.size[token]] or (out and not self.compatible(out[-1], token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += self.size[token]
                token = longest[at] if at < len(key) else -1
            else:
                left[at] = 1
                token = out.pop()
                at -= self.size[token]
                token = self.shorter[token]
        return out


class Coder:
    """Ids of whole texts and texts of ids, by one tokenizer file."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [])
        kinds = [s["type"] for s in steps]
        if model["type"] != "BPE" or kinds != ["Split", "ByteLevel"] or not steps[0]["invert"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"] or spec["decoder"] or model.get("dropout"):
            raise ValueError(f"{path} is not a file of byte-level BPE over the matches of a pattern")
        self.word = regex.compile(steps[0]["pattern"]["Regex"])
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        strings = {token: text for text, token in (model["vocab"] | self.added).items()}
        self.kind = np.dtype("<u2" if max(strings) < 1 << 16 else "<u4")
        pieces = [strings.get(k, "").encode() + b" " for k in range(max(strings) + 1)]
        self.letters = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.plain: dict[str, bool] = {}
        self.known = Recent(KEPT)

    def _as_python(self, c: str) -> bool:
        """Whether Python lower-cases and splits at this character as the library does."""
        low = self.tokenizer.normalizer.normalize_str(c)
        if c == "Σ" or (low != c.lower() and not (low == " " and c.isspace())):
            return False  # Python's sigma depends on what follows
        for around in (f"a{c}a", f"{c}{c}", f".{c}."):
            low = self.tokenizer.normalizer.normalize_str(around)
            if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(low)) != len(self.word.findall(around.lower())):
                return False
        return True

    def _words(self, text: str) -> list[str]:
        letters = "" if text.isascii() and not re.search(r"[\x0b\x0c\x1c-\x1f]", text) else set(text)
        for c in letters:
            if c not in self.plain:
                self.plain[c] = self._as_python(c)
        if all(map(self.plain.__getitem__, letters)) and unicodedata.is_normalized("NFC", text):
            return self.word.findall(text.lower())
        byte = byte_letters()
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return [bytes(map(byte.__getitem__, piece)).decode() for piece, _ in found]

    def _lookup(self, words: list[str]) -> bytes:
        found = list(map(self.known.get, words))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    word = words[k]
                    ids = self.known.get(word)
                    if ids is None:
                        ids = self.known.find(word)
                    if ids is None:
                        ids = np.array(self.merges.encode(word), self.kind).tobytes()
                        if len(word) <= LONGEST:
                            self.known.put(word, ids)
                    found[k] = ids
        return b"".join(found)

    def encode(self, text: str) -> np.ndarray:
        out = []
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                out.append(np.array([self.added[part]], self.kind).tobytes())
                continue
            at = 0
            while at < len(part):
                white = _WHITE.search(part, at + CHUNK)
                end = white.start() if white else len(part)
                out.append(self._lookup(self._words(part[at:end])))
                at = end
        return np.frombuffer(b"".join(out), self.kind)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings with a blank between two, as the library gives for a file without decoder, in UTF-8."""
        out = []
        for k in range(0, len(ids), JOINED):
            some = ids[k : k + JOINED].astype(np.int64)
            size = self.offsets[some + 1] - self.offsets[some]
            done = np.cumsum(size)
            out.append(self.letters[np.repeat(self.offsets[some] - (done - size), size) + np.arange(done[-1])].tobytes())
        return b"".join(out)[:-1]


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """This worker's tables of a tokenizer file."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _replaced(rows: DataFrame, column: str, into: str, kind, work) -> DataFrame:
    """The rows with one column replaced by another that `work` makes of its Arrow array."""
    arrow_rows(rows.sparkSession)
    rest = [c for c in rows.columns if c != column]
    if into in rest:
        raise ValueError(f"the rows have a column {into} already")
    plain = rows.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)), F.col(f"`{column}`").alias("value"))

    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], work(batch.columns[-1])], names=names)

    return plain.mapInArrow(run, StructType([*plain.schema.fields[:-1], StructField("value", kind)])).toDF(*rest, into)


def encode(rows: DataFrame, text_col: str = "text", path: str | None = None, into: str = "ids") -> DataFrame:
    """The rows with their text replaced by its ids; a null or empty text has an empty array."""
    path = path or default_path()

    def work(texts: pa.Array) -> pa.Array:
        ids = [coder(path).encode(t.as_py() or "") for t in texts]
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.uint16)]).astype(np.int32)))

    return _replaced(rows, text_col, into, ArrayType(IntegerType()), work)


def decode(rows: DataFrame, ids_col: str = "ids", path: str | None = None, into: str = "decoded") -> DataFrame:
    """The rows with their ids replaced by the text that they stand for; null ids have a null text.

    Ids that the vocabulary lacks end the job, and so does a null among the ids.
    """
    path = path or default_path()

    def work(ids: pa.ListArray) -> pa.Array:
        values = ids.values.to_numpy(zero_copy_only=False)
        at = ids.offsets.to_numpy()
        if ids.values.null_count:
            raise ValueError("an id is null")
        texts = [None if not ok else coder(path).decode(values[a:b]) for a, b, ok in zip(at[:-1], at[1:], ids.is_valid().to_pylist(), strict=True)]
        return pa.array(texts, pa.binary()).cast(pa.string())

    return _replaced(rows, ids_col, into, StringType(), work)


def encoded_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document its number of ids, and SHA-256 of the decimal ids and of the text that they decode to.

    Rows with the same id are each a row of their own; other columns of the documents are not read.
    """
    ids = encode(docs.select("doc_id", "text"), path=path)
    kept = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), "ids")
    return decode(kept, path=path).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")
