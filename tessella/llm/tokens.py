"""Token ids of whole texts, as Spark stages.

Byte-level BPE works inside the matches of its splitting pattern, and a match
never reaches over the end of a word that white space follows, nor from a letter
to punctuation after it. So the ids of a text are the ids of its pieces, cut at
those places, one after another. Pieces are found and told apart with numpy, by a
hash and then by their bytes; each distinct one is encoded by the tokenizer once a
worker and then looked up by its bytes; those not met lately are encoded many in one
text and told apart again by the lengths of their tokens. Texts
with other white space than blank, tab and line ends, or with the string of an
added token, are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessella.llm.common import KEEP, arrow_rows, blocks, same_spans, slices, span_hashes

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 13, 32]] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[33:127] = True
PUNCTUATION &= ~LETTER
PUNCTUATION[48:58] = False
#: White space by any definition, in UTF-8, other than the four characters above.
RARE = {0xC2: rb"[\x85\xa0]", 0xE1: rb"\x9a\x80|\xa0\x8e", 0xE2: rb"\x80[\x80-\x8b\xa8\xa9\xaf]|\x81\x9f", 0xE3: rb"\x80\x80", 0xEF: rb"\xbb\xbf"} | dict.fromkeys(b"\x0b\x0c\x1c\x1d\x1e\x1f", b"")
#: Pieces that a worker keeps: about 50 MB. Those of the last KEPT / 2 new or old ones met stay known.
KEPT = 250_000
#: Bytes of a piece; longer ones are encoded each time.
LONGEST = 200
#: Pieces encoded in one text.
JOINED = 256
#: Slots, of 16 bytes each, of a worker's table of counts, and the bytes of a piece that fit in one.
SLOTS, SHORT = 1 << 21, 15


def finder(strings: list[bytes]) -> re.Pattern:
    """Finds rare white space and the strings. It begins with a set of bytes, which is searched for much faster than alternatives are tried at each."""
    rests = [(head, rest) for head, rest in RARE.items()] + [(t[0], re.escape(t[1:])) for t in strings]
    byte = lambda b: b"\\x%02x" % b
    return re.compile(b"[" + b"".join(byte(b) for b, _ in rests) + b"](?:" + b"|".join(b"(?<=" + byte(b) + b")(?:" + rest + b")" for b, rest in rests) + b")")


class Counts:
    """How many ids short pieces have. A slot holds the bytes of its piece, its size and the count, so no piece is taken for another; the piece met last has the slot."""

    def __init__(self, slots: int = SLOTS) -> None:
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.shift = np.uint64(64 - (slots.bit_length() - 1))

    def find(self, flat: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Each piece's count, 0 where it is not known, and what `put` needs. Pieces are of 1 to SHORT bytes."""
        at = blocks(flat)
        low = at[starts]
        low &= KEEP.take(size, mode="clip")
        high = size.astype(np.uint64) << np.uint64(60)
        long = np.flatnonzero(size > 8)
        high[long] |= at[starts[long] + 8] & KEEP[size[long] - 8]
        slot = high * np.uint64(0x9FB21C651E98DF25)
        slot ^= low
        slot ^= slot >> np.uint64(32)
        slot *= np.uint64(0xBF58476D1CE4E5B9)
        slot ^= slot >> np.uint64(29)
        slot *= np.uint64(0x94D049BB133111EB)
        slot >>= self.shift
        slot = slot.view(np.int64)
        held = self.high.take(slot)
        count = (held >> np.uint64(56)) & np.uint64(15)
        held &= np.uint64(0xF0FFFFFFFFFFFFFF)
        same = held == high
        same &= self.low.take(slot) == low
        count *= same
        return count.view(np.int64), (slot, low, high)

    def put(self, slot: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> None:
        fits = np.flatnonzero((count > 0) & (count < 16))
        _, last = np.unique(slot[fits][::-1], return_index=True)
        fits = fits[len(fits) - 1 - last]  # one piece a slot
        self.low[slot[fits]] = low[fits]
        self.high[slot[fits]] = high[fits] | (count[fits].astype(np.uint64) << np.uint64(56))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts, equal to the tokenizer's own for each whole text without special tokens added."""

    #: White space that begins a piece where none stands before it.
    opens = WHITE

    def __init__(self, path: str, kept: int = KEPT) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.counted: Counts | None = None
        self.traits = bytes(int(WHITE[b]) + 2 * int(self.opens[b]) + 4 * int(LETTER[b]) + 8 * int(PUNCTUATION[b]) for b in range(256))
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        head = self.tokenizer.to_str().partition('"model"')[0]
        self.whole = finder([t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()])
        self.by_piece = '"ByteLevel"' in head and re.search(r'"normalizer":\s*null', head) is not None
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocab.values(), default=-1) + 1, np.int64)  # a byte-level token has a letter a byte
        self.sizes[list(vocab.values())] = list(map(len, vocab))

    def _encode(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.kind.itemsize == 2 else "I"
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, keys: list[bytes]) -> list:
        """The ids of pieces. Those that begin with white space and end without meet as in a text, so many are encoded at once."""
        out: list[bytes] = [b""] * len(keys)
        joined = [k for k, key in enumerate(keys) if len(key) <= LONGEST and WHITE[key[0]] and not WHITE[key[-1]]]
        if self.whole.search(b"".join([keys[k] for k in joined])):
            joined = []
        runs = [joined[i : i + JOINED] for i in range(0, len(joined), JOINED)]
        found = self.tokenizer.encode_batch_fast([b"".join([keys[k] for k in run]).decode() for run in runs], add_special_tokens=False)
        alone = set(range(len(keys))).difference(joined)
        for run, encoded in zip(runs, found, strict=True):
            ids = np.array(encoded.ids, self.kind)
            size, ends = np.cumsum(self.sizes[ids]), np.cumsum([len(keys[k]) for k in run])
            at = np.searchsorted(size, ends)
            if at[-1] + 1 != len(ids) or not np.array_equal(size[at], ends):
                alone.update(run)
                continue
            raw, bounds = ids.tobytes(), [0, *((at + 1) * self.kind.itemsize).tolist()]
            for k, i, j in zip(run, bounds, bounds[1:]):
                out[k] = raw[i:j]
        rest = sorted(alone)
        for k, ids in zip(rest, self._encode([keys[k].decode() for k in rest]), strict=True):
            out[k] = ids
        return out

    def _cuts(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces."""
        traits = np.frombuffer(flat.tobytes().translate(self.traits), np.uint8)
        begins = np.zeros(len(flat) + 1, dtype=bool)
        # white space that opens, after other; or punctuation after a letter
        begins[1:-1] = ((traits[1:] & ~(traits[:-1] << 1) & 2) | (traits[1:] & (traits[:-1] << 1) & 8)) != 0
        begins[at] = True
        starts = np.flatnonzero(begins[:-1])
        return starts, np.append(starts[1:], len(flat))

    def _pieces(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list, np.ndarray] | None:
        """Each piece's kind, the ids of the kinds, and each text's first piece; None where hashes can't tell two pieces apart."""
        starts, ends = self._cuts(flat, at)
        codes, names = pd.factorize(span_hashes(flat, starts, ends))
        first = np.empty(len(names), dtype=np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        if not same_spans(flat, starts, ends, first[codes]):
            return None  # unlike pieces with equal hashes
        text = flat.tobytes()
        keys = [text[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        return codes, self._found(keys), np.searchsorted(starts, at)

    def _found(self, keys: list[bytes]) -> list:
        """The ids of distinct pieces, by what is known of them."""
        found = list(map(self.known.get, keys))
        missed = [k for k, ids in enumerate(found) if ids is None]
        for k in missed:
            found[k] = self.before.get(keys[k])
        new = [k for k in missed if found[k] is None]
        for k, ids in zip(new, self._encode_pieces([keys[k] for k in new]), strict=True):
            found[k] = ids
        for k in missed:
            if len(keys[k]) > LONGEST:
                continue
            if len(self.known) >= self.kept // 2:
                self.known, self.before = {}, self.known
            self.known[keys[k]] = found[k]
        return found

    def _whole(self, flat: np.ndarray, at: np.ndarray, done: bool) -> list[tuple[int, np.ndarray]]:
        """Number and ids of the texts that are encoded whole: all, unless the others are done."""
        text = flat.tobytes()
        rows = sorted({int(np.searchsorted(at, m.start(), side="right")) - 1 for m in self.whole.finditer(text)}) if done else range(len(at) - 1)
        return [(k, np.frombuffer(self._encode([text[at[k] : at[k + 1]].decode()])[0], self.kind)) for k in rows]

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        """An array of ids for each text of a string column; a null has those of an empty text."""
        for _, flat, at in slices(column):
            pieces = self._pieces(flat, at) if self.by_piece and len(flat) else None
            out = [np.zeros(0, self.kind)] * (len(at) - 1)
            if pieces:
                codes, found, first = pieces
                pool = np.frombuffer(b"".join(found), self.kind)
                lens = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
                begin = np.cumsum(lens) - lens
                count = lens[codes]
                done = np.concatenate([[0], np.cumsum(count)])
                ids = pool[np.repeat(begin[codes] - done[:-1], count) + np.arange(done[-1])]
                row = done[first]
                out = [ids[a:b] for a, b in zip(row[:-1], row[1:], strict=True)]
            for k, ids in self._whole(flat, at, pieces is not None):
                out[k] = ids
            yield from out

    def _sums(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many ids the pieces of each text have."""
        if self.counted is None:
            self.counted = Counts()
        starts, ends = self._cuts(flat, at)
        size, first = ends - starts, np.searchsorted(starts, at)
        lens = np.zeros(len(starts), np.int64)
        short = np.flatnonzero(size <= SHORT)
        lens[short], slots = self.counted.find(flat, starts[short], size[short])
        missed, text = np.flatnonzero(lens == 0), flat.tobytes()
        keys = [text[i:j] for i, j in zip(starts[missed].tolist(), ends[missed].tolist(), strict=True)]
        kinds = dict.fromkeys(keys)
        brief, rest = [k for k in kinds if len(k) <= SHORT], [k for k in kinds if len(k) > SHORT]
        for some, found in ((brief, self._encode_pieces(brief)), (rest, self._found(rest))):
            kinds.update(zip(some, (len(ids) // self.kind.itemsize for ids in found), strict=True))
        lens[missed] = list(map(kinds.__getitem__, keys))
        new = np.flatnonzero(size[missed] <= SHORT)
        where = np.searchsorted(short, missed[new])
        self.counted.put(*(x[where] for x in slots), lens[missed[new]])
        return np.diff(np.concatenate([[0], np.cumsum(lens)])[first])

    def counts(self, column: pa.Array) -> np.ndarray:
        """How many ids each text has. Ids of short pieces are not kept, only their number."""
        parts = [np.zeros(0, np.int64)]
        for _, flat, at in slices(column):
            by_piece = self.by_piece and len(flat) > 0
            out = self._sums(flat, at) if by_piece else np.zeros(len(at) - 1, np.int64)
            for k, ids in self._whole(flat, at, by_piece):
                out[k] = len(ids)
            parts.append(out)
        return np.concatenate(parts)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, kept: int = KEPT) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if (path, kept) not in _encoders:
        _encoders[path, kept] = Encoder(path, kept)
    return _encoders[path, kept]


def token_counts(docs: DataFrame, text_col: str = "text", path: str | None = None, into: str = "n_tokens", kept: int = KEPT) -> DataFrame:
    """The rows with their text replaced by its number of ids (a null text has none); a worker keeps `kept` pieces."""
    path = path or default_path()
    arrow_rows(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    plain = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(text_col).alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lens = encoder(path, kept).counts(batch.columns[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lens, pa.int64())], names=[*rest, into])

    return plain.mapInArrow(work, StructType([*plain.schema.fields[:-1], StructField(into, LongType())]))
