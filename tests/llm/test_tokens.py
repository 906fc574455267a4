import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import common, dac, queries, rollups, tokens
from tests.llm.helpers import corpus, documents

TOKENIZER = Tokenizer.from_file(tokens.default_path())
ODD = ["", "  ", "a\t  b \n\n c  ", "don't we're it's,x 'tis", "\x1c a!\x1cb", "a\u00a0 b\u2003c", "a \t b\r\n", " lead", "<|endoftext|> a x<|endoftext|>y", "!!word?!", None, "é" * 60, "漢字 かな 🙂🙂"]


@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="ab'.,!? \n\t\r\u00a0\u20091é<|>", max_size=60)), min_size=1, max_size=8))
@settings(max_examples=80, deadline=None)
def test_encoder_equals_tokenizer(texts):
    encode = tokens.Encoder.__new__(tokens.Encoder)
    encode.__dict__ = _shared.__dict__
    got = [x.tolist() for x in encode(pa.array(texts, pa.string()))]
    assert got == [TOKENIZER.encode(t or "", add_special_tokens=False).ids for t in texts]


_shared = tokens.Encoder(tokens.default_path(), kept=50)


def test_encoder_on_odd_texts():
    assert [x.tolist() for x in _shared(pa.array(ODD))] == [TOKENIZER.encode(t or "", add_special_tokens=False).ids for t in ODD]


def thue_morse(n):
    word = "ab"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_pieces_met_again_are_not_encoded_again(monkeypatch):
    """A corpus has some 100,000 kinds of pieces; a worker meets them all in one task and again in the next."""
    encode, asked = tokens.Encoder(tokens.default_path(), dac.KEPT_PIECES), []
    plain = encode._encode
    monkeypatch.setattr(encode, "_encode", lambda texts: asked.append(len(texts)) or plain(texts))
    texts = pa.array([" ".join(f"w{i:x}" for i in range(k, k + 1000)) for k in range(0, 200_000, 1000)])
    first = [x.tolist() for x in encode(texts)]
    known = sum(asked)
    assert [x.tolist() for x in encode(texts)] == first and sum(asked) == known


def test_finder_of_rare_white_space():
    plain = re.compile(rb"[\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8b\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80|\xef\xbb\xbf|<\|x>|a|\]\^")
    some, rng = b"\x0b\x1f\xc2\x85\xa0\xe1\x9a\x80\x8e\xe2\xa8\xaf\x81\x9f\xe3\xef\xbb\xbf<|x>a]^ ", random.Random(3)
    text = bytes(rng.choice(some) for _ in range(200_000)) + b"<|x>]^"
    spans = lambda pattern: [m.span() for m in pattern.finditer(text)]
    assert spans(tokens.finder([b"<|x>", b"a", b"]^"])) == spans(plain) != []


def test_unlike_words_are_told_apart():
    """A word and its complement have equal polynomial hashes modulo 2**64, whatever the base."""
    a = thue_morse(1024)
    pair = ["z " + a, "z " + a.translate(str.maketrans("ab", "ba")), "z " + a[:40], "z " + a[:41]]
    encode = tokens.Encoder(tokens.default_path())
    assert [x.tolist() for x in encode(pa.array(pair))] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in pair]
    (_, flat, at), = common.slices(pa.array(pair))
    assert len(set(common.word_hashes(flat, at)[0].tolist())) == 5


def test_spans_are_compared_by_bytes(monkeypatch):
    """With a hash that is the same for all, pieces are still encoded right."""
    monkeypatch.setattr(tokens, "span_hashes", lambda flat, starts, ends: np.zeros(len(starts), np.uint64))
    encode = tokens.Encoder(tokens.default_path())
    texts = ["ab cd ef", "ab ab", "x" * 100, ""]
    assert [x.tolist() for x in encode(pa.array(texts))] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 3000])
@pytest.mark.parametrize("widths", [(9, 7), (8,), (3, 2), (31,)])
def test_segment_round_trip(n, widths):
    ids = np.random.default_rng(n).geometric(0.002, n).astype(np.uint32)
    ids[::11] = np.random.default_rng(1).integers(0, 1 << 32, len(ids[::11]), dtype=np.uint64).astype(np.uint32)
    segment = dac.Segment(dac.encode(ids, widths))
    assert (segment.all() == ids).all() and [segment[i] for i in range(n)] == ids.tolist()
    with pytest.raises(IndexError):
        segment[n]


def test_token_files(spark, tmp_path):
    rows = corpus()[::-1]
    path = f"file://{tmp_path}/tokens"
    dac.write_token_files(documents(spark, rows, extra=True), path, segment_ids=5000)
    got = {r["doc_id"]: r for r in dac.read_digests(spark, path).collect()}
    stream = []
    for doc, text, *_ in sorted(rows):
        ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (len(stream), len(ids), zlib.crc32(ids.tobytes()))
        stream += ids.tolist()
    at = [0, 1, 4999, 5000, len(stream) - 1, 777, 777]
    found = dac.read_tokens(spark.createDataFrame([(p,) for p in [*at, len(stream), -1]], "position long"), path).collect()
    assert sorted((r["position"], r["token_id"]) for r in found if r["token_id"] is not None) == sorted((p, stream[p]) for p in at)
    assert sorted(r["position"] for r in found if r["token_id"] is None) == [-1, len(stream)]


def test_token_files_of_nothing_and_nulls(spark):
    assert dac.token_digests(documents(spark, [(1, "a")]).where("false")).collect() == []
    got = dac.token_digests(documents(spark, [(3, "b"), (None, "a"), (3, "a")])).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(None, 0, 2), (3, 2, 2), (3, 4, 2)]


def test_ledger_is_idempotent_and_additive(spark, tmp_path):
    docs = documents(spark, [(i, "a b " * i, f"s{i % 2}") for i in range(1, 9)] + [(20, None, None)], extra=True)
    counts = rollups.document_counts(docs, "v1")
    ledger = rollups.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().collect() == []
    assert ledger.commit("one", rollups.inserts(counts)) and not ledger.commit("one", rollups.inserts(counts))
    expect = {}
    for r in counts.collect():
        e = expect.setdefault((r["source"], r["lang"], "v1"), [0, 0, 0])
        e[0], e[1], e[2] = e[0] + 1, e[1] + r["n_tokens"], e[2] + r["n_chars"]
    read = lambda: {(r["source"], r["lang"], r["tokenizer_version"]): [r["docs"], r["tokens"], r["chars"]] for r in ledger.totals().collect()}
    assert read() == expect
    changes = spark.createDataFrame(
        [("revise", "s0", "en", "v1", 100, 5, 40, 4), ("delete", "s1", "en", "v1", None, None, 2, 3), ("delete", None, "en", "v1", None, None, 0, 0), ("insert", "s9", "de", "v2", 7, 9, None, None)],
        "op string, source string, lang string, tokenizer_version string, n_tokens long, n_chars long, old_tokens long, old_chars long",
    )
    ledger.commit("two", changes)
    expect["s0", "en", "v1"] = [expect["s0", "en", "v1"][0], expect["s0", "en", "v1"][1] + 60, expect["s0", "en", "v1"][2] + 1]
    expect["s1", "en", "v1"] = [expect["s1", "en", "v1"][0] - 1, expect["s1", "en", "v1"][1] - 2, expect["s1", "en", "v1"][2] - 3]
    expect["s9", "de", "v2"] = [1, 7, 9]
    del expect[None, "en", "v1"]
    assert read() == expect
    # maintained totals, and batches that come after them
    ledger.maintain()
    assert read() == expect and ledger._state()[0] == ["totals=000000000000"]
    ledger.maintain()
    ledger.commit("three", rollups.deletes(counts))
    assert ledger._state()[0] == ["totals=000000000000", "batch=three"]
    late = read()
    ledger.maintain()
    assert read() == late and ("s9", "de", "v2") in late and ledger._names("totals") == ["000000000000", "000000000001"]
    # an id names its content, and of two writers the first one counts
    with pytest.raises(ValueError):
        ledger.commit("two", changes.limit(1), verify=True)
    assert not ledger.commit("two", changes, verify=True) and not ledger._publish(rollups.deltas(changes), "batch=two")
    # a write that was cut off is not read
    (tmp_path / "ledger" / "batch=cut").mkdir()
    assert not ledger.committed("cut") and read() == late
    with pytest.raises(Exception, match="unknown op"):
        rollups.deltas(changes.replace("insert", "upsert", subset=["op"])).collect()


def test_query_of_counts_equals_plain_sums(spark):
    got = {(r["source"], r["lang"]): (r["docs"], r["tokens"], r["chars"]) for r in queries.op4_token_counts(spark, "/root/testdata/sf0.001").collect()}
    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        n, t, c = want.get((r["source"], r["lang"]), (0, 0, 0))
        want[r["source"], r["lang"]] = n + 1, t + len(TOKENIZER.encode(r["text"] or "", add_special_tokens=False).ids), c + len(r["text"] or "")
    assert got == want


def _ledger(spark, path):
    rows = lambda k: spark.createDataFrame([(k, "s", "en", "v", 5, 10)], "doc_id long, source string, lang string, tokenizer_version string, n_tokens long, n_chars long")
    return rollups.Ledger(spark, f"file://{path}/ledger"), lambda k: rollups.inserts(rows(k))


def test_a_batch_committed_during_maintenance_is_not_lost(spark, tmp_path):
    ledger, batch = _ledger(spark, tmp_path)
    ledger.commit("a", batch(1))
    publish = ledger._publish

    def late(rows, name):
        if name.startswith("held="):
            ledger._publish = publish
            ledger.commit("b", batch(2))
        return publish(rows, name)

    ledger._publish = late
    ledger.maintain()
    assert ledger.totals().first().docs == 2
    ledger.maintain()
    assert ledger.totals().first().docs == 2 and ledger._state()[0] == ["totals=000000000001"]


def test_maintenance_goes_on_after_a_lost_driver(spark, tmp_path):
    ledger, batch = _ledger(spark, tmp_path)
    ledger.commit("a", batch(1))
    publish = ledger._publish
    ledger._publish = lambda rows, name: publish(rows, name) if name.startswith("held=") else 1 / 0
    try:
        ledger.maintain()
    except ZeroDivisionError:
        pass
    ledger._publish = publish
    assert ledger.totals().first().docs == 1 and not ledger._names("totals")
    ledger.commit("b", batch(2))
    ledger.maintain()
    assert ledger.totals().first().docs == 2 and ledger._state()[0] == ["totals=000000000001"]


def test_pieces_met_first_are_encoded_together():
    import pyarrow as pa

    from tessella.llm import tokens

    coder, sent = tokens.Encoder(tokens.default_path()), []
    library = coder.tokenizer

    class Spy:
        def encode_batch_fast(self, texts, **how):
            sent.extend(texts)
            return library.encode_batch_fast(texts, **how)

    coder.tokenizer = Spy()
    texts = ["one two three, four\n\nfive  six ", "seven eight", None, "a\xa0b nine\x0bten eleven", ""]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in coder(pa.array(texts))] == want
    assert coder.counts(pa.array(texts)).tolist() == list(map(len, want))
    sent.clear()
    assert [len(x) for x in coder(pa.array([" ".join(f"word{k}" for k in range(500))]))] == [len(library.encode(" ".join(f"word{k}" for k in range(500)), add_special_tokens=False).ids)]
    assert len(sent) < 5


def test_counts_of_many_kinds_of_pieces_are_kept(monkeypatch):
    """More kinds than a worker keeps the ids of: their counts are still there when they are met again."""
    coder, asked = tokens.Encoder(tokens.default_path()), []
    plain = coder._encode_pieces
    monkeypatch.setattr(coder, "_encode_pieces", lambda keys: asked.append(len(keys)) or plain(keys))
    texts = pa.array([" ".join(f"w{i:x}" for i in range(k, k + 1000)) for k in range(0, 300_000, 1000)])
    first, new = coder.counts(texts), sum(asked)
    assert (coder.counts(texts) == first).all() and new > 250_000 and sum(asked) - new < new // 4
    assert first[:3].tolist() == [len(TOKENIZER.encode(t, add_special_tokens=False).ids) for t in texts[:3].to_pylist()]


@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="ab'., \n\x00\u00a0é<|>", max_size=60)), min_size=1, max_size=8))
@settings(max_examples=80, deadline=None)
def test_counts_of_pieces_that_share_slots(texts):
    coder = tokens.Encoder.__new__(tokens.Encoder)
    coder.__dict__ = _shared.__dict__ | {"counted": _few}
    for _ in range(2):
        assert coder.counts(pa.array(texts, pa.string())).tolist() == [len(TOKENIZER.encode(t or "", add_special_tokens=False).ids) for t in texts]


_few = tokens.Counts(4)
