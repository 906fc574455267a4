"""Backtracking encoder and alignment against the libraries and against plain loops."""

import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import align, bpe, queries
from tests.llm.helpers import corpus, documents

PATH = bpe.default_path()
LIBRARY, CODER = Tokenizer.from_file(PATH), bpe.Coder(PATH)
ODD = ["", "  ", "a" * 3000, "ab" * 700, "ΑΣ ΣΑΣ σς", "İstanbul ISPARTA", "éa ́ ẛ̣", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "a\x1cb\x0bc\x85d e​f﻿g", "它是 中文 1２③ ⅷ", "don't DON'T it's 're", "👩‍👩‍👧 ok😀😀", "ﬁ ǅ ß ẞ", "x\x00y", "__init__ a_b --- ...!?", "١٢ ६"]
MIXED = st.text(alphabet="aeinostrhTHE'sd.,!?0123 \n\t_éÑñçΣσİıſ́K中<|>", max_size=80)


def expected(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_encodes_and_decodes_as_the_library(text):
    ids = CODER.encode(text)
    assert (ids.tolist(), CODER.decode(ids).decode()) == expected(text)


@given(st.one_of(MIXED, st.text(max_size=40)))
@settings(max_examples=400, deadline=None)
def test_any_text_encodes_as_the_library(text):
    assert CODER.encode(text).tolist() == expected(text)[0]


def test_chunks_of_a_text_join_to_its_ids(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 7)
    monkeypatch.setattr(bpe, "JOINED", 5)
    text = "The Quick brown foxes; don't jump over É1 lazy dogs " * 3
    ids = CODER.encode(text)
    assert (ids.tolist(), CODER.decode(ids).decode()) == expected(text)


def merged(word, ranks):
    """All merges in order, the leftmost first."""
    while True:
        found = min(((ranks[pair], k) for k, pair in enumerate(zip(word, word[1:])) if pair in ranks), default=None)
        if found is None:
            return word
        k = found[1]
        word = word[:k] + [word[k] + word[k + 1]] + word[k + 2 :]


@given(st.lists(st.tuples(st.integers(0, 99), st.integers(0, 99)), max_size=12), st.lists(st.text(alphabet="abc", min_size=1, max_size=24), min_size=1, max_size=20))
@settings(max_examples=300, deadline=None)
def test_any_merges_give_what_merging_in_order_gives(picks, words):
    """Small random vocabularies: runs of one letter, merges that overlap, tokens that later merges use."""
    tokens, merges = ["a", "b", "c"], []
    for x, y in picks:
        pair = (tokens[x % len(tokens)], tokens[y % len(tokens)])
        ranks = {m: k for k, m in enumerate(merges)}
        if "".join(pair) in tokens or merged(list("".join(pair)), ranks) != list(pair):
            continue  # such a token is never made, so no trained vocabulary has it
        merges.append(pair)
        tokens.append("".join(pair))
    ranks, vocab = {m: k for k, m in enumerate(merges)}, {t: k for k, t in enumerate(tokens)}
    machine = bpe.Merges(vocab, [list(m) for m in merges])
    for word in words:
        assert machine.encode(word) == [vocab[t] for t in merged(list(word), ranks)]


def test_two_ways_to_one_token_are_refused():
    with pytest.raises(ValueError, match="two ways"):
        bpe.Merges({"a": 0, "aa": 1, "aaa": 2}, [["a", "a"], ["aa", "a"], ["a", "aa"]])


def test_recent_keeps_what_is_met_again():
    kept = bpe.Recent(8)
    for k in range(100):
        if kept.get("x") is None and kept.find("x") is None:
            kept.put("x", 1)
        kept.put(k, k)
        assert len(kept) + len(kept.old) <= 8
    assert kept.get("x") == 1 or kept.find("x") == 1


def test_digests_equal_the_librarys(spark):
    rows = corpus() + [(1000 + k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (3, "same id"), (3, "same id")]
    docs = documents(spark, rows, extra=True).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x")).repartition(3)
    got = sorted(map(repr, bpe.encoded_digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text in rows:
        ids, decoded = expected(text or "")
        want.append(repr(bpe_row(i, len(ids), sha(" ".join(map(str, ids))), sha(decoded))))
    assert got == sorted(want)


def bpe_row(*values):
    from pyspark.sql import Row

    return Row("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")(*values)


def test_real_ids_and_texts_come_out(spark):
    docs = spark.createDataFrame([(1, "Hello, world", "x"), (2, None, "y")], "doc_id long, text string, `a.b` string")
    ids = bpe.encode(docs)
    assert ids.columns == ["doc_id", "a.b", "ids"]
    assert [r.ids for r in ids.orderBy("doc_id").collect()] == [expected("Hello, world")[0], []]
    assert [r.decoded for r in bpe.decode(ids).orderBy("doc_id").collect()] == ["hello</w> ,</w> world</w>", ""]
    assert bpe.encoded_digests(docs.where("false")).count() == 0
    with pytest.raises(ValueError, match="already"):
        bpe.encode(docs.withColumn("ids", F.lit(1)))


A_PATH, B_PATH = align.default_paths()


def plain_alignment(texts):
    """Groups, links and counts by loops over all pairs of tokens of a text."""
    a_lib, b_lib = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_lib.encode_special_tokens = True
    byte = bpe.byte_letters()
    out, counts = [], Counter()
    for text in texts:
        groups, links, a, b = [], [], [], []
        if text:
            a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
            tokens_a = [bytes(byte[c] for c in a_lib.id_to_token(k)) for k in a]
            pieces = [b_lib.id_to_piece(k) for k in b]
            tokens_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
            if b"".join(tokens_a) != (" " + text).encode() or b"".join(tokens_b) != (" " + text).encode():
                a, b = [], []
        if a:
            spans = []
            for tokens in (tokens_a, tokens_b):
                at, here = 0, []
                for t in tokens:
                    here.append((at, at + len(t)))
                    at += len(t)
                spans.append(here)
            links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
            at = 0
            for cut in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
                own = [[k for k, (s, e) in zip(ids, side) if at <= s and e <= cut] for ids, side in zip((a, b), spans)]
                groups.append("|".join(",".join(map(str, x)) for x in own))
                at = cut
        counts.update(links)
        out.append((a, b, groups, links))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(len(a), len(b), len(g), len(k), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for a, b, g, k in out]


def test_alignment_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(align, "CHUNK_BYTES", 2000)
    texts = [t if t is None or len(t) < 3000 else t[:3000] for _, t in corpus()][-40:]
    texts += [t for t in ODD if len(t) < 500] + ["ＡＢ full width", "tab\tand blank", "<s> </s> <unk> <0x41> <|endoftext|>", "  two  blanks ", "▁ mark", "the the the of the", "漢字🙂é" * 40]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)] + [(5, "twice"), (5, "twice")]
    docs = documents(spark, rows, extra=True).withColumn("chunk", F.lit("x")).withColumn("row", F.lit("y")).repartition(3)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted(repr(tuple(r)) for r in align.alignment_digests(docs).select(columns).collect())
    assert got == sorted(repr((i, *w)) for (i, _), w in zip(rows, plain_alignment([t for _, t in rows]), strict=True))


def test_alignment_of_no_documents(spark):
    assert align.alignment_digests(documents(spark, []).where("false")).count() == 0


def test_groups_and_links_of_a_text(spark):
    docs = documents(spark, [(1, "tokenizers align")])
    aligned = align.align(align.token_ends(docs))
    row, pairs = aligned.select("*", align.groups().alias("groups")).first(), [r.pair for r in align.links(aligned).collect()]
    a = [k for g in row.groups for k in g.a]
    assert a == Tokenizer.from_file(A_PATH).encode(" tokenizers align", add_special_tokens=False).ids
    assert {k >> 32 for k in pairs} == set(a) and row.n_a == len(a) and len(pairs) == len(row.ends)


def test_sessions_settings_come_back(spark):
    keys = ["spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.maxConcurrentOutputFileWriters"]
    before = [spark.conf.get(k) for k in keys]
    queries.QUERIES["op13_alignment"](spark, "/root/testdata/sf0.001")
    assert [spark.conf.get(k) for k in keys] == before and not [t for t in spark.catalog.listTables() if t.name.startswith("token_links")]


def test_a_word_is_aligned_once_a_chunk(spark, monkeypatch):
    """Work on tokens follows the distinct words of a chunk; texts that can't be cut are a word each."""
    text = "some words, some more\n\twords\r\nand a rest "
    docs = documents(spark, [(k, text) for k in range(30)] + [(30, "no\xa0cut here"), (31, "Ａ wide")]).coalesce(1)
    rows = align.token_words(docs).collect()
    runs, texts = [r for r in rows if r.words is None], [r for r in rows if r.words is not None]
    # " some" is in it twice, "\n\twords\r\nand" is one word; the uncut text is one, the last has two
    assert len(runs) == 1 and sorted(runs[0].ns) == [1] * 3 + [30] * 7 + [60] and runs[0].a.count(-1) == runs[0].b.count(-1) == len(runs[0].ns)
    assert [len(r.words) for r in sorted(texts, key=lambda r: r.doc_id)] == [9] * 30 + [1, 2]
    got = {r.doc_id: tuple(r)[1:] for r in align.alignment_digests(docs).collect()}
    assert [got[k] for k in range(32)] == plain_alignment([text] * 30 + ["no\xa0cut here", "Ａ wide"])
