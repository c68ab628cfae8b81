"""Forced-boundary BPE against the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quantloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = st.text(st.sampled_from("aAbB's'tΣσς İıßéÉ̀ñ漢字かな😀👍🏽12३٣½ \t\r\n\x0b\x1c\x85\xa0‍.,!?#<|endoftext|>\x00\x7fÅÅﬁ"), max_size=60)


@pytest.fixture(scope="module")
def both():
    return Tokenizer.from_file(PATH), bpe.WordBpe(PATH, limit=500)


def agree(both, text):
    library, ours = both
    ids = library.encode(text, add_special_tokens=False).ids
    raw = ours.encode(text)
    assert np.frombuffer(raw, "<u4").tolist() == ids
    assert ours.decode(raw) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(ODD | st.text(max_size=80))
def test_any_text(both, text):
    agree(both, text)


@pytest.mark.parametrize("text", ["", " ", "x" * 5000, "ab" * 3000, "é" * 2000, "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "don't we've I'LL"])
def test_given_texts(both, text):
    agree(both, text)


def test_cuts_are_certain(both):
    ours = both[1]
    parts = ours.cuts("thequickzxqj")
    assert "".join(parts) == "thequickzxqj" and all(a[-1] + b[0] not in ours.joinable for a, b in zip(parts, parts[1:], strict=False))
    assert any(len(ours.cuts("".join(w))) > 1 for w in ("zxqj", "qzvx", "jqxz"))


def test_latin_path_equals_the_library(both):
    for text in ("".join(map(chr, range(1, 256))), "ÀÉÎÕÜ÷×ßÞªµº ²³¹¼½¾ ­\xa0x", "\x85a\x1cb"):
        agree(both, text)


def test_rows(spark):
    rows = [(1, "The cat"), (1, "The cat"), (2, None), (None, ""), (3, "word " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as n_tokens")
    got = {r.doc_id: r for r in bpe.encode_decode(docs, PATH).collect()}
    assert got[2].n_tokens == 0 and got[2].decoded == "" and got[3].n_tokens == 200_000 and got[1].decoded == "the</w> cat</w>"
    digests = {r.doc_id: r for r in bpe.encode_decode(docs, PATH, digests=True).collect()}
    assert digests[1].ids_sha256 == hashlib.sha256(np.array(got[1].ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode_decode(docs.limit(0), PATH).collect() == []


def test_long_words_take_linear_time(both):
    import time

    def seconds(n):
        text = "".join(chr(0x4E00 + k * 7919 % 20000) for k in range(n))
        at = time.perf_counter()
        agree(both, text) if n < 50_000 else both[1].encode(text)
        return time.perf_counter() - at

    seconds(2_000)
    assert seconds(80_000) < 40 * max(seconds(5_000), 0.02)
    assert all(len(k) <= 64 for t in (both[1].inner, both[1].ends, both[1].words, both[1].chunks) for k in t)


def test_whole_table_equals_the_library(spark):
    import duckdb

    library = Tokenizer.from_file(PATH)
    want = set()
    for doc, text in duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.add((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert {tuple(r) for r in bpe.op4_bpe(spark, "/root/testdata/sf0.001").collect()} == want
