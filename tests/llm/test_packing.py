"""Packing: every piece once, gapless sequences, few of them."""

import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quantloom.llm import packing


def check(rows, capacity):
    """Sequences are gapless from 0 and within capacity; their number."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_best_fit_places_everything():
    sizes = np.sort(np.random.default_rng(2).integers(1, 101, 5000))[::-1]
    bins, offsets = packing.best_fit(sizes, 100)
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= 100 and len(bins) == 5000 and len(fill) <= np.ceil(sizes.sum() / 100) * 1.02
    assert packing.best_fit(np.zeros(0, np.int64))[0].size == 0


def test_matches_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {1: "Hello world, again.", 2: None, 3: "", 4: "tokens and more of them " * 2000, 5: "a<|endoftext|>b", 6: "é漢😀\n\n  x"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "5 as offset", "'q' as bin")
    rows = packing.pack_documents(docs, packing.default_tokens()).collect()
    check(rows, 2048)
    for doc, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert all(r.length == 2048 for r in mine[1:])
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_rounds_merge_underfull_bins(spark):
    rnd = np.random.default_rng(4)
    sizes = [(k, int(x)) for k, x in enumerate(rnd.integers(1, 1200, 6000))]
    pieces = spark.createDataFrame(sizes, "doc_id long, length long").repartition(40)
    rows = packing.pack(pieces, block=400).collect()
    assert len(rows) == 6000
    assert check(rows, 2048) <= np.ceil(sum(x for _, x in sizes) / 2048) * 1.03


def test_large_items_never_share(spark):
    pieces = spark.createDataFrame([(k, 1500) for k in range(500)], "doc_id long, length long").repartition(7)
    assert check(packing.pack(pieces, block=50).collect(), 2048) == 500


def test_repeats_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (None, "x"), (None, None)], "doc_id long, text string")
    rows = packing.pack_documents(docs, packing.default_tokens()).collect()
    assert len(rows) == 4 and check(rows, 2048) == 1
    assert packing.pack_documents(docs.limit(0), packing.default_tokens()).collect() == []


def test_pieces_carry_ids(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    row = packing.token_pieces(docs, packing.default_tokens(), with_ids=True).first()
    assert row.ids[-1] == 0 and len(row.ids) == row.length


LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODE = packing.byte_encoder(packing.default_tokens(), limit=500)
ODD = st.text(st.sampled_from("aAbB's'tΣσς İıßéÉ̀ñ漢字かな😀👍🏽12३٣½ \t\r\n\x0b\x1c\x85\xa0‍.,!?#<|endoftext|>\x00\x7fÅÅﬁ"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(ODD | st.text(max_size=80))
def test_any_text(text):
    assert ENCODE(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "\n" * 1_000_000, "ab" * 500_000, "é" * 200_000, "漢" * 100_000], ids=["spaces", "feeds", "letters", "accents", "han"])
def test_very_long_runs(text):
    assert ENCODE(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_settled_characters_have_the_classes_of_the_library():
    """A character joins a letter, a number or a mark before it just if the split says so."""
    settled = [chr(i) for i in range(0x10000) if not 0xD800 <= i <= 0xDFFF and regex.fullmatch(packing.SETTLED, chr(i))]
    assert len(settled) > 30_000
    for before in "a1!":
        text = "".join(f" {before}{c} {before}" for c in settled)
        assert [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)] == regex.findall(packing.SPLIT, text)
        text = "".join(f" {before}{chr(c)} {before}{chr(c)}{chr(c)}  " for c in range(128))
        assert re.findall(packing.ASCII_SPLIT, text, re.ASCII) == regex.findall(packing.SPLIT, text)


def test_spelt_out_classes_split_as_the_library_does():
    """The faster pattern for settled texts parts them as SPLIT does, and takes less time for it."""
    settled = [chr(i) for i in range(0x10000) if not 0xD800 <= i <= 0xDFFF and regex.fullmatch(packing.SETTLED, chr(i))]
    fast, plain = packing.settled_split(), regex.compile(packing.SPLIT)
    for before in ("a", "1", "!", "'", " ", "  ", "\n", "é", "漢"):
        text = "".join(f" {before}{c} {before}{c}{c}'s" for c in settled)
        assert fast.findall(text) == plain.findall(text)
    text = "Größe und Maße, déjà vu: 12 ½ naïve façade. " * 20_000
    took = []
    for pattern in (fast, plain):
        began = time.process_time()
        pattern.findall(text)
        took.append(time.process_time() - began)
    assert took[0] < 0.8 * took[1]


def test_whole_table_equals_the_library(spark):
    import duckdb

    rows = packing.op6_packing(spark, "/root/testdata/sf0.001").collect()
    check(rows, 2048)
    want = set()
    for doc, text in duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall():
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        for piece, start in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[start : first if piece == 0 else start + 2048]
            want.add((doc, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want
