"""Media columns: lossless storage and fingerprints that depend on the text alone."""

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm import media


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=3000))
def test_round_trip(text):
    row = media.media_row(text)
    raw = text.encode()
    padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
    assert media.wav_samples(row["media"]) == padded
    assert row["n_bytes"] == len(raw) and row["payload_bytes"] == len(padded) and row["payload_bytes"] % 64 == 0
    assert row["payload_sha256"] == hashlib.sha256(padded).hexdigest() and row["tail_crc32"] == zlib.crc32(padded[-64:])
    assert row["media_bytes"] == len(row["media"]) and row["media_sha256"] == hashlib.sha256(row["media"]).hexdigest()


def test_blocks_do_not_change_peaks():
    samples = np.random.default_rng(1).integers(0, 256, 100_000).astype(np.uint8).tobytes()
    assert (media.spectral_peaks(samples, block=7) == media.spectral_peaks(samples)).all()


def test_pairs_are_coded_in_time():
    tone = (128 + 90 * np.sin(np.arange(40_000) * 2 * np.pi * 50 / 512)).astype(np.uint8).tobytes()
    pairs = media.peak_pairs(media.spectral_peaks(tone))
    assert (np.diff(pairs) >= 0).all()
    peaks = media.spectral_peaks(tone)
    assert (peaks[2:-2, 0] == 50).all()


def test_odd_rows(spark):
    rows = [(1, None, "w"), (1, None, "w"), (None, "abc", "w"), (2, "", "w"), (3, "long " * 300_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = media.media_columns(docs).collect()
    assert len(got) == 5 and {r.payload_bytes for r in got if r.doc_id in (1, 2)} == {64}
    assert media.media_columns(docs.limit(0)).collect() == []
    again = media.media_columns(spark.createDataFrame([(9, "long " * 300_000)], "doc_id long, text string")).first()
    assert again.pairs == next(r for r in got if r.doc_id == 3).pairs
