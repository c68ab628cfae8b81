"""Audio columns: payloads as 8-bit WAV, read by the wave module, and spectral-peak fingerprints.

The bytes of a text become the samples of a mono 8-bit WAV file, which is lossless. Features come
from the bytes that are read back: a short-time Fourier transform, the strongest bins that beat
their neighbours in frequency, and pairs of peaks within a few frames of each other, stored as
an array of time-coded integers (frame, first bin, second bin, distance in frames).

Defined results: a null or empty text is 64 zero bytes; equal texts give equal values; repeated
rows and null doc_ids keep their rows; an empty table gives an empty result; other columns are
ignored. Frames are transformed in blocks, so memory does not grow with frames of a long text.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quantloom.llm.common import arrow_rows, table

UNIT = 64
RATE = 8000


def wav_bytes(payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file whose unsigned 8-bit samples are the payload."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def wav_samples(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not a mono 8-bit file")
        return w.readframes(w.getnframes())


def spectral_peaks(samples: bytes, size: int = 512, hop: int = 256, block: int = 512) -> np.ndarray:
    """The strongest local maximum in each of four bands of each frame: (frames, 4) bins, -1 for none."""
    x = np.frombuffer(samples, np.uint8)
    frames = max(1, 1 + -(-(len(x) - size) // hop))
    window, found = np.hanning(size).astype(np.float32), []
    edges = np.linspace(1, size // 2, 5).astype(int)
    for first in range(0, frames, block):
        n = min(block, frames - first)
        part = x[first * hop : (first + n - 1) * hop + size].astype(np.float32) - 128
        part = np.pad(part, (0, (n - 1) * hop + size - len(part)))
        power = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(part, size)[::hop] * window, axis=1)) ** 2
        best = np.full((n, 4), -1, np.int32)
        for k in range(4):
            band = power[:, edges[k] : edges[k + 1]]
            bins = band.argmax(1) + edges[k]
            rows = np.arange(n)
            top = power[rows, bins]
            peak = (top > power[rows, bins - 1]) & (top >= power[rows, bins + 1]) & (top > 2 * band.mean(1))
            best[peak, k] = bins[peak]
        found.append(best)
    return np.concatenate(found)


def peak_pairs(peaks: np.ndarray, reach: int = 3) -> np.ndarray:
    """Time-coded pairs: frame << 24 | first bin << 13 | second bin << 2 | distance, sorted. Pairs within a
    frame, of neighbouring bands, tell short texts apart, which have a frame or two."""
    codes = [np.zeros(0, np.int64)]
    for ahead in range(reach + 1):
        a, b = peaks[: len(peaks) - ahead], peaks[ahead:]
        for i in range(4):
            j = (i + max(1, ahead)) % 4
            ok = np.flatnonzero((a[:, i] >= 0) & (b[:, j] >= 0))
            codes.append(ok.astype(np.int64) << 24 | a[ok, i].astype(np.int64) << 13 | b[ok, j].astype(np.int64) << 2 | ahead)
    return np.sort(np.concatenate(codes))


def media_row(text: str | None) -> dict:
    raw = (text or "").encode("utf-8")
    media = wav_bytes(raw + b"\0" * (-len(raw) % UNIT if raw else UNIT))
    payload = wav_samples(media)
    pairs = peak_pairs(spectral_peaks(payload))
    return {
        "n_bytes": len(raw), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "media": media, "pairs": pairs,
    }


def media_columns(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """docs (doc_id, text) → the media file, its digests, and `pairs`, the time-coded peak pairs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("pairs", pa.list_(pa.int64()))]
        schema = pa.schema(kinds + [("media", pa.binary())] * keep_media)
        for b in batches:
            out, held = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                row = media_row(text.as_py())
                out.append([doc_id, *(row[k] for k in schema.names[1:])])
                held += row["media_bytes"]
                if held >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pairs array<long>"
    return arrow_rows(docs.select("doc_id", "text"), rows, kinds + ", media binary" * keep_media)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    made = media_columns(table(spark, sf_dir, "documents"), keep_media=False)
    pairs = F.array_join(F.transform("pairs", lambda x: F.lower(F.hex(x))), " ")
    feature = F.concat_ws(":", F.col("payload_bytes").cast("string"), pairs)
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
