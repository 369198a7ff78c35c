"""Media columns: WAV bytes, short-time Fourier transforms and spectral-peak pair fingerprints.

A text's UTF-8 bytes, padded with spaces, become the 8-bit samples of a mono WAV file in a binary column, which is
lossless; the fingerprint is taken from the samples that the ``wave`` module reads back from that column. Rows are independent, so this is one
narrow, Arrow-batched projection without a shuffle; a frame's spectrum is small and long files go in blocks of
frames, so memory doesn't grow with a file's length beyond the file itself.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyworks.llm.common import with_arrow_column

PAD = 192
RATE = 8000
HOP = 96
PEAKS = 3
REACH = 3
BLOCK = 4096

SCHEMA = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, peak_times array<int>, peak_hashes array<int>, feature string"
)


def padded(text: str | None) -> bytes:
    """UTF-8 bytes with spaces up to a positive multiple of PAD; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(1, -(-len(raw) // PAD)) * PAD - len(raw))


def to_wav(payload: bytes) -> bytes:
    """The payload as 8-bit mono samples in a WAV container."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file, as stored."""
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def spectral_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of each frame's PEAKS strongest local maxima, in time order.

    Magnitudes are compared on a scale of whole decibels, ties going to the lower bin, so that the last digits of
    a transform can't change the outcome. Silent frames have no peaks.
    """
    window = np.hanning(PAD)
    starts = np.arange(0, len(samples) - PAD + 1, HOP)
    times, bins = [], []
    for at in range(0, len(starts), BLOCK):
        frames = np.lib.stride_tricks.sliding_window_view(samples, PAD)[starts[at : at + BLOCK]]
        level = np.rint(20 * np.log10(1 + np.abs(np.fft.rfft((frames - 128.0) * window, axis=1)))).astype(np.int32)
        inner = level[:, 1:-1]
        high = np.where((inner > level[:, :-2]) & (inner >= level[:, 2:]) & (inner > 0), inner, -1)
        best = np.argsort(-high, axis=1, kind="stable")[:, :PEAKS]
        t, k = np.nonzero(np.take_along_axis(high, best, 1) > 0)
        times.append(t + at)
        bins.append(best[t, k] + 1)
    return np.concatenate(times), np.concatenate(bins)


def peak_pairs(times: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a peak and each later peak at most REACH frames on: (time of the first, packed bins and lag)."""
    at, code = [], []
    for step in range(1, PEAKS * (REACH + 1)):
        lag = times[step:] - times[:-step]
        near = (lag >= 1) & (lag <= REACH)
        at.append(times[:-step][near])
        code.append((bins[:-step][near] << 16) | (bins[step:][near] << 8) | lag[near])
    at, code = np.concatenate(at), np.concatenate(code)
    order = np.lexsort((code, at))
    return at[order], code[order]


def describe(media: bytes) -> tuple:
    """The fields of SCHEMA, all read from the file."""
    payload = from_wav(media)
    at, code = peak_pairs(*spectral_peaks(np.frombuffer(payload, np.uint8)))
    feature = hashlib.md5(at.astype("<i4").tobytes() + code.astype("<i4").tobytes()).hexdigest()
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media),
        hashlib.sha256(media).hexdigest(), at.astype(np.int32), code.astype(np.int32), f"{len(at)}:{feature}",
    )


def with_media(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Add a binary column ``out`` with the text as a WAV file. A null text counts as empty: one frame of spaces.

    A column already called ``out`` is replaced, all others stay.
    """

    def work():
        return lambda texts: pa.array([to_wav(padded(t)) for t in texts], pa.binary())

    return with_arrow_column(df, text, out, T.BinaryType(), work)


def with_fingerprint(df: DataFrame, media: str = "media", out: str = "fingerprint") -> DataFrame:
    """Add a struct ``out`` of what a column of WAV files holds; a null file gives null, one that can't be read an error.

    Fields: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, peak_times and peak_hashes (parallel
    arrays in time order), feature (their count and md5). Equal files give equal values. A column already called
    ``out`` is replaced, all others stay.
    """
    shape = T._parse_datatype_string(SCHEMA)

    def work():
        kind = to_arrow_type(shape)
        return lambda files: pa.array([None if f is None else dict(zip(shape.names, describe(f), strict=True)) for f in files], kind)

    return with_arrow_column(df, media, out, shape, work, rows=200)
