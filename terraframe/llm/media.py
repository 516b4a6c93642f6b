"""Audio columns: texts as 8-bit WAV, read back with spectral-peak fingerprints.

The samples are the text's UTF-8 bytes, padded; WAV with one byte a sample holds
them without loss. Reading opens the stored file with the wave module, takes
short-time Fourier transforms of Hann windows and keeps, in each frame, the
strongest local peaks; each peak is paired with peaks of the next frames, and
(bin, bin, frames between) makes a code at the first peak's time.

Plan: two Arrow maps over the scan, one to write and one to read; no shuffle.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ._util import by_row, free, table, utf8

#: Payloads are padded to a positive multiple of so many bytes.
UNIT = 576
PAD = b"\xff"
RATE = 8000
FRAME = 576
HOP = 288
#: Frames transformed at a time; a long recording streams through.
FRAMES = 1024
PEAKS = 3
#: Frames ahead of a peak in which its partners lie.
REACH = 4

_HANN = np.hanning(FRAME).astype(np.float32)


def pad(payload: bytes, unit: int = UNIT) -> bytes:
    return payload + PAD * (-len(payload) % unit if payload else unit)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the up to PEAKS strongest local maxima of every frame, in order."""
    x = np.frombuffer(samples, np.uint8)
    n = max(1, 1 + (len(x) - FRAME) // HOP) if len(x) else 0
    times, bins = [], []
    for i in range(0, n, FRAMES):
        part = x[i * HOP : (min(n, i + FRAMES) - 1) * HOP + FRAME].astype(np.float32) - 128
        part = np.pad(part, (0, max(0, FRAME - len(part))))
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        z = np.fft.rfft(frames * _HANN, axis=1)
        power = z.real**2 + z.imag**2
        # bin 0 and the last have one neighbour only and don't count
        mid = power[:, 1:-1]
        high = np.where((mid > power[:, :-2]) & (mid >= power[:, 2:]), mid, -1)
        top = np.argpartition(-high, PEAKS - 1, axis=1)[:, :PEAKS]
        top.sort(axis=1)
        f, k = np.nonzero(np.take_along_axis(high, top, axis=1) > 1e-3)
        times.append(f + i)
        bins.append(top[f, k] + 1)
    if not times:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(times), np.concatenate(bins)


def pairs(times: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded pair codes: (frame of the first peak, bin1 << 13 | bin2 << 3 | frames between)."""
    at, codes = [], []
    ahead = np.searchsorted(times, times, side="right")
    end = np.searchsorted(times, times + REACH, side="right")
    for step in range(REACH * PEAKS):
        ok = ahead + step < end
        if not ok.any():
            break
        i, j = np.flatnonzero(ok), (ahead + step)[ok]
        at.append(times[i])
        codes.append(bins[i] << 13 | bins[j] << 3 | (times[j] - times[i]))
    if not at:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    at, codes = np.concatenate(at), np.concatenate(codes)
    order = np.lexsort((codes, at))
    return at[order].astype(np.int32), codes[order].astype(np.int32)


def encode(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``media`` (the WAV file) and ``n_bytes`` (of the text, unpadded) to every row; a null text counts as empty.

    An empty text makes one unit of padding; a text of any length is stored whole. Repeated rows are stored each, an empty table gives an empty one. Columns of these names are replaced, and the text's column leaves.
    """
    body = free(docs, "_body")
    bodies = docs.drop("media", "n_bytes").withColumn(body, utf8(text)).drop(text)
    own = lambda: lambda b: (to_wav(pad(b)), len(b))
    return by_row(bodies, own, [body], "media binary, n_bytes long").drop(body)


def read(rows: DataFrame, media: str = "media", arrays: bool = True) -> DataFrame:
    """Adds what the stored file holds: ``payload`` digests, peak and pair arrays (if ``arrays``) and ``feature``, their summary.

    A null media column value reads as a file without samples. Long recordings are transformed a stretch at a time.
    """
    out = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if arrays:
        out += ", pair_times array<int>, pair_codes array<int>"

    def one(stored):
        payload = from_wav(stored) if stored else b""
        t, b = peaks(payload)
        at, codes = pairs(t, b)
        digest = hashlib.sha256(at.tobytes() + codes.tobytes()).hexdigest()
        got = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored or b""), hashlib.sha256(stored or b"").hexdigest(), f"peaks={len(t)};pairs={len(at)};sha256={digest}")
        return (*got, at.tolist(), codes.tolist()) if arrays else got

    return by_row(rows, lambda: one, [media], out)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return read(stored, arrays=False).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


QUERIES = {"op4_media": op4_media}
