"""Media columns: a payload stored as WAV, read back, and fingerprinted.

A payload is the bytes of a text, padded with zero bytes to a positive multiple of 64, and is
kept as the 8-bit samples of a mono WAV file. Its fingerprint pairs spectral peaks: the file is
read by the wave module, a short-time Fourier transform gives a spectrum per frame, the strongest
bin of each of four bands is a peak if it is stronger there than in the frames beside it, and each
peak is paired with the next few. A pair (first bin, second bin, distance in frames) with the
first peak's time makes one 64-bit number, time << 32 | pair, and the array of these is the
column: sorted by time, so it can be cut, shifted and joined.

Defined results: a null text is empty, and its payload 64 zero bytes; equal texts give equal
values; a payload without peaks has an empty fingerprint; long payloads are transformed in blocks;
repeated rows are stored one by one; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import map_rows, table

RATE, UNIT = 16_000, 64
FRAME, HOP = 256, 128
#: Frames that are transformed at once.
BLOCK = 2048
#: The bins of each band: from, to.
BANDS = ((1, 9), (9, 25), (25, 57), (57, 129))
#: Peaks that follow in a pair, and the most frames between the two.
FOLLOWERS, MAX_GAP = 3, 63

_WINDOW = np.hanning(FRAME)


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def write_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def band_peaks(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The strongest bin of each band and its power, by frame: two arrays of frames x bands."""
    samples = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    # Silence fills the last frame, so every sample is in one.
    samples = np.pad(samples, (0, FRAME - len(samples) if len(samples) < FRAME else -(len(samples) - FRAME) % HOP))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    bins = np.empty((len(frames), len(BANDS)), np.int64)
    power = np.empty((len(frames), len(BANDS)))
    for start in range(0, len(frames), BLOCK):
        spectrum = np.fft.rfft(frames[start : start + BLOCK] * _WINDOW, axis=1)
        square = spectrum.real**2 + spectrum.imag**2
        for k, (a, b) in enumerate(BANDS):
            best = square[:, a:b].argmax(axis=1)
            bins[start : start + BLOCK, k] = best + a
            power[start : start + BLOCK, k] = square[np.arange(len(best)), best + a]
    return bins, power


def fingerprint(payload: bytes) -> np.ndarray:
    """The time-coded peak pairs, sorted."""
    bins, power = band_peaks(payload)
    beside = np.pad(power, ((1, 1), (0, 0)), constant_values=-1)
    peak = (power > beside[:-2]) & (power >= beside[2:]) & (power > 1e-6)
    t, k = np.nonzero(peak)
    f = bins[t, k]
    codes = []
    for step in range(1, FOLLOWERS + 1):
        gap = t[step:] - t[:-step]
        near = gap <= MAX_GAP
        codes.append((t[:-step][near] << 32) | (f[:-step][near] << 16) | (f[step:][near] << 8) | gap[near])
    return np.sort(np.concatenate(codes))


def store_media(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_bytes (unpadded) and media (a WAV file)."""
    kind = dict(rows.dtypes)[key]

    def make():
        def work(value, k):
            data = (value or "").encode()
            return k, len(data), write_wav(pad(data))

        return work

    return map_rows(rows, [F.col(text), F.col(key)], f"{key} {kind}, n_bytes long, media binary", make)


def media_fingerprints(rows: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """key and fingerprint (an array of time-coded pairs) of each stored file."""
    kind = dict(rows.dtypes)[key]
    return map_rows(rows, [F.col(media), F.col(key)], f"{key} {kind}, fingerprint array<long>", lambda: lambda wav, k: (k, fingerprint(read_wav(wav)).tolist()))


def digest(pairs: np.ndarray) -> str:
    """The fingerprint in short: the number of pairs and a hash of their codes."""
    return f"{len(pairs)}:{hashlib.md5(pairs.astype('<i8').tobytes()).hexdigest()}"


def op5_media_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kind = dict(docs.dtypes)["doc_id"]

    def make():
        def work(wav, key, n_bytes):
            payload = read_wav(wav)
            pairs = fingerprint(payload)
            return key, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(wav), hashlib.sha256(wav).hexdigest(), digest(pairs), pairs.tolist()

        return work

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprint array<long>"
    return map_rows(store_media(docs, "doc_id", "text"), [F.col("media"), F.col("doc_id"), F.col("n_bytes")], schema, make)
