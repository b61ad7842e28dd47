"""Media columns: texts stored as 8-bit WAV, read back by the wave module, with audio fingerprints.

The samples of the stored form go through a short-time Fourier transform of FRAME samples every HOP. Each
frame's PEAKS strongest local maxima of the magnitude spectrum become landmarks; a landmark and each one of
the next REACH frames' strongest make a pair (first bin, second bin, frames between), the fingerprint, stored with
the frame of its first landmark in two parallel arrays: hashes and time codes.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

#: Payloads are padded with this byte to a positive multiple of GRAIN.
PAD, GRAIN = 255, 576
RATE = 8000
FRAME, HOP = GRAIN, GRAIN // 2
#: Landmarks of a frame, and following frames that a landmark pairs with.
PEAKS, REACH = 3, 3
#: Frames transformed at a time: bounds memory for texts of any length.
BLOCK = 2048
WINDOW = np.hanning(FRAME).astype(np.float32)


def payload_of(text: bytes) -> bytes:
    """The text's bytes, padded to a positive multiple of GRAIN."""
    size = max(1, -(-len(text) // GRAIN)) * GRAIN
    return text.ljust(size, bytes([PAD]))


def store(payload: bytes) -> bytes:
    """A WAV file, one channel of unsigned 8-bit samples: the payload's bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def read(media: bytes) -> bytes:
    """The samples of such a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as f:
        if f.getnchannels() != 1 or f.getsampwidth() != 1:
            raise ValueError("one channel of 8-bit samples is expected")
        return f.readframes(f.getnframes())


def landmarks(samples: np.ndarray) -> np.ndarray:
    """Bins of each frame's PEAKS strongest local spectral maxima, strongest first: array (frames, PEAKS).

    0 stands where a frame has fewer maxima. Magnitudes are compared as whole numbers, ties by the lower bin.
    """
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.zeros((len(frames), PEAKS), dtype=np.int32)
    for low in range(0, len(frames), BLOCK):
        part = (frames[low : low + BLOCK].astype(np.float32) - 128) * WINDOW
        level = np.abs(np.fft.rfft(part, axis=1)).astype(np.int32)
        middle = level[:, 1:-1]
        rank = np.where((middle > level[:, :-2]) & (middle >= level[:, 2:]), middle, 0).astype(np.int64)
        rank = rank * 1024 + (1023 - np.arange(1, middle.shape[1] + 1))
        for k in range(PEAKS):
            best = rank.argmax(1)
            strong = rank[np.arange(len(rank)), best] >= 1024
            out[low : low + len(best), k] = np.where(strong, best + 1, 0)
            rank[np.arange(len(rank)), best] = -1
    return out


def fingerprint_pairs(peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, time codes): each frame's landmarks with the strongest of each of the next REACH frames."""
    hashes, times = [], []
    for ahead in range(1, REACH + 1):
        first, second = peaks[:-ahead], peaks[ahead:, :1]
        at, k = np.nonzero((first > 0) & (second > 0))
        hashes.append((first[at, k] << 16) | (second[at, 0] << 4) | ahead)
        times.append(at)
    h, t = np.concatenate(hashes), np.concatenate(times)
    order = np.lexsort((h, t))
    return h[order].astype(np.int32), t[order].astype(np.int32)


def describe(text: bytes) -> dict:
    """All columns of one text: stored form, what is read back from it, and its fingerprints."""
    media = store(payload_of(text))
    payload = read(media)
    peaks = landmarks(np.frombuffer(payload, dtype=np.uint8))
    hashes, times = fingerprint_pairs(peaks)
    feature = f"{len(peaks)}:{len(hashes)}:{zlib.crc32(hashes.tobytes() + times.tobytes()):08x}"
    return {
        "n_bytes": len(text), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": feature, "hashes": hashes, "times": times, "media": media,
    }


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """One row per row of docs: the columns of describe(), the stored form itself only with keep_media.

    Null texts count as empty, whose payload is GRAIN bytes of padding. Equal texts get equal values. Null and repeated ids are
    carried as they are, other columns take no part, and an empty table gives an empty one.
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "hashes", "times"]
    names += ["media"] * keep_media

    def run(texts: list[bytes | None]) -> dict:
        rows = [describe(t or b"") for t in texts]
        return {n: [r[n] for r in rows] for n in names}

    made = (
        "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
        "feature string, hashes array<int>, times array<int>" + ", media binary" * keep_media
    )
    return map_texts(docs, text_col, [id_col], run, made)
