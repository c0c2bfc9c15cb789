"""Media columns: texts stored as 8-bit WAV, read back by the wave module, with spectral-peak pair fingerprints.

Each text is UTF-8, padded with spaces to a positive multiple of FRAME bytes, and stored losslessly as mono 8-bit
samples. From the samples read back, a short-time Fourier transform (Hann window of FRAME samples, half a frame of
hop) gives log magnitudes; a peak is a bin above both neighbours in frequency and in time and above the loudness of its
frame; each peak pairs with the next FAN peaks within REACH frames. A pair is the code f1 << 16 | f2 << 8 | dt at the
frame of its first peak: two arrays, `times` and `codes`, ordered by time.

Defined cases: null text is empty, whose payload is one frame of spaces; a constant signal has no peaks and empty
arrays; equal texts give equal values; other columns are ignored; an empty table gives no rows. Long texts are
transformed in blocks of BLOCK frames.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, texts_of

FRAME, RATE, FAN, REACH, BLOCK = 192, 8000, 3, 8, 2048
_HANN = np.hanning(FRAME + 1)[:FRAME].astype(np.float32)


def payload(text: str) -> bytes:
    raw = text.encode()
    return raw + b" " * (-len(raw) % FRAME if raw else FRAME)


def to_wav(samples: bytes) -> bytes:
    with io.BytesIO() as file:
        with wave.open(file, "wb") as out:
            out.setnchannels(1)
            out.setsampwidth(1)
            out.setframerate(RATE)
            out.writeframes(samples)
        return file.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the spectral peaks, by frame and bin."""
    signal = np.frombuffer(samples, np.uint8).astype(np.float32) - np.float32(128)
    hop = FRAME // 2
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::hop]
    times, bins = [], []
    for start in range(0, len(frames), BLOCK):
        a, b = max(0, start - 1), min(len(frames), start + BLOCK + 1)
        part = frames[a:b] - frames[a:b].mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(part * _HANN, axis=1)).astype(np.float32)
        loud = power[:, 1:-1]
        top = (loud > power[:, :-2]) & (loud >= power[:, 2:]) & (loud > 2 * power.mean(axis=1, keepdims=True) + np.float32(1e-3))
        top[1:] &= loud[1:] > loud[:-1]
        top[:-1] &= loud[:-1] >= loud[1:]
        t, f = np.nonzero(top)
        own = (t + a >= start) & (t + a < start + BLOCK)
        times.append(t[own] + a)
        bins.append(f[own] + 1)
    return np.concatenate(times), np.concatenate(bins)


def pairs(times: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded pairs of each peak with the next FAN peaks that are at most REACH frames later."""
    found_t, found_c = [], []
    for step in range(1, FAN + 1):
        gap = times[step:] - times[:-step]
        ok = gap <= REACH
        found_t.append(times[:-step][ok])
        found_c.append((bins[:-step][ok] << 16) | (bins[step:][ok] << 8) | gap[ok])
    t, c = np.concatenate(found_t), np.concatenate(found_c)
    order = np.lexsort((c, t))
    return t[order], c[order]


_SCHEMA = "doc_id long, n_bytes long, media binary, payload binary, times array<int>, codes array<int>"
_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
_NAMES = ["doc_id", "n_bytes", "media", "payload", "times", "codes"]


def _arrays(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).astype(np.int32) if values else np.empty(0, np.int32)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=1 << 20):
        sizes, media, read, times, codes = [], [], [], [], []
        for text in texts_of(batch):
            stored = to_wav(payload(text))
            back = from_wav(stored)
            t, c = pairs(*peaks(back))
            sizes.append(len(text.encode()))
            media.append(stored)
            read.append(back)
            times.append(t)
            codes.append(c)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, _TYPES[1]), pa.array(media, _TYPES[2]), pa.array(read, _TYPES[3]), _arrays(times), _arrays(codes)], names=_NAMES)


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the WAV file), payload (read back from it), times and codes of its peak pairs."""
    return docs.select("doc_id", "text").mapInArrow(_rows, _SCHEMA)


def digests(media: DataFrame) -> DataFrame:
    """Checksums of the media columns; feature is the number of pairs and the SHA-256 of both arrays."""
    read, stored = F.col("payload"), F.col("media")
    said = F.sha2(F.concat_ws("|", F.concat_ws(",", F.col("times").cast("array<string>")), F.concat_ws(",", F.col("codes").cast("array<string>"))), 256)
    return media.select(
        "doc_id",
        "n_bytes",
        F.length(read).cast("long").alias("payload_bytes"),
        F.sha2(read, 256).alias("payload_sha256"),
        F.crc32(F.substring(read, -16, 16)).alias("tail_crc32"),
        F.length(stored).cast("long").alias("media_bytes"),
        F.sha2(stored, 256).alias("media_sha256"),
        F.concat_ws(":", F.size("codes").cast("string"), said).alias("feature"),
    )
