"""Media columns: texts as WAV, read back by the wave module, with spectral-peak pair fingerprints.

A payload is stored as 8-bit mono samples. The stored bytes are read back, cut into overlapping frames and
transformed; each frame keeps its strongest local peaks, and peaks of nearby frames are paired. A pair's hash
is made of both frequencies and the distance in frames, its time code is the frame of its first peak.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossgraph.llm.common import small_batches

ALIGN = 64
RATE = 8000
FRAME = 128
HOP = 64
#: Peaks of a frame, pairs of a peak, and frames between two paired peaks, at most.
PEAKS = 2
FAN = 2
REACH = 8
#: Frames that are transformed at once.
BLOCK = 8192
WINDOW = np.hanning(FRAME).astype(np.float32)
#: Rows of an Arrow batch that holds media.
ROWS = 200

FEATURES = "n_samples:long,payload_sha256:string,tail_crc32:long,times:array<int>,hashes:array<int>"


def payload(text: str | None) -> bytes:
    """UTF-8 and bytes 0 up to a positive multiple of ALIGN."""
    raw = (text or "").encode()
    return raw.ljust(max(ALIGN, -(-len(raw) // ALIGN) * ALIGN), b"\0")


def to_wav(samples: bytes) -> bytes:
    """The samples as an 8-bit mono WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    """The samples of a WAV file."""
    with wave.open(io.BytesIO(stored), "rb") as file:
        return file.readframes(file.getnframes())


def spectrum_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and frequency bins of the strongest local maxima of the short-time Fourier transform, by frame."""
    n = max(1, -(-max(len(samples) - FRAME, 0) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + FRAME, dtype=np.float32)
    padded[: len(samples)] = samples
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    at, bins = [], []
    for start in range(0, n, BLOCK):  # a long recording is transformed in blocks
        power = np.abs(np.fft.rfft(frames[start : start + BLOCK] * WINDOW, axis=1)).astype(np.float32)
        inner = power[:, 1:-1]
        peak = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        best = np.sort(np.argpartition(-peak, PEAKS, axis=1)[:, :PEAKS], axis=1)
        real = np.take_along_axis(peak, best, axis=1) > 1e-3
        row, column = np.nonzero(real)
        at.append(row + start)
        bins.append(best[row, column] + 1)
    return np.concatenate(at), np.concatenate(bins)


def peak_pairs(at: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and hashes: each peak with the FAN peaks of later frames that follow it, within REACH frames."""
    times, hashes, order = [], [], []
    for k in range(1, FAN * PEAKS + PEAKS):
        first, second = np.arange(max(len(at) - k, 0)), np.arange(k, max(len(at), k))
        gap = at[second] - at[first]
        good = (gap > 0) & (gap <= REACH)
        first, second = first[good], second[good]
        times.append(at[first])
        hashes.append((bins[first] << 13) | (bins[second] << 4) | gap[good])
        order.append(first)
    time, code, first = np.concatenate(times), np.concatenate(hashes), np.concatenate(order)
    by = np.lexsort((code, first))
    time, code, first = time[by], code[by], first[by]
    starts = np.searchsorted(first, first)
    kept = np.arange(len(first)) - starts < FAN
    return time[kept].astype(np.int32), code[kept].astype(np.int32)


def features(stored: bytes) -> tuple[int, str, int, np.ndarray, np.ndarray]:
    """Of a stored WAV file, in the order of FEATURES."""
    raw = from_wav(stored)
    times, hashes = peak_pairs(*spectrum_peaks(np.frombuffer(raw, dtype=np.uint8).astype(np.float32) - 128))
    return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-ALIGN:]), times, hashes


def with_media(docs: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    """Add each whole text as a WAV file in a binary column; null counts as empty. Equal texts give equal files.

    Rows stay as they are, repeated ones and those with null ids too; an input column of that name is replaced.
    """
    small_batches(docs.sparkSession, ROWS)
    store = F.arrow_udf(lambda texts: pa.array([to_wav(payload(x)) for x in texts.to_pylist()], pa.binary()), "binary")
    return docs.withColumn(into, store(F.col(text)))


def media_features(media: Column) -> Column:
    """A struct of FEATURES from a column of WAV files; null files give a null struct."""

    def of(files: pa.Array) -> pa.Array:
        found = [None if x is None else features(x) for x in files.to_pylist()]
        names, kinds = ["n_samples", "payload_sha256", "tail_crc32", "times", "hashes"], [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        columns = [pa.array([None if x is None else x[k] for x in found], kind) for k, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays(columns, names, mask=pa.array([x is None for x in found]))

    return F.arrow_udf(of, f"struct<{FEATURES}>").asNondeterministic()(media)
