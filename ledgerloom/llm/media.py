"""Media columns: bytes as WAV files, read back, with spectral-peak pair fingerprints.

A payload is stored as mono 8-bit PCM (one byte, one sample). Its short-time Fourier transform uses
windows of `frame` samples that overlap by half, so that no sample lies at the edges of all its windows. A frame's peaks
are its strongest local maxima: bins over both neighbours. Each peak is paired with the peaks of the next frames, and a
pair is coded with both bins and the time between them; the codes are stored with the frame at which they begin.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, utf8

RATE = 8000
#: Samples a frame, samples from frame to frame, peaks a frame, frames that a peak is paired with.
FRAME, HOP, PEAKS, REACH = 256, 128, 3, 2
#: Frames transformed at once.
BLOCK = 4096


def padded(raw: bytes, unit: int = 64) -> bytes:
    """raw and zero bytes up to a positive multiple of unit."""
    return raw + bytes(-len(raw) % unit if raw else unit)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """The bins of each frame's strongest peaks, strongest first, ties by the lower bin; 0 where a frame has fewer.

    A peak is stronger than the bin below it and at least as strong as the one above (of equal neighbours the lowest is one);
    a silent frame has none.
    """
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128
    n = max(1, -(-len(x) // HOP))
    x = np.concatenate([x, np.zeros(max(0, (n - 1) * HOP + FRAME - len(x)), dtype=np.float32)])
    window = np.hanning(FRAME).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    out = []
    for at in range(0, n, BLOCK):
        spectrum = np.fft.rfft(frames[at : at + BLOCK] * window, axis=1)[:, 1:]
        # whole numbers, so that the order of bins does not hang on rounding
        power = np.rint(spectrum.real**2 + spectrum.imag**2).astype(np.int64)
        edge = np.zeros((len(power), 1), dtype=np.int64)
        peak = (power > np.hstack([edge, power[:, :-1]])) & (power >= np.hstack([power[:, 1:], edge]))
        ranked = np.where(peak, power * 256 + (255 - np.arange(power.shape[1])), -1)
        top = np.argpartition(ranked, -PEAKS, axis=1)[:, -PEAKS:]
        order = np.argsort(-np.take_along_axis(ranked, top, axis=1), axis=1)
        top = np.take_along_axis(top, order, axis=1)
        out.append(np.where(np.take_along_axis(ranked, top, axis=1) < 0, 0, top + 1))
    return np.concatenate(out)


def pairs(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times (frames) and codes of all peak pairs, ordered by time and code."""
    times, codes = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for gap in range(1, REACH + 1):
        if len(bins) <= gap:
            break
        a, b = bins[:-gap, :, None], bins[gap:, None, :]
        code = ((a << 16) | (b << 4) | gap).reshape(-1)
        both = np.broadcast_to((a > 0) & (b > 0), (len(a), PEAKS, PEAKS)).reshape(-1)
        times.append(np.repeat(np.arange(len(a), dtype=np.int32), PEAKS * PEAKS)[both])
        codes.append(code.astype(np.int32)[both])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.argsort((t.astype(np.int64) << 32) | c)
    return t[order], c[order]


def media_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        rows = {k: [] for k in ("n_bytes", "media", "payload", "times", "codes")}
        for raw in utf8(batch.column("text")):
            raw = raw or b""
            media = to_wav(padded(raw))
            payload = from_wav(media)
            times, codes = pairs(peaks(payload))
            for k, v in zip(rows, (len(raw), media, payload, times, codes)):
                rows[k].append(v)
        sizes = pa.array(np.cumsum([0, *map(len, rows["times"])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(rows[k]))) for k in ("times", "codes")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(rows["n_bytes"], pa.int64()), pa.array(rows["media"], pa.binary()), pa.array(rows["payload"], pa.binary()), *lists],
            names=["doc_id", "n_bytes", "media", "payload", "times", "codes"],
        )


def media(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, media (the WAV file), payload (read back from it), and times and
    codes, the time-coded arrays of its peak pairs.

    Null texts count as empty; an empty payload is one unit of zeros and has no pairs. Equal texts give equal values. Columns of docs but doc_id and text are not read.
    """
    return docs.select("doc_id", "text").mapInArrow(media_batches, "doc_id long, n_bytes long, media binary, payload binary, times array<int>, codes array<int>")


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of media()'s columns, computed where the media are made so that they are not moved."""
    for batch in media_batches(batches):
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
        files, payloads = batch.column("media").to_pylist(), batch.column("payload").to_pylist()
        offsets, codes, times = batch.column("codes").offsets.to_numpy(), batch.column("codes").values.to_numpy(), batch.column("times").values.to_numpy()
        marks = [hashlib.sha256(times[a:b].tobytes() + codes[a:b].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("n_bytes"),
                pa.array([len(x) for x in payloads], pa.int64()),
                sha(payloads),
                pa.array([zlib.crc32(x[-64:]) for x in payloads], pa.int64()),
                pa.array([len(x) for x in files], pa.int64()),
                sha(files),
                pa.array([f"{b - a}:{m}" for a, b, m in zip(offsets[:-1], offsets[1:], marks)]),
            ],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def digests(docs: DataFrame) -> DataFrame:
    """Per row of docs the digests of media(); feature is the number of peak pairs and their digest.

    Nulls and empty texts count as one unit of zeros, which has no peaks. Row for row; repeated rows and null doc_ids stay.
    """
    return docs.select("doc_id", "text").mapInArrow(digest_batches, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def matches(left: tuple[list[int], list[int]], right: tuple[list[int], list[int]]) -> int:
    """How many peak pairs two fingerprints share at their best time offset; for look-ups of excerpts."""
    places: dict[int, list[int]] = {}
    for t, c in zip(*left):
        places.setdefault(c, []).append(t)
    votes: dict[int, int] = {}
    for t, c in zip(*right):
        for s in places.get(c, ()):
            votes[s - t] = votes.get(s - t, 0) + 1
    return max(votes.values(), default=0)


def feature_of(times: list[int], codes: list[int]) -> str:
    raw = np.array(times, np.int32).tobytes() + np.array(codes, np.int32).tobytes()
    return f"{len(codes)}:{hashlib.sha256(raw).hexdigest()}"
