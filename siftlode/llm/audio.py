"""Media columns: text bytes kept as 8-bit audio, and log-mel features of it as fixed-shape tensors."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192
STORED_HZ, FEATURE_HZ = 24_000, 16_000
FRAME, HOP, FFT, MELS = 400, 160, 512, 32
#: Shape of a tensor: frames by mel bands.
SHAPE = (16, MELS)
#: Samples resampled and frames transformed at once, so that the arrays between steps are bounded; what is
#: kept of a text follows its length (about 16 bytes a byte: samples, mel bands, media and tensors).
BLOCK = 1 << 19
FRAMES = 4096
#: Bytes of results in one batch.
OUT_BYTES = 4 << 20


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled with spaces up to a positive multiple of 192, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * ((-len(raw) % UNIT) if raw else UNIT), len(raw)


def to_wav(payload: bytes) -> bytes:
    """Mono 8-bit PCM: each byte is one sample."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, STORED_HZ, len(payload), "NONE", ""))
        w.writeframesraw(payload)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media)) as w:
        if w.getsampwidth() != 1 or w.getnchannels() != 1:
            raise ValueError("not mono 8-bit PCM")
        return w.readframes(w.getnframes()), w.getframerate()


@lru_cache(8)
def _phases(up: int, down: int, taps: int = 12) -> np.ndarray:
    """Kaiser-windowed low-pass, dealt into `up` phases of `taps` coefficients."""
    n = taps * up
    at = (np.arange(n) - (n - 1) / 2) / max(up, down)
    h = np.sinc(at) * np.kaiser(n, 7.0)
    return (h * up / h.sum()).reshape(taps, up).T.astype(np.float32)


def resample(x: np.ndarray, source_hz: int, target_hz: int) -> np.ndarray:
    """Polyphase resampling: output m is the dot product of phase m * down mod up with the samples around it."""
    g = gcd(source_hz, target_hz)
    up, down = target_hz // g, source_hz // g
    h = _phases(up, down)
    taps = h.shape[1]
    n = -(-len(x) * up // down)
    out = np.empty(n, np.float32)
    padded = np.r_[np.zeros(taps, np.float32), x, np.zeros(taps + down, np.float32)]
    step = max(1, BLOCK // up) * up
    for at in range(0, n, step):
        size = min(step, n - at)
        for p in range(min(up, size)):
            m = at + p
            count = -(-(size - p) // up)
            first = m * down // up + taps // 2 + taps
            phase = m * down % up
            y = np.zeros(count, np.float32)
            for t in range(taps):
                lo = first - t
                y += h[phase, t] * padded[lo : lo + (count - 1) * down + 1 : down]
            out[m : at + size : up] = y
    return out


@lru_cache(4)
def _mel(hz: int) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale: FFT bins by bands."""
    mel = np.linspace(0, 2595 * np.log10(1 + hz / 2 / 700), MELS + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * hz / FFT
    lo, mid, hi = edge[:-2], edge[1:-1], edge[2:]
    return np.maximum(0, np.minimum((f[:, None] - lo) / (mid - lo), (hi - f[:, None]) / (hi - mid))).astype(np.float32)


def log_mel(x: np.ndarray, hz: int) -> tuple[np.ndarray, np.ndarray]:
    """Overlapped Hann frames -> (frames by bands of log energy, frame energy in dB).  Zeros fill the last
    frame, so that every sample is in one; the Hann window is nowhere zero on them."""
    x = np.r_[x, np.zeros(max(FRAME - len(x), 0) + -max(len(x) - FRAME, 0) % HOP, np.float32)]
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window = np.hanning(FRAME + 2)[1:-1].astype(np.float32)
    mels, energy = [], []
    for at in range(0, len(frames), FRAMES):
        f = frames[at : at + FRAMES] * window
        energy.append((f * f).mean(axis=1))
        spectrum = np.fft.rfft(f, FFT)
        mels.append(np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ _mel(hz) + 1e-6))
    return np.concatenate(mels), 10 * np.log10(np.concatenate(energy) + 1e-9)


def segments(db: np.ndarray, spread: float = 0.5) -> list[tuple[int, int]]:
    """Hysteresis: a segment begins where the energy reaches mean + spread * deviation and ends where it
    falls under mean - spread * deviation.  Where a few quiet frames put that level out of reach of most,
    the 90th percentile (the mean at least) takes its place, so that there is always a segment.  Energy
    that never varies is one segment."""
    mean, sd = float(db.mean()), float(db.std())
    if sd < 1e-3:
        return [(0, len(db))]
    level = min(mean + spread * sd, max(mean, float(np.percentile(db, 90))), float(db.max()))
    mark = np.where(db >= level, 1, np.where(db < mean - spread * sd, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(db)), -1))
    on = np.where(last >= 0, mark[last], -1) > 0
    edges = np.flatnonzero(np.diff(np.r_[False, on, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def tiles(found: list[tuple[int, int]], frames: int, most: int = SHAPE[0]) -> list[tuple[int, int, bool]]:
    """All frames in pieces of `most` at most, none of which crosses the edge of a segment: (from, to, in a segment)."""
    edges = [0, *(e for span in found for e in span), frames]
    inside = [k % 2 == 1 for k in range(len(edges) - 1)]
    return [(at, min(at + most, hi), on) for lo, hi, on in zip(edges, edges[1:], inside, strict=False) for at in range(lo, hi, most)]


@lru_cache(1)
def _tensor_type() -> pa.FixedShapeTensorType:
    return pa.fixed_shape_tensor(pa.float32(), SHAPE)


def tensors(samples: bytes, hz: int) -> pa.RecordBatch:
    """start_s, end_s, active (whether it lies in a segment) and a 16 by 32 log-mel tensor for each piece of the
    signal; short pieces are filled with the least value.  Every frame is in exactly one piece: the segments
    mark what is loud, they do not choose what is kept.  Samples -> features only, whatever the bytes mean."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel, db = log_mel(resample(x, hz, FEATURE_HZ), FEATURE_HZ)
    spans = tiles(segments(db), len(db))
    out = np.full((len(spans), *SHAPE), np.log(1e-6), np.float32)
    for i, (lo, hi, _) in enumerate(spans):
        out[i, : hi - lo] = mel[lo:hi]
    flat = pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), SHAPE[0] * SHAPE[1])
    cells = pa.ExtensionArray.from_storage(_tensor_type(), flat)
    sec = HOP / FEATURE_HZ
    starts = pa.array([lo * sec for lo, _, _ in spans], pa.float64())
    ends = pa.array([((hi - 1) * HOP + FRAME) / FEATURE_HZ for _, hi, _ in spans], pa.float64())
    active = pa.array([on for _, _, on in spans], pa.bool_())
    return pa.RecordBatch.from_arrays([starts, ends, active, cells], ["start_s", "end_s", "active", "log_mel"])


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.Table:
    """The table that media_columns() stored in `features`."""
    return pa.ipc.open_stream(data).read_all()


def media_columns(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media,
    n_tensors, features, one row per row.

    media is a WAV file of the whole padded text; all else is made from the bytes read back out of it.
    features is an Arrow stream of start_s, end_s, active and a fixed-shape tensor per piece of the signal, all
    of it; active marks the pieces of the segments.
    Null and empty texts are 192 spaces.  Equal texts give equal values; null and repeated doc_ids pass
    through; an empty table gives no rows; other columns are ignored.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, n_tensors long, features binary"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                payload, n = payload_of(text.as_py())
                media = to_wav(payload)
                back, hz = from_wav(media)
                found = tensors(back, hz)
                rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), media, found.num_rows, to_ipc(found)))
                size += len(media) + len(rows[-1][-1])
                if size > OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
