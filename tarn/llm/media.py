"""Audio columns: lossless 8-bit WAV storage, polyphase resampling, log-mel features and
energy segments, stored as fixed-shape Arrow tensors with time spans.

``store_audio`` turns any text or binary column into one WAV file per row (unsigned 8-bit
mono PCM): the bytes, then bytes 255 up to a positive multiple of ``BLOCK``, are the
samples.  ``features`` reads WAV bytes back, resamples by ``UP / DOWN`` with a windowed-sinc
polyphase filter, takes overlapped frames through a mel filterbank, and segments by
energy with hysteresis (a segment opens above the upper level and closes below the lower
one).  Frames go on until one starts in the last ``HOP`` samples, over zeros beyond the
end, so that every sample weighs in; spans end with the audio.  ``tensor`` is an Arrow IPC stream with one row per patch: start and end in seconds
and an ``arrow.fixed_shape_tensor`` of ``PATCH`` frames by ``MELS`` bands; the last patch is
padded with the floor value.  Work goes in blocks of fixed size counted from a row's
start, so memory is bounded and equal inputs give equal bytes.

Null and empty inputs are one block of padding; repeated rows give repeated results;
other columns are dropped but for the id.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, sub_batches

BLOCK, RATE = 576, 16_000
UP, DOWN, TAPS = 3, 4, 12  # 16 kHz to 12 kHz; taps of each phase
FRAME, HOP, MELS, PATCH = 512, 256, 16, 32
CHUNK = 1023 * HOP  # output samples worked on at once: whole frames, and whole turns of the phases
FLOOR = -12.0
OPEN_DB, CLOSE_DB = 3.0, 1.0  # above the row's mean frame energy


def wav(payload: bytes) -> bytes:
    head = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    return head + b"data" + struct.pack("<I", len(payload)) + payload


def samples(stored: bytes) -> bytes:
    """The data chunk of a WAV file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"data":
            return stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(1)
def _phases() -> np.ndarray:
    """Filter taps by output phase: a Hann-windowed sinc at the lower of the two Nyquist rates."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = np.sinc(n * cut) * np.hanning(UP * TAPS + 2)[1:-1]
    h *= UP / h.sum()
    return h.reshape(TAPS, UP).T[:, ::-1].astype(np.float32)


def _part(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """x[a:b] with zeros before the start and after the end; unsigned 8-bit samples become floats."""
    x, behind = x[max(0, a) : max(0, b)], max(0, b - max(a, len(x)))
    if x.dtype == np.uint8:
        x = (x.astype(np.float32) - 128) / 128
    return np.pad(x, (max(0, -a), behind))


def resample(x: np.ndarray, start: int = 0, count: int | None = None) -> np.ndarray:
    """Samples ``start`` (a multiple of UP) and on of ``x`` at UP / DOWN of its rate; sample m is phase
    (m * DOWN) mod UP of the filter at m * DOWN // UP.  It runs out over zeros behind the end."""
    taps = _phases()
    count = len(x) * UP // DOWN - start if count is None else count
    low = start // UP * DOWN
    padded = _part(x, low - TAPS + 1, low + -(-count // UP) * DOWN + DOWN)
    out = np.empty(count, np.float32)
    for r in range(UP):  # outputs r, r + UP, ...: one phase, and inputs DOWN apart
        phase, base = r * DOWN % UP, r * DOWN // UP
        m = len(range(r, count, UP))
        total = np.zeros(m, np.float32)
        for k in range(TAPS):
            total += taps[phase, k] * padded[base + k : base + k + DOWN * m : DOWN][:m]
        out[r::UP] = total
    return out


@lru_cache(1)
def _bank() -> tuple[np.ndarray, np.ndarray]:
    rate = RATE * UP / DOWN
    to_mel, to_hz = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = to_hz(np.linspace(to_mel(60), to_mel(rate / 2), MELS + 2))
    bins = np.fft.rfftfreq(FRAME, 1 / rate)
    rise = (bins[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - bins[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(rise, fall)).T.astype(np.float32)


def log_mel(take: Callable[[int, int], np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies and mean frame energies of the frames that start in the first ``length`` samples;
    ``take(a, b)`` gives samples a to b (zeros beyond the end) and is asked for one chunk at a time."""
    window, bank = _bank()
    n = max(1, -(-length // HOP))
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for at in range(0, n, CHUNK // HOP):
        to = min(n, at + CHUNK // HOP)
        frames = np.lib.stride_tricks.sliding_window_view(take(at * HOP, (to - 1) * HOP + FRAME), FRAME)[::HOP] * window
        power = np.abs(np.fft.rfft(frames, axis=1).astype(np.complex64)) ** 2 / FRAME
        mel[at:to] = np.log(np.maximum(power @ bank, np.float32(np.exp(FLOOR))))
        energy[at:to] = (frames * frames).mean(1)
    return mel, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges, end exclusive: opened at OPEN_DB over the mean, closed under CLOSE_DB."""
    level = 10 * np.log10(np.maximum(energy, 1e-9) / max(float(energy.mean()), 1e-9))
    state = np.where(level >= OPEN_DB, 1, np.where(level < CLOSE_DB, 0, -1))
    at = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))  # the last frame that decided
    on = np.where(at >= 0, state[np.maximum(at, 0)], 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _tensor(mel: np.ndarray, length: float) -> bytes:
    """``length`` in seconds."""
    n = -(-len(mel) // PATCH)
    whole = np.full((n * PATCH, MELS), FLOOR, np.float16)
    whole[: len(mel)] = mel
    seconds = HOP * DOWN / UP / RATE
    starts = np.arange(n) * PATCH * seconds
    ends = np.minimum(np.minimum(np.arange(1, n + 1) * PATCH, len(mel)) * seconds, length)
    patches = pa.FixedShapeTensorArray.from_numpy_ndarray(whole.reshape(n, PATCH, MELS))
    batch = pa.RecordBatch.from_arrays([pa.array(starts), pa.array(ends), patches], ["start_s", "end_s", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensor(stored: bytes) -> pa.Table:
    """``start_s, end_s, log_mel`` (fixed-shape tensors) of one row."""
    return pa.ipc.open_stream(stored).read_all()


def store_audio(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: one WAV file per row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, "raw"):
                raws = part.column("raw").to_pylist()
                media = [wav(r + b"\xff" * (max(BLOCK, -(-len(r) // BLOCK) * BLOCK) - len(r))) for r in raws]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(r) for r in raws], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_arrow(rows, work, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes long, media binary")


FEATURES = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "n_frames long, segments array<struct<start_s:double,end_s:double>>, tensor binary"
)


def features(media: DataFrame, *, keys: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """Digests and features of the column ``media`` beside the columns ``keys``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds = HOP * DOWN / UP / RATE
        for batch in batches:
            for part in sub_batches(batch, "media"):
                rows = []
                for stored in part.column("media"):
                    stored = stored.as_py()
                    payload = samples(stored)
                    x = np.frombuffer(payload, np.uint8)
                    mel, energy = log_mel(lambda a, b: resample(x, a, b - a), -(-len(x) * UP // DOWN))
                    length = len(payload) / RATE
                    found = [{"start_s": a * seconds, "end_s": min(b * seconds, length)} for a, b in segments(energy)]
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), len(mel), found, _tensor(mel, length)))
                span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), span, pa.binary()]
                names = [f.split()[0] for f in FEATURES.split(", ")]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], [*keys, *names])

    head = ", ".join(f"{k} {media.schema[k].dataType.simpleString()}" for k in keys)
    return map_arrow(media.select(*keys, "media"), work, f"{head}, {FEATURES}")


def store_and_describe(docs: DataFrame, **columns) -> DataFrame:
    """Store WAV files in the shared folder, read them back, store their features, read those back."""
    media = materialize(store_audio(docs, **columns), "media")
    return materialize(features(media), "media-features")
