"""Media columns for audio: 8-bit PCM in a WAV container, and features of what is read back from it: polyphase resampling,
overlapped log-mel filterbanks and hysteresis energy segmentation, stored as fixed-shape Arrow tensors with time spans."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.llm.common import table
from tallyvane.sources.staging import stage

#: Payloads are padded with FILL to a positive multiple of UNIT.
UNIT, FILL = 576, b"\xff"
#: Samples a second as stored, and the ratio at which they are resampled.
RATE, UP, DOWN = 12_000, 2, 3
#: Taps of each phase of the resampling filter.
TAPS = 16
FRAME, HOP, MELS = 256, 128, 20
#: Frames in one tensor.
TENSOR_FRAMES = 16
#: Decibels above and below a recording's mean energy at which a segment begins and ends.
RISE, FALL = 0.5, -0.5
#: Samples taken at a time, so that memory does not grow with the recording; a multiple of HOP * DOWN.
BLOCK = HOP * DOWN * 1024
FLOOR = 1e-10


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Mono PCM with unsigned 8-bit samples."""
    body = payload + b"\0" * (len(payload) % 2)
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + 8 + len(body), b"WAVE") + form + struct.pack("<4sI", b"data", len(payload)) + body


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of what to_wav made; other formats raise ValueError."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data in the WAV file")


@cache
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """The low-pass filter of a resampler, a row for each phase: a windowed sinc at the narrower band."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    return (h / h.sum() * up).reshape(taps, up).T.astype(np.float32).copy()


def resample(samples: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase resampling by up/down: each output takes the one phase of the filter that falls on inputs, none else is made."""
    phases = _phases(up, down, taps)
    n_out = len(samples) * up // down
    padded = np.concatenate([np.zeros(taps - 1, np.float32), samples])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n_out, np.float32)
    for first in range(up):  # outputs first, first + up, ... share a phase and step by `down` inputs
        count = len(range(first, n_out, up))
        if count:
            at = first * down // up
            out[first::up] = windows[at : at + (count - 1) * down + 1 : down] @ phases[first * down % up][::-1]
    return out


@cache
def mel_bank(rate: int, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters, even on the mel scale, as a (bins, mels) matrix."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    bins = np.arange(frame // 2 + 1) * rate / frame
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    rising, falling = (bins[:, None] - low) / (mid - low), (high - bins[:, None]) / (high - mid)
    return np.maximum(0, np.minimum(rising, falling)).astype(np.float32)


def log_mel(samples: np.ndarray, rate: int) -> np.ndarray:
    """(frames, MELS) log energies of overlapped frames; what is left over at the end is padded with silence to a frame."""
    n = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(samples)] = samples
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) ** 2
    return np.log10(power @ mel_bank(rate) + FLOOR).astype(np.float32)


def segments(energy: np.ndarray) -> np.ndarray:
    """(begin, end) frames of active stretches: one begins where energy reaches mean + RISE and lasts until it is below
    mean + FALL."""
    mean = energy.mean()
    mark = np.where(energy >= mean + RISE, 1, np.where(energy < mean + FALL, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), 0))
    edges = np.diff(np.concatenate([[0], (mark[last] == 1).astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1)


def features_of(payload: bytes, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and segments of a recording, made block by block."""
    bytes_ = np.frombuffer(payload, np.uint8)
    out_rate, parts = rate * UP // DOWN, []
    left = np.zeros(0, np.float32)
    for at in range(0, len(bytes_), BLOCK):
        back = min(at, DOWN * TAPS)  # history of the filter
        x = (bytes_[at - back : at + BLOCK].astype(np.float32) - 128) / 128
        y = np.concatenate([left, resample(x)[back * UP // DOWN :]])
        if at + BLOCK >= len(bytes_):
            parts.append(log_mel(y, out_rate))
        else:
            n = (len(y) - FRAME) // HOP + 1
            parts.append(log_mel(y[: (n - 1) * HOP + FRAME], out_rate))
            left = y[n * HOP :]
    mel = np.round(np.concatenate(parts), 3)
    return mel, segments(10 * mel.mean(axis=1))


TENSOR = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS))
SPAN_SCHEMA = pa.schema([("begin_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", TENSOR)])


def to_tensors(mel: np.ndarray, rate: int) -> bytes:
    """An Arrow stream: a row for each TENSOR_FRAMES frames with its time span; the last is filled with the floor's log."""
    n, second = len(mel), rate * UP // DOWN
    rows = -(-n // TENSOR_FRAMES)
    full = np.full((rows * TENSOR_FRAMES, MELS), np.log10(FLOOR), np.float32)
    full[:n] = mel
    flat = pa.array(full.reshape(-1))
    tensors = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(flat, TENSOR_FRAMES * MELS))
    begin = np.arange(rows) * TENSOR_FRAMES
    end = np.minimum(begin + TENSOR_FRAMES, n)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, SPAN_SCHEMA) as writer:
        writer.write_batch(pa.record_batch([pa.array(begin * HOP / second), pa.array(((end - 1) * HOP + FRAME) / second), tensors], schema=SPAN_SCHEMA))
    return sink.getvalue().to_pybytes()


def from_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def store_audio(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of docs (doc_id, text): each text's UTF-8 bytes, padded, as a WAV file in a binary column.

    A null text is stored as an empty one, which is one unit of padding; a null doc_id stays null; repeated rows are stored
    each; other columns are ignored; an empty table gives no rows. The table is written to the shared folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = [x or b"" for x in part.column("body").to_pylist()]
                media = [to_wav(x + FILL * (max(UNIT, -(-len(x) // UNIT) * UNIT) - len(x))) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("body"))
    return stage(whole.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "audio", compression="zstd")


def audio_features(stored: DataFrame) -> DataFrame:
    """What is read back from a media column: doc_id, n_bytes, media, digests, segments and tensors.

    Adds media_bytes, media_sha256, payload_bytes, payload_sha256, tail_crc32 (of the last 32 bytes), n_frames, segments (array
    of struct<begin_s, end_s>) and tensors (an Arrow stream of fixed-shape log-mel tensors with time spans). Rows are
    independent of each other; repeated rows get the same values.
    """
    schema = "doc_id long, n_bytes long, media binary, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, n_frames long, segments array<struct<begin_s:double,end_s:double>>, tensors binary"
    span = pa.list_(pa.struct([("begin_s", pa.float64()), ("end_s", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[] for _ in range(8)]
                for media in part.column("media").to_pylist():
                    rate, payload = from_wav(media)
                    mel, found = features_of(payload, rate)
                    second = rate * UP / DOWN
                    spans = [{"begin_s": a * HOP / second, "end_s": ((b - 1) * HOP + FRAME) / second} for a, b in found.tolist()]
                    values = (len(media), hashlib.sha256(media).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(mel), spans, to_tensors(mel, rate))
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), span, pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, out, kinds)], names=[x.split(" ")[0] for x in schema.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def store_features(stored: DataFrame) -> DataFrame:
    """The features of a media column, tensors and time spans among them, as a table of their own beside it, read back."""
    return stage(audio_features(stored).drop("media"), "audio-features", compression="zstd")


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of every document stored as audio; both tables are written and read back."""
    found = store_features(store_audio(table(spark, sf_dir, "documents")))
    active = F.aggregate("segments", F.lit(0.0), lambda s, x: s + x["end_s"] - x["begin_s"])
    feature = F.format_string("frames=%d;segments=%d;active=%.3f;tensors=%s", F.col("n_frames"), F.size("segments"), active, F.md5("tensors"))
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        "media_bytes", "media_sha256", feature.alias("feature"),
    )
