"""Media columns: text bytes stored as audio, and features of the stored audio.

The payload is kept as 8-bit mono samples in a RIFF/WAVE file, a binary column. Features are
read from those stored bytes: polyphase resampling, overlapped log-mel filterbanks and
hysteresis energy segmentation. Filterbanks are kept as fixed-shape Arrow tensors with the
time span of each. No shuffle; memory is bounded by one document and a block of frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

UNIT, RATE = 576, 8000
UP, DOWN, TAPS = 3, 4, 16
FRAME, HOP, MELS = 192, 96, 16
#: Frames in a tensor.
PATCH = 64
BLOCK = 4096
MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensors binary"


def payload(data: bytes) -> bytes:
    """The bytes and 255s up to a positive multiple of UNIT."""
    return data + b"\xff" * (UNIT - len(data) % UNIT if len(data) % UNIT or not data else 0)


def to_wave(samples: bytes) -> bytes:
    """One channel of unsigned 8-bit samples as a RIFF/WAVE file."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def from_wave(media: bytes) -> bytes:
    """The samples of a RIFF/WAVE file, its chunks walked."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _phases() -> np.ndarray:
    """A windowed-sinc low pass at the lower of both rates, by output phase: (UP, TAPS)."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(n / max(UP, DOWN)) * np.hamming(UP * TAPS)
    return (h * UP / h.sum()).reshape(TAPS, UP).T[:, ::-1].astype(np.float32).copy()


def _mel_bank() -> np.ndarray:
    """Triangles evenly spaced on the mel scale: (FRAME // 2 + 1, MELS)."""
    top = RATE * UP / DOWN / 2
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + top / 700), MELS + 2) / 2595) - 1)
    f = np.linspace(0, top, FRAME // 2 + 1)[:, None]
    return np.maximum(0, np.minimum((f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1]))).astype(np.float32)


PHASES, BANK, TAPER = _phases(), _mel_bank(), np.hanning(FRAME).astype(np.float32)


def padded(x: np.ndarray) -> np.ndarray:
    """Zeros after the samples, so that the filter runs out and frames end on a whole hop: every sample lies in a frame."""
    hop = HOP * DOWN // UP
    return np.concatenate([x, np.zeros(TAPS + -(len(x) + TAPS) % hop, np.float32)])


def resample(x: np.ndarray) -> np.ndarray:
    """UP / DOWN times the samples: output m takes the filter phase m * DOWN mod UP."""
    n = len(x) // DOWN * UP
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN, np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n, np.float32)
    for p in range(UP):
        first, phase = divmod(p * DOWN, UP)
        out[p::UP] = view[first : first + (n // UP - 1) * DOWN + 1 : DOWN] @ PHASES[phase]
    return out


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) filterbank logarithms of overlapped frames, and each frame's energy in dB."""
    view = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    mel, power = np.empty((len(view), MELS), np.float32), np.empty(len(view), np.float32)
    for at in range(0, len(view), BLOCK):
        part = view[at : at + BLOCK] * TAPER
        mel[at : at + BLOCK] = np.log(np.square(np.abs(np.fft.rfft(part, axis=1).astype(np.complex64))) @ BANK + 1e-6)
        power[at : at + BLOCK] = 10 * np.log10(np.mean(np.square(part), axis=1) + 1e-9)
    return mel, power


def segments(power: np.ndarray, on: float = 1.0, off: float = -1.0) -> np.ndarray:
    """(start, end) frames of active runs: on above the mean by ``on`` dB, until below it by ``off``."""
    level = power - power.mean()
    mark = np.where(level >= on, 1, np.where(level < off, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), 0))
    active = mark[last] == 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], active.view(np.int8), [0]])))
    return edge.reshape(-1, 2)


def tensor_table(mel: np.ndarray, spans: np.ndarray) -> bytes:
    """An Arrow stream: tensor (PATCH, MELS), frames in use, start_s, end_s, and the active spans inside."""
    n = -(-len(mel) // PATCH)
    full = np.zeros((n, PATCH, MELS), np.float32)
    full.reshape(-1, MELS)[: len(mel)] = mel
    step = HOP / (RATE * UP / DOWN)
    first = np.arange(n) * PATCH
    inside = [[{"start_s": float(max(s, a) * step), "end_s": float(min(e, a + PATCH) * step)} for s, e in spans[(spans[:, 0] < a + PATCH) & (spans[:, 1] > a)]] for a in first]
    batch = pa.record_batch({
        "tensor": pa.FixedShapeTensorArray.from_numpy_ndarray(full),
        "frames": pa.array(np.minimum(PATCH, len(mel) - first), pa.int32()),
        "start_s": pa.array(first * step),
        "end_s": pa.array(np.minimum(first + PATCH, len(mel)) * step),
        "active": pa.array(inside, pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))),
    })
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def tensor_digest(stream: bytes) -> str:
    """Checksums of a stored stream as read back: of its tensors, and of the time spans of all tensors and active runs."""
    t = read_tensors(stream).combine_chunks()
    full = np.concatenate([c.to_numpy_ndarray() for c in t["tensor"].chunks])
    times = [x for c in ("start_s", "end_s") for x in t[c].to_pylist()] + [v for spans in t["active"].to_pylist() for x in spans for v in (x["start_s"], x["end_s"])]
    return f"crc={zlib.crc32(np.round(full, 2).astype('<f4').tobytes()):08x};times={zlib.crc32(np.round(times, 6).astype('<f8').tobytes()):08x}"


def store_text(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's bytes as a media column: doc_id, n_bytes (unpadded), media. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([to_wave(payload(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, MEDIA)


def audio_features(media: DataFrame, *, tensors: bool = True) -> DataFrame:
    """Digests and features of stored media, read back from the stored bytes.

    ``feature`` sums up frames, active spans (the first eight, in frames), mean log-mel values
    and the checksums of the tensors and of all time spans; ``tensors`` is the Arrow stream of
    :func:`tensor_table`, null if not asked for. Equal media give equal values; repeated rows and null ids are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column("media"):
                stored = x.as_buffer().to_pybytes()
                back = from_wave(stored)
                mel, power = log_mel(resample(padded((np.frombuffer(back, np.uint8).astype(np.float32) - 128) / 128)))
                spans = segments(power)
                n = -(-len(mel) // PATCH)
                stream = tensor_table(mel, spans)
                means = ",".join(f"{v:.2f}" for v in mel.mean(axis=0, dtype=np.float64))
                text = f"frames={len(mel)};patches={n};segments={len(spans)};first={'|'.join(f'{s}-{e}' for s, e in spans[:8])};mel={means};{tensor_digest(stream)}"
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), text, stream if tensors else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensors"])

    return media.mapInArrow(run, FEATURES)
