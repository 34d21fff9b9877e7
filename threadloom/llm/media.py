"""Media columns: payloads as 8-bit audio, and audio features as fixed-shape tensors with time spans.

``encode`` stores bytes losslessly as a mono 8-bit PCM WAV of 12 kHz in a binary column. ``features`` reads the
stored bytes back: polyphase resampling to 8 kHz (up 2, down 3), overlapped Hann frames, log-mel filterbanks and a
segmentation by frame energy with hysteresis. Log-mels are cut into blocks of a fixed shape, each with its time span, and stored
as Arrow's fixed-shape tensors, an IPC stream a document; ``digest_media`` reads them back.

Cases: null text is empty, and an empty payload is padded to one unit; equal payloads have equal results, as each is
computed alone, in blocks counted from its own start; very long payloads are resampled and framed block by block;
null ids and repeated rows each give their rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, written

UNIT, PAD = 192, b" "
RATE_STORED, RATE = 12_000, 8_000
UP, DOWN, TAPS = 2, 3, 16
FRAME, HOP, MELS = 256, 128, 24
#: Shape of a tensor: frames by mel bands. Samples of a block that is worked on at once (a multiple of DOWN).
SHAPE = (32, MELS)
BLOCK = 3 << 16
#: Hysteresis over the frame energies, in standard deviations from their mean.
RISE, FALL = 0.5, 0.0


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    """raw with spaces up to a positive multiple of unit."""
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), PAD)


def wav(payload: bytes) -> bytes:
    """A RIFF/WAVE file of unsigned 8-bit mono samples."""
    odd = len(payload) & 1
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE_STORED, RATE_STORED, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * odd
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def samples(media: bytes) -> bytes:
    """The sample bytes of a WAV file, found chunk by chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("a WAV file without data")


@cache
def _phases() -> np.ndarray:
    """(TAPS, UP): a windowed-sinc low-pass at the lower of both bands, one column a phase."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / DOWN) * np.hamming(n)
    return (h / h.sum() * UP).reshape(TAPS, UP)[::-1].astype(np.float32)


@cache
def _mel() -> np.ndarray:
    """(FRAME // 2 + 1, MELS): triangular filters, even on the mel scale."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(0), to_mel(RATE / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1)[:, None] * RATE / FRAME
    up, down = (f - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_hann = np.hanning(FRAME).astype(np.float32)


def resampled(raw: bytes) -> np.ndarray:
    """Samples at RATE: output k takes phase k % UP over TAPS inputs around k * DOWN // UP."""
    x = np.frombuffer(raw, np.uint8)
    n = len(x)
    out = np.empty(n // DOWN * UP, np.float32)
    steps = n // DOWN
    # both phases of a step of DOWN inputs: windows start TAPS // 2 before it, the later phase one input on
    for begin in range(0, steps, BLOCK // DOWN):
        end = min(steps, begin + BLOCK // DOWN)
        lo, hi = begin * DOWN - TAPS // 2, (end - 1) * DOWN + TAPS // 2 + 2
        part = np.zeros(hi - lo, np.float32)
        a, b = max(0, lo), min(n, hi)
        part[a - lo : b - lo] = (x[a:b].astype(np.float32) - 128) / 128
        windows = np.lib.stride_tricks.sliding_window_view(part, TAPS)
        count = end - begin
        out[begin * UP : end * UP : UP] = windows[: count * DOWN : DOWN] @ _phases()[:, 0]
        out[begin * UP + 1 : end * UP : UP] = windows[1 : count * DOWN + 1 : DOWN] @ _phases()[:, 1]
    return out


def log_mel(signal: np.ndarray) -> np.ndarray:
    """(frames, MELS) of overlapped frames; a signal under a frame is padded to one."""
    if len(signal) < FRAME:
        signal = np.pad(signal, (0, FRAME - len(signal)))
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    out = np.empty((len(frames), MELS), np.float32)
    for i in range(0, len(frames), 512):
        spectrum = np.fft.rfft(frames[i : i + 512] * _hann)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[i : i + 512] = np.log(power @ _mel() + 1e-6)
    return out


def active(mels: np.ndarray) -> np.ndarray:
    """Frames in a segment: one begins where the energy reaches the upper threshold and lasts until it is under the lower."""
    energy = mels.mean(1)
    mean, deviation = energy.mean(), energy.std()
    rise, fall = energy >= mean + RISE * deviation, energy < mean + FALL * deviation
    last = np.maximum.accumulate(np.where(rise | fall, np.arange(len(energy)), -1))
    return (last >= 0) & rise[last]


def spans(on: np.ndarray) -> list[tuple[float, float]]:
    """(begin, end) in seconds of each segment."""
    edge = np.diff(np.concatenate(([0], on.astype(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(b * HOP / RATE, ((e - 1) * HOP + FRAME) / RATE) for b, e in zip(begin.tolist(), end.tolist(), strict=True)]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): each text's UTF-8 bytes, padded, as a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                raw = [b or b"" for b in part.column(1).cast(pa.binary()).to_pylist()]
                media = pa.array([wav(padded(b)) for b in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(b) for b in raw], pa.int64()), media], names=[id_col, "n_bytes", "media"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return mapped(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_bytes long, media binary")


def tensor_table(payload: bytes) -> pa.Table:
    """(begin_s, end_s, frames, active_frames, log_mel) of a payload, a row a block: log_mel is a tensor of SHAPE, the last one padded with zeros."""
    mels = log_mel(resampled(payload))
    on = active(mels)
    size, n = SHAPE[0], -(-len(mels) // SHAPE[0])
    cut = np.zeros((n * size, MELS), np.float16)
    cut[: len(mels)] = mels
    begin = np.arange(n) * size
    end = np.minimum(begin + size, len(mels))
    flags = np.concatenate((on, np.zeros(n * size - len(on), bool))).reshape(n, size)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(cut.ravel()), SHAPE[0] * SHAPE[1])
    columns = {
        "begin_s": pa.array(begin * HOP / RATE),
        "end_s": pa.array(((end - 1) * HOP + FRAME) / RATE),
        "frames": pa.array(end - begin, pa.int32()),
        "active_frames": pa.array(flags.sum(1), pa.int32()),
        "log_mel": pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float16(), SHAPE), storage),
    }
    spanned = spans(on)
    return pa.table(columns).replace_schema_metadata({"spans": repr(spanned)})


def stored_tensors(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def read_tensors(raw: bytes) -> pa.Table:
    with pa.ipc.open_stream(raw) as stream:
        return stream.read_all()


def summary(table: pa.Table) -> str:
    """frames, mean log-mel of each band in quarters, active frames, and digests of tensors and of time spans, as one string."""
    mels = np.concatenate([x.storage.flatten().to_numpy(zero_copy_only=False) for x in table.column("log_mel").chunks]).reshape(-1, MELS)
    frames = int(sum(table.column("frames").to_pylist()))
    levels = ",".join(str(int(v)) for v in np.rint(mels[:frames].mean(0, dtype=np.float64) * 4))
    times = repr((table.column("begin_s").to_pylist(), table.column("end_s").to_pylist(), table.schema.metadata[b"spans"]))
    digest = lambda b: hashlib.md5(b).hexdigest()[:16]
    return f"frames={frames};mel={levels};active={sum(table.column('active_frames').to_pylist())};tensors={digest(mels.tobytes())};spans={digest(times.encode())}"


def store_features(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of the column media of encode() and of the payload read back from it, and its tensors as an Arrow IPC stream in column tensors."""
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tensors"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part, rows = batch.slice(i, 64), []
                for n, media in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                    media = media.as_py()
                    payload = samples(media)
                    rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), stored_tensors(tensor_table(payload))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return mapped(df.select(id_col, "n_bytes", "media"), run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors binary")


def digest_media(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """store_features() of column media, written to the shared folder, with the tensors read back from there as a summary in column feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                features = [summary(read_tensors(x)) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(features, pa.string())], names=[*part.schema.names[:-1], "feature"])

    kept = written(store_features(df, id_col), "media")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1])
    return mapped(kept, run, f"{columns}, feature string")
