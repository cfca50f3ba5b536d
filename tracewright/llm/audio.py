"""Audio columns: 8-bit WAV payloads, resampled log-mel tensors and energy segments.

A payload of bytes is stored losslessly as unsigned 8-bit mono samples in a RIFF
WAVE file.  Features are computed from the file read back:

* *Resampling* by ``up/down`` with a windowed-sinc filter in polyphase form: each
  of the ``up`` phases is a strided window of the input times its own taps, so no
  zero is ever inserted or multiplied.
* *Log-mel* energies of overlapped Hann frames, the last one filled with zeros, cut into patches of ``patch``
  frames (the last padded with the floor value).  A document's patches are stored
  as an Arrow stream of one table whose column ``mel`` has Arrow's fixed-shape
  tensor type (``patch x mels`` floats) beside the time span of each patch; a
  Spark column itself cannot have that type.  ``read_patches`` gives them back.
* *Segments* by hysteresis: one opens where the frame level rises above ``on`` and
  closes where it falls below ``off`` decibels relative to full scale.

Rows are independent, so hot groups, ties and repeated rows do not matter, and
equal payloads give equal values.  Frames are computed in runs of ``RUN``, which
bounds the temporaries of a very long payload.

Nulls: a null text is an empty payload, that is 64 zero bytes.  Null ids pass
through.  An empty table gives no rows; further columns, whatever their names,
are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textblocks import blocks, utf8_buffers

RATE, UP, DOWN, TAPS = 8000, 3, 4, 16
FRAME, HOP, MELS, PATCH, RUN = 256, 128, 24, 16, 4096
ON_DB, OFF_DB, FLOOR_DB = -8.5, -9.5, -80.0
UNIT = 64


def encode_wave(payload: bytes, rate: int = RATE) -> bytes:
    """A WAVE file whose samples are the payload's bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(payload)
    return out.getvalue()


def decode_wave(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as f:
        return f.readframes(f.getnframes())


@cache
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """The low-pass filter's taps by phase (up x taps), each phase of unit sum."""
    t = np.arange(up * taps) - (up * taps - 1) / 2
    low = np.sinc(t / max(up, down)) * np.hanning(up * taps + 2)[1:-1]
    phases = low.reshape(taps, up).T[:, ::-1]
    return np.ascontiguousarray(phases / phases.sum(axis=1, keepdims=True), np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """``x`` at ``up/down`` of its rate."""
    n = len(x) * up // down
    out = np.empty(n, np.float32)
    padded = np.concatenate([np.zeros(taps // 2, np.float32), x, np.zeros(taps + down, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    for r in range(up):  # outputs r, r + up, ... share a phase and step by ``down`` inputs
        count = len(range(r, n, up))
        first, phase = divmod(r * down, up)
        out[r::up] = windows[first : first + count * down : down][:count] @ _phases(up, down, taps)[phase]
    return out


@cache
def _mel_bank(rate: float, frame: int, mels: int) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale (frequencies x mels)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel decibels (frames x mels) and frame levels; at least one frame."""
    window = np.hanning(FRAME + 1)[:-1].astype(np.float32)
    if len(x) < FRAME:
        x = np.concatenate([x, np.zeros(FRAME - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    mel = np.empty((len(frames), MELS), np.float32)
    level = np.empty(len(frames), np.float32)
    bank = _mel_bank(rate, FRAME, MELS)
    least = np.float32(10 ** (FLOOR_DB / 10))
    for i in range(0, len(frames), RUN):
        part = frames[i : i + RUN]
        spectrum = np.fft.rfft(part * window, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) / np.float32((window**2).sum())
        mel[i : i + RUN] = 10 * np.log10(np.maximum(power @ bank, least))
        level[i : i + RUN] = 10 * np.log10(np.maximum((part**2).mean(axis=1), least))
    return mel, level


def hysteresis(level: np.ndarray, on: float = ON_DB, off: float = OFF_DB) -> np.ndarray:
    """Runs of frames [start, end) that are active."""
    event = np.where(level > on, 1, np.where(level < off, 0, -1))
    known = np.maximum.accumulate(np.where(event >= 0, np.arange(len(level)), -1))
    active = (known >= 0) & (event[known] == 1)
    return np.flatnonzero(np.diff(np.concatenate(([False], active, [False])))).reshape(-1, 2)


def payload_of(text: bytes, unit: int = UNIT) -> bytes:
    return text + bytes(-len(text) % unit if text else unit)


def features(media: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[float, float]]]:
    """Patches (n x patch x mels), their time spans (n x 2) and segments, in seconds."""
    with wave.open(io.BytesIO(media)) as f:
        rate, raw = f.getframerate(), f.readframes(f.getnframes())
    x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    low = rate * UP / DOWN
    y = resample(x)
    y = np.concatenate([y, np.zeros(max(FRAME - len(y), (FRAME - len(y)) % HOP), np.float32)])  # the last frame covers the tail
    mel, level = log_mel(y, low)
    n = -(-len(mel) // PATCH)
    patches = np.full((n * PATCH, MELS), FLOOR_DB, np.float32)
    patches[: len(mel)] = mel
    first = np.arange(n) * PATCH
    last = np.minimum(first + PATCH, len(mel)) - 1
    spans = np.stack([first * HOP / low, (last * HOP + FRAME) / low], axis=1)
    segments = [(a * HOP / low, ((b - 1) * HOP + FRAME) / low) for a, b in hysteresis(level)]
    return patches.reshape(n, PATCH, MELS), spans, segments


TENSOR = pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS))
PATCHES = pa.schema([("start", pa.float64()), ("end", pa.float64()), ("mel", TENSOR)])
SCHEMA = "n_bytes long, media binary, patches binary, segments array<struct<start:double,end:double>>"


def store_patches(patches: np.ndarray, spans: np.ndarray) -> bytes:
    """Patches (n x patch x mels) and their time spans (n x 2) as an Arrow stream."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(patches.ravel()), PATCH * MELS)
    columns = [pa.array(spans[:, 0]), pa.array(spans[:, 1]), pa.ExtensionArray.from_storage(TENSOR, flat)]
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, PATCHES) as stream:
        stream.write_batch(pa.record_batch(columns, schema=PATCHES))
    return out.getvalue().to_pybytes()


def read_patches(stored: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What ``store_patches`` was given."""
    table = pa.ipc.open_stream(stored).read_all().combine_chunks()
    spans = np.stack([table.column(c).to_numpy() for c in ("start", "end")], axis=1)
    return table.column("mel").chunk(0).to_numpy_ndarray(), spans


def _media(batches):
    for block in blocks(batches):
        data, offsets = utf8_buffers(block.column(block.schema.get_field_index("text")))
        raw = data.tobytes()
        n_bytes, media, patches, segments, counts = [], [], [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            stored = encode_wave(payload_of(raw[a:b]))
            mel, span, segment = features(stored)
            n_bytes.append(b - a)
            media.append(stored)
            patches.append(store_patches(mel, span))
            segments += segment
            counts.append(len(segment))
        pairs = np.array(segments, np.float64).reshape(-1, 2)
        segment = pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["start", "end"])
        yield pa.record_batch(
            [
                block.column(block.schema.get_field_index("doc_id")),
                pa.array(n_bytes, pa.int64()),
                pa.array(media, pa.binary()),
                pa.array(patches, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), segment),
            ],
            ["doc_id", "n_bytes", "media", "patches", "segments"],
        )


def audio_features(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media, patches, segments`` for each row of ``docs(doc_id, text)``."""
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(_media, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def _digests(batches):
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            media = batch.column(2)[i].as_py()
            payload = decode_wave(media)
            patches, _ = read_patches(batch.column(3)[i].as_py())
            segments = batch.column(4)[i].values
            mel = np.rint(patches * 8).astype(np.int16)
            active = float((np.asarray(segments.field("end")) - np.asarray(segments.field("start"))).sum())
            feature = f"patches={len(patches)};segments={len(segments)};active={active:.3f};mean={mel.mean() / 8:.2f};mel={zlib.crc32(mel.tobytes()):08x}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        out = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.record_batch(
            [batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return audio_features(docs).mapInArrow(
        _digests,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
