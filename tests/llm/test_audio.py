import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import audio


def test_resampling_keeps_tones_and_levels():
    t = np.arange(8000) / 8000
    x = np.sin(2 * np.pi * 440 * t).astype(np.float32)
    y = audio.resample(x)
    assert len(y) == 6000
    assert np.argmax(np.abs(np.fft.rfft(y))) == 440
    assert np.abs(y[100:-100]).max() == pytest.approx(1, abs=0.02)
    assert audio.resample(np.ones(640, np.float32))[20:-20] == pytest.approx(1, abs=1e-5)
    high = np.sin(2 * np.pi * 3900 * t).astype(np.float32)  # above the new Nyquist frequency
    assert np.abs(audio.resample(high)[100:-100]).max() < 0.2


def brute_resample(x, up, down, taps):
    filt = audio._phases(up, down, taps)
    out = []
    for i in range(len(x) * up // down):
        first, phase = divmod(i * down, up)
        acc = 0.0
        for k in range(taps):
            at = first + k - taps // 2
            acc += (x[at] if 0 <= at < len(x) else 0.0) * filt[phase][k]
        out.append(acc)
    return out


def test_polyphase_equals_direct_form():
    x = np.random.default_rng(0).normal(size=97).astype(np.float32)
    for up, down in ((3, 4), (1, 2), (5, 3), (2, 2)):
        assert audio.resample(x, up, down) == pytest.approx(brute_resample(x, up, down, audio.TAPS), abs=1e-5)


def test_log_mel_equals_one_frame_at_a_time(monkeypatch):
    x = np.random.default_rng(1).normal(size=3000).astype(np.float32)
    mel, level = audio.log_mel(x, 6000)
    for i in (0, 7, len(mel) - 1):
        frame = x[i * audio.HOP : i * audio.HOP + audio.FRAME]
        w = np.hanning(audio.FRAME + 1)[:-1]
        power = np.abs(np.fft.rfft(frame * w)) ** 2 / (w**2).sum()
        assert mel[i] == pytest.approx(10 * np.log10(power @ audio._mel_bank(6000, audio.FRAME, audio.MELS)), abs=1e-3)
        assert level[i] == pytest.approx(10 * np.log10((frame**2).mean()), abs=1e-3)
    monkeypatch.setattr(audio, "RUN", 3)
    assert audio.log_mel(x, 6000)[0] == pytest.approx(mel, abs=1e-4)


def test_hysteresis():
    level = np.array([-20, -5, -9, -9, -20, -9, -5, -9.0])
    assert audio.hysteresis(level).tolist() == [[1, 4], [6, 8]]
    assert audio.hysteresis(np.array([-9.0])).tolist() == []


def test_rows(docs, corpus, empty):
    clash = docs.withColumns({"media": F.lit(1), "n_bytes": F.lit("x")})
    rows = audio.audio_features(clash).collect()
    assert sorted(r.n_bytes for r in rows) == sorted(len((r[1] or "").encode()) for r in corpus)
    seen = {}
    for r in rows:
        payload = audio.decode_wave(bytes(r.media))
        assert len(payload) % 64 == 0 and len(payload) >= max(64, r.n_bytes) and not any(payload[r.n_bytes :])
        value = (bytes(r.patches), r.segments)
        assert seen.setdefault(payload, value) == value
        table = pa.ipc.open_stream(bytes(r.patches)).read_all()
        assert table.schema.field("mel").type == pa.fixed_shape_tensor(pa.float32(), (audio.PATCH, audio.MELS))
        mel, span = audio.read_patches(bytes(r.patches))
        assert mel.shape == (len(span), audio.PATCH, audio.MELS) and (span[:, 0] < span[:, 1]).all()
        assert audio.store_patches(mel, span) == bytes(r.patches)
        assert all(a.end > a.start for a in r.segments)
    assert audio.audio_features(empty).collect() == []


def test_query(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in audio.query(spark, sf_dir).collect():
        payload = texts[r.doc_id] + bytes(-len(texts[r.doc_id]) % 64 if texts[r.doc_id] else 64)
        assert (r.payload_bytes, r.payload_sha256) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.n_bytes == len(texts[r.doc_id])
        media = audio.encode_wave(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_frames_cover_the_tail():
    quiet = bytes([128]) * 384
    loud = quiet[:354] + bytes([255, 0]) * 15
    (a, span, none), (b, _, some) = (audio.features(audio.encode_wave(x)) for x in (quiet, loud))
    assert span[-1, 1] * audio.RATE * audio.UP / audio.DOWN >= 288
    assert not np.array_equal(a, b)


def brute_features(payload):
    """Patches, spans and segments of a payload, one frame at a time in double precision."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    y = brute_resample(x, audio.UP, audio.DOWN, audio.TAPS)
    frames = max(1, -(-(len(y) - audio.FRAME) // audio.HOP) + 1)
    y = np.append(y, np.zeros((frames - 1) * audio.HOP + audio.FRAME - len(y)))
    rate, window = audio.RATE * audio.UP / audio.DOWN, np.hanning(audio.FRAME + 1)[:-1]
    bank = audio._mel_bank(rate, audio.FRAME, audio.MELS)
    mel, active, segments, start = [], False, [], None
    for i in range(frames):
        frame = y[i * audio.HOP : i * audio.HOP + audio.FRAME]
        power = np.abs(np.fft.rfft(frame * window)) ** 2 / (window**2).sum()
        mel.append(10 * np.log10(np.maximum(power @ bank, 1e-8)))
        level = 10 * np.log10(max((frame**2).mean(), 1e-8))
        now = level > audio.ON_DB or (active and level >= audio.OFF_DB)
        if now and not active:
            start = i
        if active and not now:
            segments.append((start * audio.HOP / rate, ((i - 1) * audio.HOP + audio.FRAME) / rate))
        active = now
    if active:
        segments.append((start * audio.HOP / rate, ((frames - 1) * audio.HOP + audio.FRAME) / rate))
    n = -(-frames // audio.PATCH)
    mel += [[audio.FLOOR_DB] * audio.MELS] * (n * audio.PATCH - frames)
    spans = [(p * audio.PATCH * audio.HOP / rate, (min((p + 1) * audio.PATCH, frames) - 1) * audio.HOP / rate + audio.FRAME / rate) for p in range(n)]
    return np.array(mel).reshape(n, audio.PATCH, audio.MELS), np.array(spans), segments


def test_query_features_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 3000 or text is null")
    stored = {r.doc_id: r for r in audio.audio_features(docs).collect()}
    got = {r.doc_id: r.feature for r in audio.query(spark, sf_dir).collect()}
    for r in docs.limit(60).collect():
        text = (r.text or "").encode()
        patches, spans, segments = brute_features(text + bytes(-len(text) % 64 if text else 64))
        mel, span = audio.read_patches(bytes(stored[r.doc_id].patches))
        assert mel == pytest.approx(patches, abs=0.02) and span == pytest.approx(spans)
        found = [t for x in stored[r.doc_id].segments for t in x]
        assert found == pytest.approx([t for x in segments for t in x])
        named = dict(x.split("=") for x in got[r.doc_id].split(";"))
        assert (int(named["patches"]), int(named["segments"])) == (len(patches), len(segments))
        assert float(named["active"]) == pytest.approx(sum(b - a for a, b in segments), abs=1e-3)
        assert float(named["mean"]) == pytest.approx(patches.mean(), abs=0.1)
        assert named["mel"] == f"{zlib.crc32(np.rint(mel * 8).astype(np.int16).tobytes()):08x}"


def test_very_long_text(spark):
    text = "long text with sound in it " * 60_000
    r = audio.audio_features(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert audio.decode_wave(bytes(r.media)).startswith(text.encode()) and len(audio.read_patches(bytes(r.patches))[1]) > 500
