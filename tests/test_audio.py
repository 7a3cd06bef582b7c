"""WAV files, detectors and overlap-add against built signals and direct sums."""
import struct

import numpy as np
import pytest
from pyspark.sql import SparkSession, functions as F

from cantata.operators import audio, melody, pitch
from cantata.sources import wav


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _wav(x, kind=3, rate=48000, bits=32, extra=b""):
    x = np.asarray(x, "<f4")
    fmt = struct.pack("<HHIIHH", kind, x.shape[1], rate, rate * 4 * x.shape[1], 4 * x.shape[1], bits)
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt + extra + b"data" + struct.pack("<I", x.nbytes) + x.tobytes()
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


def _files(spark, files):
    return spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in files.items()], "path string, content binary")


def _stereo(hz, seconds=0.25, gain=0.5):
    t = np.arange(int(48000 * seconds)) / 48000
    return np.repeat(gain * np.sin(2 * np.pi * hz * t)[:, None], 2, 1)


def test_scan(spark):
    good = _stereo(220)
    bad = good.copy()
    bad[7, 1] = np.nan
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    files = {
        "good": _wav(good), "nan": _wav(bad), "mono": _wav(good[:, :1]), "rate": _wav(good, rate=44100), "pcm": _wav(good, kind=1), "cut": _wav(good)[:-1], "none": None, "empty": b"",
        "odd": _wav(good, extra=odd), "twice": _wav(good, extra=b"data" + struct.pack("<I", 8) + bytes(8)), "nothing": _wav(good[:0]), "long": _wav(good, extra=b"junk" + struct.pack("<I", 1 << 30)),
    }
    got = {r.path: r for r in wav.scan(_files(spark, files), len(good)).collect()}
    assert {k: r.status for k, r in got.items()} == {
        "good": "ok", "odd": "ok", "nan": "not finite", "mono": "not 48 kHz float", "rate": "not 48 kHz float", "pcm": "not 48 kHz float", "cut": "truncated container",
        "none": "not a WAV file", "empty": "not a WAV file", "twice": "several data chunks", "nothing": "bad number of samples", "long": "chunk beyond the container",
    }
    assert got["good"].peak == pytest.approx(0.5, abs=1e-3) and got["good"].duration_samples == 12000
    assert wav.scan(_files(spark, {"good": _wav(good)}), 5).first().status == "other length"


def test_frames_pad_the_tail_and_flee_cancelled_channels(spark):
    x = np.arange(1, 3001)[:, None] / 4000
    against = np.hstack([x, -x])
    got = {(r.path, r.idx): r for r in wav.frames(_files(spark, {"mono": _wav(x), "against": _wav(against), "bad": b"x"})).collect()}
    assert len(got) == 14
    r = got["mono", 6]
    assert (r.start_sample, r.end_sample, r.fallback) == (2880, 3000, False) and len(r.samples) == 1920
    assert r.samples[:120] == pytest.approx(list(x[2880:, 0]), abs=1e-6) and set(r.samples[120:]) == {0.0}
    assert got["against", 0].fallback and got["against", 0].samples == pytest.approx(list(x[:1920, 0]), abs=1e-6)


def test_many_frames_go_through_blocks_alike(spark):
    x = np.random.default_rng(1).normal(size=(480 * 300, 2)).astype("f4")
    got = wav.frames(_files(spark, {"a": _wav(x)})).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(300))
    for i in (0, 255, 256, 290):
        assert got[i].samples == pytest.approx(list(x[i * 480:i * 480 + 1920].astype(float).mean(1)))


def test_tones_are_found(spark):
    tones = np.geomspace(70, 1000, 24)
    files = {f"{hz}": _wav(_stereo(hz, 0.06)) for hz in tones} | {"silent": _wav(np.zeros((2880, 2)))}
    seen = pitch.observe(wav.frames(_files(spark, files)).where("idx = 0"))
    fused = {r.path: r for r in melody.fuse(seen, key="path").collect()}
    errors = [abs(1200 * np.log2(fused[f"{hz}"].f0_hz / hz)) for hz in tones]
    assert np.median(errors) <= 5 and max(errors) < 30 and fused["silent"].f0_hz is None
    assert seen.count() == 50 and seen.where("path = 'silent' and (hz is not null or voiced_probability > 0)").count() == 0


def _slow_yin(x, low, high):
    d = np.array([((x[:len(x) - k] - x[k:]) ** 2).sum() if k else 0 for k in range(high + 1)])
    c = [1.0] + [d[k] * k / d[1:k + 1].sum() for k in range(1, high + 1)]
    dips = [k for k in range(low, high) if c[k] < 0.18 and c[k] <= c[k - 1] and c[k] <= c[k + 1]]
    k = dips[0] if dips else low + int(np.argmin(c[low:]))
    return k, 1 - c[k]


def test_yin_equals_the_direct_sum():
    rng = np.random.default_rng(2)
    t = np.arange(600)
    x = np.array([np.sin(2 * np.pi * t / p) + 0.3 * rng.normal(size=600) * n for p in (31, 77.3, 140) for n in (0, 1)])
    x -= x.mean(1, keepdims=True)
    lag, sure = pitch.yin(x, 20, 300)
    for i in range(len(x)):
        k, s = _slow_yin(x[i], 20, 300)
        assert abs(lag[i] - k) <= 1 and sure[i] == pytest.approx(min(1, max(0, s)), abs=1e-9)


def test_frames_without_samples(spark):
    rows = [("a", 0, None), ("a", 1, []), ("a", 2, [0.5]), ("a", 3, [float("nan")] * 1920), ("a", 4, [1.0] * 1920)]
    got = pitch.observe(spark.createDataFrame(rows, "path string, idx long, samples array<double>")).collect()
    assert len(got) == 10 and all(r.hz is None and r.confidence == 0 for r in got)


def test_events(spark):
    quiet, loud = _stereo(300, 0.1, 0.01), _stereo(900, 0.1, 0.6)
    got = wav.events(_files(spark, {"a": _wav(np.vstack([quiet, loud])), "silent": _wav(np.zeros((4800, 2)))})).orderBy("path", "idx").collect()
    a = [r for r in got if r.path == "a"]
    assert len(a) == 20 and a[0].spectral_flux == 0 and 6 <= max(a, key=lambda r: r.onset).idx <= 10
    assert all(r.onset == 0 and r.energy == 0 for r in got if r.path == "silent")
    x = np.vstack([quiet, loud]).astype("f4").astype(float).mean(1)
    s = [np.abs(np.fft.rfft(x[i * 480:i * 480 + 1920] * np.hanning(1920))) for i in range(17)]
    s = [v / v.sum() for v in s]
    flux = [0.0] + [float(np.sqrt((np.maximum(b - a, 0) ** 2).mean())) for a, b in zip(s, s[1:])]
    ratio = [r.spectral_flux / f for r, f in zip(a, flux) if 1e-12 < f and r.spectral_flux < 1]
    assert ratio == pytest.approx([ratio[0]] * len(ratio))


def test_overlap_add(spark):
    rng = np.random.default_rng(4)
    total, size, fade, hop = 1000, 300, 60, 240
    chunks = [("a", s, total, list(map(float, rng.normal(size=min(size, total - s))))) for s in range(0, total, hop)] + [("b", 0, 70, [1.0] * 50), ("b", 60, 70, None)]
    got = {(r.path, r.block): r.samples for r in audio.overlap_add(spark.createDataFrame(chunks, "path string, start long, total long, samples array<double>"), fade, 128).collect()}
    sums, weights = np.zeros(total), np.zeros(total)
    for _, s, _, x in chunks[:-2]:
        for i, v in enumerate(x):
            w = (min(1, (i + 1) / (min(fade, len(x)) + 1)) if s else 1) * (min(1, (len(x) - i) / (min(fade, len(x)) + 1)) if s + len(x) < total else 1)
            sums[s + i] += v * w
            weights[s + i] += w
    mine = np.concatenate([got["a", n] for n in range(8)])
    assert len(mine) == total and mine == pytest.approx(sums / weights, abs=1e-5)
    assert got["b", 0] == [1.0] * 50 + [None] * 20
    assert audio.overlap_add(spark.createDataFrame([], "path string, start long, total long, samples array<double>"), fade).count() == 0
