"""F0 detectors over frames of samples, many frames a call."""
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

RATE = 48000
#: Threshold of the difference detector, trust in each detector.
DIP, TRUST = 0.18, {"yin": 1.0, "nacf": 0.85}


def _correlate(x):
    n = x.shape[1]
    spectrum = np.fft.rfft(x, 1 << (2 * n - 1).bit_length(), axis=1)
    return np.fft.irfft(np.abs(spectrum) ** 2, axis=1)[:, :n]


def _energies(x, lags):
    """Energy of each frame without its last, and without its first `lags` samples."""
    run = np.pad(np.cumsum(x ** 2, axis=1), ((0, 0), (1, 0)))
    return run[:, x.shape[1] - lags], run[:, -1:] - run[:, lags]


def _vertex(values, at):
    """Positions refined by the parabola through the neighbours."""
    rows, inner = np.arange(len(values)), (at > 0) & (at < values.shape[1] - 1)
    i = np.clip(at, 1, values.shape[1] - 2)
    a, b, c = (values[rows, i + k] for k in (-1, 0, 1))
    bend = a - 2 * b + c
    return at + np.where(inner & (np.abs(bend) > 1e-12), 0.5 * (a - c) / np.where(bend == 0, 1, bend), 0)


def yin(x: np.ndarray, low: int, high: int):
    """(lag, confidence) per frame: the first dip of the cumulative mean normalised difference, else its least."""
    lags = np.arange(1, high + 1)
    head, tail = _energies(x, lags)
    d = np.maximum(head + tail - 2 * _correlate(x)[:, lags], 0)
    d = np.pad(d * lags / np.maximum(np.cumsum(d, axis=1), 1e-12), ((0, 0), (1, 0)), constant_values=1.0)
    mid = d[:, low:high]
    dip = (mid < DIP) & (mid <= d[:, low - 1:high - 1]) & (mid <= d[:, low + 1:])
    at = low + np.where(dip.any(1), dip.argmax(1), d[:, low:].argmin(1))
    lag = _vertex(d, at)
    return np.where(lag > 0, lag, at), np.clip(1 - d[np.arange(len(d)), at], 0, 1)


def nacf(x: np.ndarray, low: int, high: int):
    """(lag, confidence) per frame: of the normalised autocorrelation's peaks within 2 % of the highest, the longest lag."""
    x = x * np.hanning(x.shape[1])
    lags = np.arange(low, high + 1)
    head, tail = _energies(x, lags)
    r = np.clip(_correlate(x)[:, lags] / np.sqrt(np.maximum(head * tail, 1e-12)), -1, 1)
    peak = np.zeros(r.shape, bool)
    peak[:, 1:-1] = (r[:, 1:-1] >= r[:, :-2]) & (r[:, 1:-1] >= r[:, 2:])
    top = np.where(peak, r, -2).max(1, keepdims=True)
    near = peak & (r >= np.maximum(0.2, top * 0.98))
    last = r.shape[1] - 1 - near[:, ::-1].argmax(1)
    at = np.where(near.any(1), last, np.where(peak.any(1), np.where(peak, r, -2).argmax(1), r.argmax(1)))
    lag = _vertex(r, at) + low
    return np.where(lag > 0, lag, lags[at]), np.clip(r[np.arange(len(r)), at], 0, 1)


def observe(frames: DataFrame, low_hz: float = 55.0, high_hz: float = 1760.0, floor: float = 1e-4, key: str = "path") -> DataFrame:
    """(key, idx, detector, hz, confidence, voiced_probability, reliability, rms) of both detectors per frame (key, idx, samples), for melody.fuse().

    A frame below the energy floor, null, empty or not finite has no pitch. Frames are independent; they need no order and no shuffle.
    """
    full = StructType([frames.schema[key], *StructType.fromDDL("idx long, detector string, hz double, confidence double, voiced_probability double, reliability double, rms double").fields])
    arrow = to_arrow_schema(full)

    def part(t, n):
        x = t.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, n)
        x = x - x.mean(1, keepdims=True)
        rms = np.sqrt((x ** 2).mean(1))
        low, high = max(2, int(RATE // high_hz)), min(n - 2, int(np.ceil(RATE / low_hz)))
        heard = np.isfinite(rms) & (rms >= floor)
        for name, detect in (("yin", yin), ("nacf", nacf)):
            hz, sure = np.full(len(x), np.nan), np.zeros(len(x))
            if heard.any():
                lag, sure[heard] = detect(x[heard], low, high)
                hz[heard] = RATE / lag
            voiced = np.where(heard, sure * np.clip(rms / (floor * 4), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array([name] * len(x)), pa.array(hz, from_pandas=True), pa.array(sure), pa.array(voiced), pa.array(np.full(len(x), TRUST[name])), pa.array(rms, from_pandas=True)], schema=arrow)

    def run(batches):
        for b in batches:
            sizes = pc.list_value_length(b.column(2)).fill_null(0).to_numpy(zero_copy_only=False)
            # Some lags must fit; shorter frames are silent.
            for n in np.unique(sizes):
                rows = pa.array(np.flatnonzero(sizes == n))
                for at in range(0, len(rows), 128):
                    t = b.take(rows.slice(at, 128))
                    if n < RATE / high_hz + 4:
                        t, k = t.set_column(2, "samples", pa.array([[0.0] * 64] * t.num_rows, pa.list_(pa.float64()))), 64
                    else:
                        k = int(n)
                    yield from part(t, k)

    return frames.select(key, frames.idx.cast("long").alias("idx"), "samples").mapInArrow(run, full)
