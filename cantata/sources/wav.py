"""WAV files of 48 kHz float samples: header, content and frames of a hop of 480 samples.

A file is one row of a binary column, as spark.read.format("binaryFile") gives
it; half an hour of stereo is the most it may hold, 691 MB. Frames leave a task
in small batches; set spark.sql.execution.arrow.maxRecordsPerBatch to a few
files where they are long.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

RATE, HOP, WINDOW, LONGEST = 48000, 480, 1920, 30 * 60 * 48000
#: Fixed value: the sub-format of IEEE floats in an extensible header.
_FLOAT = bytes([3, 0, 0, 0, 0, 0, 0x10, 0, 0x80, 0, 0, 0xAA, 0, 0x38, 0x9B, 0x71])


class BadAudio(ValueError):
    pass


def _chunks(data):
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise BadAudio("not a WAV file")
    end, at = 8 + int.from_bytes(data[4:8], "little"), 12
    if end > len(data):
        raise BadAudio("truncated container")
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4:at + 8], "little")
        if at + 8 + size + size % 2 > end:
            raise BadAudio("chunk beyond the container")
        yield data[at:at + 4], at + 8, size
        at += 8 + size + size % 2


def read(data: bytes, channels: tuple = (2,)) -> np.ndarray:
    """Samples (n, channels) as a view of the bytes; raises BadAudio."""
    width, body = None, None
    for tag, at, size in _chunks(data):
        if tag == b"fmt ":
            if not 16 <= size <= 4096:
                raise BadAudio("bad format chunk")
            kind, wide, rate, _, align, bits = np.frombuffer(data, "<u2,<u2,<u4,<u4,<u2,<u2", 1, at)[0].item()
            floats = kind == 3 or (kind == 0xFFFE and size >= 40 and data[at + 24:at + 40] == _FLOAT)
            width = wide if floats and (rate, align, bits) == (RATE, 4 * wide, 32) and wide in channels else None
        elif tag == b"data":
            if body:
                raise BadAudio("several data chunks")
            body = at, size
    if not width:
        raise BadAudio("not 48 kHz float")
    if not body:
        raise BadAudio("no data")
    if not body[1] or body[1] % (4 * width):
        raise BadAudio("bad number of samples")
    if body[1] > 4 * width * LONGEST:
        raise BadAudio("too long")
    return np.frombuffer(data, "<f4", body[1] // 4, body[0]).reshape(-1, width)


def _mapped(files, key, col, schema, rows):
    full = StructType([files.schema[key], *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(full)

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                for columns in rows(data.as_py() or b""):
                    arrays = [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(arrays[0]), arrow.field(0).type), *arrays], schema=arrow)

    return files.select(key, col).mapInArrow(run, full)


def scan(files: DataFrame, expected: int | None = None, key: str = "path", col: str = "content") -> DataFrame:
    """(key, duration_samples, peak, status) per file: "ok", or what its header or content breaks; every sample must be finite, and the length `expected` where given."""

    def rows(data):
        try:
            x = read(data)
        except BadAudio as e:
            yield [None], [None], [str(e)]
            return
        status = "ok" if expected in (None, len(x)) else "other length"
        if not np.isfinite(x).all():
            yield [len(x)], [None], ["not finite"]
        else:
            yield [len(x)], [float(np.abs(x).max())], [status]

    return _mapped(files, key, col, "duration_samples long, peak double, status string", rows)


def _blocks(x, floor, size=256):
    """Blocks of frames as (first index, mono frames (n, WINDOW), fell back); the tail is padded with zeros.

    A stereo frame whose channels cancel out takes the louder channel.
    """
    count = -(-len(x) // HOP)
    for first in range(0, count, size):
        n = min(size, count - first)
        part = x[first * HOP:(first + n - 1) * HOP + WINDOW].astype(float)
        held = np.minimum(WINDOW, len(x) - np.arange(first, first + n) * HOP)
        padded = np.zeros(((n - 1) * HOP + WINDOW, x.shape[1]))
        padded[:len(part)] = part
        frames = np.lib.stride_tricks.sliding_window_view(padded, WINDOW, axis=0)[::HOP]
        mono = frames.mean(1)
        loud = np.sqrt((frames ** 2).sum(2) / held[:, None])
        quiet = np.sqrt((mono ** 2).sum(1) / held)
        out = (x.shape[1] == 2) & (loud.max(1) > floor) & (quiet < loud.max(1) * 0.1)
        yield first, np.where(out[:, None], np.take_along_axis(frames, loud.argmax(1)[:, None, None], 1)[:, 0], mono), out


def frames(files: DataFrame, floor: float = 1e-4, key: str = "path", col: str = "content") -> DataFrame:
    """(key, idx, start_sample, end_sample, fallback, samples) per hop of each readable file of one or two channels, 1,920 samples a frame; files that scan() rejects give no rows."""

    def rows(data):
        try:
            x = read(data, (1, 2))
        except BadAudio:
            return
        if not np.isfinite(x).all():
            return
        for first, mono, out in _blocks(x, floor):
            idx = np.arange(first, first + len(mono))
            yield idx, idx * HOP, np.minimum(idx * HOP + WINDOW, len(x)), out, pa.ListArray.from_arrays(pa.array(np.arange(len(mono) + 1) * WINDOW, pa.int32()), mono.ravel())

    return _mapped(files, key, col, "idx long, start_sample long, end_sample long, fallback boolean, samples array<double>", rows)


def events(files: DataFrame, key: str = "path", col: str = "content") -> DataFrame:
    """(key, idx, fallback, rms, energy, spectral_flux, energy_rise, energy_delta, onset) per frame.

    Flux is the root mean square of what a spectrum of unit sum gained since the
    frame before. Strengths are divided by the 95th percentile of the file's
    positive values and cut at one; the onset mixes flux and rise, 0.65 to 0.35.
    """
    window = np.hanning(WINDOW)

    def rows(data):
        try:
            x = read(data, (1, 2))
        except BadAudio:
            return
        if not np.isfinite(x).all():
            return
        last = None
        for first, mono, out in _blocks(x, 1e-5):
            spectra = np.abs(np.fft.rfft(mono * window, axis=1))
            spectra /= np.maximum(spectra.sum(1, keepdims=True), 1e-12)
            gained = np.diff(spectra, axis=0, prepend=spectra[:1] if last is None else last)
            last = spectra[-1:]
            yield np.arange(first, first + len(mono)), out, np.sqrt((mono ** 2).mean(1)), np.sqrt((np.maximum(gained, 0) ** 2).mean(1))

    f = _mapped(files, key, col, "idx long, fallback boolean, rms double, flux double", rows)
    db = 20 * F.log10(F.greatest("rms", F.lit(1e-8)))
    change = F.coalesce(db - F.lag(db).over(Window.partitionBy(key).orderBy("idx")), F.lit(0.0))
    f = f.withColumn("change", change).withColumns({"rise": F.greatest("change", F.lit(0.0)), "delta": F.abs("change")})
    song = Window.partitionBy(key)

    def strength(c):
        q = F.percentile(F.when(F.col(c) > 1e-12, F.col(c)), 0.95).over(song)
        return F.least(F.lit(1.0), F.coalesce(F.col(c) / q, F.lit(0.0)))

    f = f.withColumns({"energy": strength("rms"), "spectral_flux": strength("flux"), "energy_rise": strength("rise"), "energy_delta": strength("delta")})
    onset = F.least(F.lit(1.0), 0.65 * F.col("spectral_flux") + 0.35 * F.col("energy_rise"))
    return f.select(key, "idx", "fallback", "rms", "energy", "spectral_flux", "energy_rise", "energy_delta", onset.alias("onset"))
