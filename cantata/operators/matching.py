"""One-to-one greedy matching of predictions to references within a song, and the metrics over it."""
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .groups import fold, in_order, pair, whole_songs

RATE = 48000


def match_points(reference: DataFrame, predicted: DataFrame, tolerance: int, key: str = "song_id") -> DataFrame:
    """(key, sample, other, error) of each reference sample in order: the nearest free prediction within `tolerance`, the earlier on ties; other is null where none is. Predictions left over come with a null sample."""

    def step(refs, preds):
        free = [(p["sample"], i) for i, p in enumerate(preds)]
        for r in refs:
            at = bisect_left(free, (r["sample"], -1))
            near = [free[i] for i in (at - 1, at) if 0 <= i < len(free) and abs(free[i][0] - r["sample"]) <= tolerance]
            if at and near:
                # Of equal samples the first prediction.
                near += [free[bisect_left(free, (free[at - 1][0], -1))]]
            best = min(near, key=lambda x: (abs(x[0] - r["sample"]), x[1]), default=None)
            if best is None or abs(best[0] - r["sample"]) > tolerance:
                yield r["sample"], None, None
            else:
                free.remove(best)
                yield r["sample"], best[0], abs(best[0] - r["sample"])
        for s, _ in free:
            yield None, s, None

    return pair(reference.select(key, "sample"), predicted.select(key, "sample"), key, (["sample"], ["sample"]), step, "sample long, other long, error long")


def point_metrics(matches: DataFrame, *keys: str) -> DataFrame:
    """Counts, precision, recall, F1 and errors in milliseconds over match_points() rows; a rate without a denominator is null."""
    hit = F.count(F.when(F.col("sample").isNotNull() & F.col("other").isNotNull(), 1))
    m = matches.groupBy(*keys).agg(
        hit.alias("true_positive"), F.count(F.when(F.col("sample").isNull(), 1)).alias("false_positive"), F.count(F.when(F.col("other").isNull(), 1)).alias("false_negative"),
        (F.avg("error") / RATE * 1000).alias("mean_abs_error_ms"), (F.max("error") / RATE * 1000).alias("max_abs_error_ms"),
    )
    rate = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative"))
    # F1 needs both rates, and one of them above zero.
    return m.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "f1": F.when((tp > 0), 2 * tp / (2 * tp + fp + fn))})


_SPAN = ["start_sample", "end_sample", "midi_note"]

#: Songs of up to this many pairs of notes are matched side by side, longer ones by a sweep each.
_PAIRS = 4096


def _swept(refs, preds, tolerance):
    """The row of the prediction that each reference takes, or -1, for rows (start, end) of one song in order; predictions enter when a reference may reach them, and leave when no later one can."""
    live, at = {}, 0
    for start, end in refs:
        while at < len(preds) and preds[at][0] <= max(start + tolerance, end):
            live[at] = preds[at]
            at += 1
        best = None
        for i, (p_start, p_end) in [*live.items()]:
            onset = abs(p_start - start)
            if p_end <= start and p_start < start - tolerance:
                live.pop(i)
                continue
            shared = max(0, min(p_end, end) - max(p_start, start))
            share = shared / max(1, min(end - start, p_end - p_start))
            if (onset <= tolerance or share >= 0.5) and (best is None or (onset, -share, i) < best):
                best = (onset, -share, i)
        if best:
            live.pop(best[2])
        yield best[2] if best else -1


def _taken(song, side, start, end, tolerance):
    """The row of the prediction that each reference row takes, or -1, over whole songs in order of song, side and start: the first references of all songs choose at once, then the second ones."""
    taken = np.full(len(song), -1)
    songs = np.arange(song[-1] + 1)
    first, split, last = np.searchsorted(song, songs), np.searchsorted(2 * song + side, 2 * songs + 1), np.searchsorted(song, songs, "right")
    count = last - split
    long = (split - first) * count > _PAIRS
    for a, m, z in zip(first[long], split[long], last[long]):
        spans = list(zip(start[a:z].tolist(), end[a:z].tolist()))
        found = np.fromiter(_swept(spans[:m - a], spans[m - a:], tolerance), np.int64, m - a)
        taken[a:m] = np.where(found < 0, -1, found + m)
    refs = np.flatnonzero((side == 0) & ~long[song])
    n = count[song[refs]]
    r = np.repeat(refs, n)
    p = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n) + split[song[r]]
    onset = np.abs(start[p] - start[r])
    share = np.maximum(0, np.minimum(end[p], end[r]) - np.maximum(start[p], start[r])) / np.maximum(1, np.minimum(end[r] - start[r], end[p] - start[p]))
    near = np.flatnonzero((onset <= tolerance) | (share >= 0.5))
    r, p, onset, share = r[near], p[near], onset[near], share[near]
    turn = r - first[song[r]]
    ranked = np.lexsort((p, -share, onset, r, turn))
    r, p, turn = r[ranked], p[ranked], turn[ranked]
    cuts = np.append(np.flatnonzero(np.diff(turn, prepend=-1)), len(turn))
    free = np.ones(len(song), bool)
    for a, z in zip(cuts, cuts[1:]):
        open_ = a + np.flatnonzero(free[p[a:z]])
        best = open_[np.diff(r[open_], prepend=-1) != 0]
        taken[r[best]] = p[best]
        free[p[best]] = False
    return taken


def match_notes(reference: DataFrame, predicted: DataFrame, tolerance: int, key: str = "song_id") -> DataFrame:
    """(key, start_sample, end_sample, midi_note, other_start, other_end, other_midi) of each reference note: of the free predictions that begin within `tolerance`, or share half of the shorter note, the one with the least onset error, then the larger share, then the earlier. Predictions left over come with a null reference."""
    side = lambda df, n: df.select(key, F.lit(n).alias("side"), *_SPAN)
    return match_sides(side(reference, 0).union(side(predicted, 1)), tolerance, key)


def match_sides(notes: DataFrame, tolerance: int, key: str = "song_id") -> DataFrame:
    """match_notes() where both come from one table: rows (key, side 0 for references and 1 for predictions, start_sample, end_sample, midi_note)."""
    both = notes.select(key, F.col("side").cast("int").alias("_side"), *(F.col(c).cast("long").alias(c) for c in _SPAN))
    full = StructType([both.schema[key], *StructType.fromDDL("start_sample long, end_sample long, midi_note long, other_start long, other_end long, other_midi long").fields])
    arrow = to_arrow_schema(full)

    def run(batches):
        for b in whole_songs(batches):
            name, sides, start, end, midi, nth = b.columns
            if start.null_count or end.null_count:
                raise ValueError("a note has no start or no end")
            song, sides = np.cumsum(nth.to_numpy() == 1) - 1, sides.to_numpy()
            taken = _taken(song, sides, start.to_numpy(), end.to_numpy(), tolerance)
            refs = np.flatnonzero(sides == 0)
            used = np.zeros(len(sides), bool)
            used[taken[taken >= 0]] = True
            spare = np.flatnonzero((sides == 1) & ~used)
            at = np.concatenate([refs, spare])
            mine, other = pa.array(at, mask=sides[at] == 1), np.where(sides[at] == 1, at, taken[at])
            other = pa.array(other, mask=other < 0)
            yield pa.RecordBatch.from_arrays([name.take(pa.array(at)), *(c.take(i) for i in (mine, other) for c in (start, end, midi))], schema=arrow)

    return in_order(both, key, "_side", *_SPAN).mapInArrow(run, full)


def note_metrics(matches: DataFrame, *keys: str) -> DataFrame:
    """Exact-pitch F1, onset and offset errors and octave errors over match_notes() rows."""
    both = F.col("start_sample").isNotNull() & F.col("other_start").isNotNull()
    exact = both & (F.col("midi_note") == F.col("other_midi"))
    gap = F.abs(F.col("midi_note") - F.col("other_midi"))
    ms = lambda a, b: F.when(exact, F.abs(F.col(a) - F.col(b)) / RATE * 1000)
    m = matches.groupBy(*keys).agg(
        F.count("start_sample").alias("reference_count"), F.count("other_start").alias("predicted_count"), F.count(F.when(both, 1)).alias("temporal_matches"), F.count(F.when(exact, 1)).alias("pitch_true_positive"),
        F.avg(ms("start_sample", "other_start")).alias("mean_abs_onset_error_ms"), F.max(ms("start_sample", "other_start")).alias("max_abs_onset_error_ms"),
        F.avg(ms("end_sample", "other_end")).alias("mean_abs_offset_error_ms"), F.max(ms("end_sample", "other_end")).alias("max_abs_offset_error_ms"),
        F.count(F.when(both & gap.isin(12, 24, 36), 1)).alias("octave_error_count"),
    )
    r, p, tp = F.col("reference_count"), F.col("predicted_count"), F.col("pitch_true_positive")
    return m.withColumns({"pitch_f1": F.when((r > 0) & (p > 0), 2 * tp / (r + p)), "octave_error_rate": F.when(F.col("temporal_matches") > 0, F.col("octave_error_count") / F.col("temporal_matches"))})


def suppress(candidates: DataFrame, threshold: float, distance: int, key: str = "song_id") -> DataFrame:
    """Greedy non-maximum suppression: local maxima of probability at or over `threshold`, the most probable first, kept `distance` samples apart (key, sample, probability)."""
    def step(rows):
        p = [-1.0, *(r["probability"] for r in rows), -1.0]
        peaks = [r for r, a, b, c in zip(rows, p, p[1:], p[2:]) if b >= threshold and b >= a and b >= c]
        kept = []
        for r in sorted(peaks, key=lambda r: -r["probability"]):
            at = bisect_left(kept, (r["sample"],))
            if all(abs(k[0] - r["sample"]) >= distance for k in kept[max(0, at - 1):at + 1]):
                insort(kept, (r["sample"], r["probability"]))
        return kept

    return fold(candidates.select(key, "sample", "probability"), key, ["sample"], step, "sample long, probability double")
