"""Ordered folds within a song: note pairing, fragment merging, best paths."""
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .groups import _values, fold

#: Notes farther apart than this, or with a boundary this strong between them, do not merge.
GAP, STRONG = 960, 0.85


def pair_notes(events: DataFrame, key: str = "song_id", extend: bool = False) -> DataFrame:
    """Note-on, note-off and pedal events (key, tick, seq, kind, channel, note, velocity) -> (key, channel, note, start_tick, end_tick, velocity, ended).

    At one tick offs and pedals come before ons, save an off that is written
    after the on of the same tick: that note is dropped. An on while the note
    sounds ends it (retrigger), notes still sounding end at the last tick
    (unterminated), and an off without a note is no row. Notes of no length are
    dropped. With `extend` an off under a channel's pedal (kind `sustain`, its
    value in `note`, down from 64 on) leaves the note held until the pedal goes
    up (pedal), the note is struck again (retrigger) or the last tick
    (unterminated); else pedals say nothing. All by windows, so the longest song
    is sorted, not held.
    """

    e = events.select(key, "tick", "seq", "kind", "channel", "note", "velocity", F.when(F.col("kind") == "on", 1).otherwise(0).alias("phase"))
    channel, up = Window.partitionBy(key, "channel"), (F.col("kind") == "sustain") & (F.col("note") < 64)
    earlier = channel.orderBy("tick", "phase", F.asc_nulls_last("seq")).rowsBetween(Window.unboundedPreceding, -1)
    later = channel.orderBy(F.desc("tick"), F.desc("phase"), F.desc_nulls_first("seq")).rowsBetween(Window.unboundedPreceding, -1)
    pedal = F.when(F.col("kind") == "sustain", F.col("note") >= 64)
    # Under the pedal or not, and when it goes up next.
    e = e.withColumn("down", F.coalesce(F.last(pedal, True).over(earlier), F.lit(False)) if extend else F.lit(False))
    e = e.withColumn("up", F.last(F.when(up, F.col("tick")), True).over(later) if extend else F.lit(None).cast("long"))
    e = e.withColumn("last", F.max("tick").over(Window.partitionBy(key))).where(F.col("kind").isin("on", "off"))
    pitch = Window.partitionBy(key, "channel", "note").orderBy("tick", "phase", F.asc_nulls_last("seq"))
    e = e.withColumns({f"next_{c}": F.lead(c).over(pitch) for c in ("kind", "tick", "down", "up")})
    tick = Window.partitionBy(key, "channel", "note", "tick")
    of = lambda kind: F.when(F.col("kind") == kind, F.col("seq"))
    e = e.withColumns({"offs": F.count(of("off")).over(tick), "off_seq": F.max(of("off")).over(tick), "on_seq": F.max(of("on")).over(tick)})
    # An off that stands after the on of its tick drops that note where it finds none from before: it is the tick's second one, or nothing sounded, as after a note dropped likewise.
    dropped = F.col("off_seq") > F.col("on_seq")
    sounds = F.when(F.col("on_seq").isNull(), False).when(F.col("kind") == "off", None).when(~F.coalesce(dropped, F.lit(False)), True).when(F.col("offs") > 1, False)
    e = e.withColumn("kept", F.coalesce(F.last(sounds, True).over(pitch.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    on = e.where("kind = 'on'").withColumn("again", F.lead("tick").over(pitch)).where("kept")
    end = lambda column, how: F.struct(F.col(column).alias("tick"), F.lit(how).alias("how"))
    held = F.when(F.col("up") <= F.coalesce("again", "up"), end("up", "pedal")).when(F.col("again").isNotNull(), end("again", "retrigger"))
    on = on.withColumn("up", F.col("next_up")).withColumn("end", F.coalesce(
        F.when(F.col("next_kind") == "on", end("next_tick", "retrigger")).when(~F.col("next_down"), end("next_tick", "off")).when(F.col("next_down"), held), end("last", "unterminated")))
    return on.where(F.col("end.tick") > F.col("tick")).select(key, *(F.col(c).cast("long").alias(c) for c in ("channel", "note")), F.col("tick").cast("long").alias("start_tick"), F.col("end.tick").cast("long").alias("end_tick"), F.col("velocity").cast("long").alias("velocity"), F.col("end.how").alias("ended"))


def _joined(a, b, pitch=None):
    """Two neighbours as one note; the longer one names the pitch, confidence is weighted by length."""
    na, nb = a["end"] - a["start"], b["end"] - b["start"]
    longer = a if na >= nb else b
    return {**a, "end": b["end"], "after": b["after"], "parts": a["parts"] + b["parts"], "pitch": longer["pitch"] if pitch is None else pitch, "confidence": min(1.0, max(0.0, (a["confidence"] * na + b["confidence"] * nb) / max(1, na + nb)))}


def _weak(a, b):
    return b["start"] - a["end"] <= GAP and max(a["after"], b["before"]) < STRONG


def _equal_merged(notes):
    out = []
    for n in notes:
        if out and out[-1]["pitch"] == n["pitch"] and _weak(out[-1], n):
            out[-1] = _joined(out[-1], n, n["pitch"])
        else:
            out.append(n)
    return out


def merge_fragments(notes: DataFrame, shortest: int, key: str = "song_id") -> DataFrame:
    """Merge weak neighbours of equal pitch, then fragments under `shortest` samples into the neighbour whose pitch is nearest, two semitones at most and the left one on ties, then equal neighbours again.

    Takes (key, start_sample, end_sample, midi_note, confidence, before_probability, after_probability), returns (key, start_sample, end_sample, midi_note, confidence, parts).
    """

    def step(rows):
        line = _equal_merged([{"start": r["start_sample"], "end": r["end_sample"], "pitch": r["midi_note"], "confidence": r["confidence"], "before": r["before_probability"], "after": r["after_probability"], "parts": 1} for r in rows])
        i = 0
        while i < len(line):
            n = line[i]
            sides = [(abs(line[j]["pitch"] - n["pitch"]), j) for j in (i - 1, i + 1) if 0 <= j < len(line) and _weak(line[min(i, j)], line[max(i, j)])]
            gap, j = min(sides, default=(3, 0)) if n["end"] - n["start"] < shortest else (3, 0)
            if gap > 2:
                i += 1
                continue
            i = min(i, j)
            line[i:i + 2] = [_joined(line[i], line[i + 1])]
        return [(n["start"], n["end"], n["pitch"], n["confidence"], n["parts"]) for n in _equal_merged(line)]

    cols = ["start_sample", "end_sample", "midi_note", "confidence", "before_probability", "after_probability"]
    return fold(notes.select(key, *cols), key, ["start_sample", "end_sample"], step, "start_sample long, end_sample long, midi_note long, confidence double, parts long")


#: Segments that are aligned side by side, and bytes of their ways back at once.
ABREAST, WAYS = 32, 1 << 26


def _best_paths(log_probs: list, tokens: list, blank: int):
    """The most probable CTC path of each segment as states by frame (even: blank, odd: 2 k + 1 of token k), or None where no path exists.

    Segments stand side by side, those of most frames first, so that those
    still under way are a view. Blanks and tokens are kept apart, as only
    tokens jump. A frame works on the states that can be reached by then and
    from which an end can be; states behind a shorter segment's end lead to none
    that is read.
    """
    order = sorted(range(len(tokens)), key=lambda b: -len(log_probs[b]))
    frames, length = (np.array([len(x[b]) for b in order]) for x in (log_probs, tokens))
    most, size, wide = int(frames.max()), int(length.max()), max(log_probs[b].shape[1] for b in order)
    p = np.full((most, len(order), wide), -np.inf)
    label = np.full((len(order), size), blank)
    for i, b in enumerate(order):
        p[:frames[i], i, :log_probs[b].shape[1]] = log_probs[b]
        label[i, :length[i]] = tokens[b]
    barred = np.full(label.shape, -np.inf)
    barred[:, 1:][(label[:, 1:] != blank) & (label[:, 1:] != label[:, :-1])] = 0.0
    place = label + wide * np.arange(len(order))[:, None]
    # Sums of blanks, and of tokens behind a place that no path reaches.
    blanks, behind = np.full((len(order), size + 1), -np.inf), np.full((len(order), size + 1), -np.inf)
    blanks[:, 0] = 0.0
    from_token, from_blank = np.zeros((most, len(order), size + 1), bool), np.zeros((most, len(order), size), np.int8)
    active = np.searchsorted(-frames, -np.arange(most), "left")
    low = np.maximum(0, np.minimum.accumulate(length - frames)[active - 1] + np.arange(most))
    for t, (n, lo) in enumerate(zip(active.tolist(), low.tolist())):
        hi = min(size, t + 1)
        e, o, before = blanks[:n, lo:hi + 1], behind[:n, lo + 1:hi + 1], behind[:n, lo:hi + 1]
        way, to_token = from_blank[t, :n, lo:hi], e[:, :hi - lo]
        far = before[:, :hi - lo] + barred[:n, lo:hi]
        np.greater(to_token, o, out=way.view(bool))
        near = np.maximum(o, to_token)
        jumps = far > near
        way |= jumps.view(np.int8) << 1
        np.maximum(near, far, out=near)
        near += p[t].ravel().take(place[:n, lo:hi], mode="clip")
        np.greater(before, e, out=from_token[t, :n, lo:hi + 1])
        np.maximum(e, before, out=e)
        e += p[t, :n, blank, None]
        o[:] = near
    rows = np.arange(len(order))
    last_blank, last_token = blanks[rows, length], behind[rows, length]
    at = 2 * length - np.where(last_blank >= last_token, 0, 1)
    found = np.isfinite(np.where(last_blank >= last_token, last_blank, last_token))
    path = np.empty((len(order), most), np.int64)
    for t in range(most - 1, -1, -1):
        n = active[t]
        now, k = at[:n], at[:n] >> 1
        path[:n, t] = now
        odd = (now & 1).astype(bool)
        now -= np.where(odd, np.minimum(from_blank[t, rows[:n], np.minimum(k, size - 1)], 2), from_token[t, rows[:n], k])
    out = [None] * len(order)
    for i, b in enumerate(order):
        if found[i]:
            out[b] = path[i, :frames[i]]
    return out


def align(log_probs: list, tokens: list, blank: int) -> list:
    """(first frames, last frames + 1, mean probabilities) of the tokens of the most probable CTC path of each segment, as arrays; None where no path exists.

    log_probs: an array of frames by labels of each segment; tokens: an array of labels.
    """
    out, cost = [None] * len(tokens), [len(p) * (2 * len(x) + 1) for p, x in zip(log_probs, tokens)]
    todo = sorted((i for i, x in enumerate(tokens) if len(x) and len(log_probs[i])), key=lambda i: (len(log_probs[i]), len(tokens[i])))
    while todo:
        n, frames, size = 1, len(log_probs[todo[-1]]), len(tokens[todo[-1]])
        while n < min(ABREAST, len(todo)):
            size = max(size, len(tokens[todo[-n - 1]]))
            # Beside the others a segment takes at most four times its own room.
            if (n + 1) * frames * (2 * size + 1) > WAYS or frames * (2 * size + 1) > 4 * cost[todo[-n - 1]] + 4096:
                break
            n += 1
        group, todo = todo[-n:], todo[:-n]
        for i, path in zip(group, _best_paths([log_probs[i] for i in group], [tokens[i] for i in group], blank)):
            if path is None:
                continue
            first = np.flatnonzero((path & 1) & (np.diff(path, prepend=-1) > 0))
            many = np.bincount(path >> 1, weights=path & 1, minlength=len(tokens[i]))[:len(tokens[i])].astype(np.int64)
            sure = np.exp(log_probs[i][np.arange(len(path)), np.append(tokens[i], blank)[path >> 1]])
            mean = sure[first]
            for k in np.flatnonzero(many > 1):
                mean[k] = sure[first[k]:first[k] + many[k]].mean()
            out[i] = first, first + many, mean
    return out


def _matrices(column) -> list:
    """Rows of arrays of arrays as matrices, by way of one flat array."""
    flat = column.flatten().flatten()
    flat = np.asarray(flat.to_numpy(zero_copy_only=False), float)
    frames = pc.list_value_length(column).fill_null(0).to_numpy()
    cells = np.append(0, np.cumsum(pc.list_value_length(column.flatten()).fill_null(0).to_numpy()))
    ends = np.append(0, np.cumsum(frames))
    return [flat[cells[i]:cells[j]].reshape(j - i, -1) if j > i else np.empty((0, 0)) for i, j in zip(ends[:-1], ends[1:])]


def align_segments(segments: DataFrame, key: str = "segment_id", blank: int = 0, whole: bool = False) -> DataFrame:
    """Forced alignment of rows (key, emissions array<array<double>> of log probabilities, tokens array<int>) -> (key, position, token, start_frame, end_frame, confidence); a segment without a path gives no row.

    With `whole` a segment stays a row, with its other columns, `frames`, and in
    `spans` (position, start_frame, end_frame, confidence) of its tokens, null
    where there is no path. One without tokens or emissions costs nothing.
    """
    span = "position int, {}start_frame int, end_frame int, confidence double"
    kept = [c for c in segments.columns if c not in ("emissions", "tokens")] if whole else [key]
    more = f"frames int, spans array<struct<{span.format('').replace(' int', ':int').replace(' double', ':double')}>>" if whole else span.format("token int, ")
    full = StructType([*(segments.schema[c] for c in kept), *StructType.fromDDL(more).fields])
    arrow = to_arrow_schema(full)

    def run(batches):
        for b in batches:
            log_probs = _matrices(b.column(len(kept)))
            tokens = [np.array(x or [], np.int64) for x in _values(b.column(len(kept) + 1))]
            found = align(log_probs, tokens, blank)
            met = [i for i, x in enumerate(found) if x is not None]
            many = np.array([len(x[0]) if x else 0 for x in found], np.int64)
            joined = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts]).astype(kind)
            position = joined([np.arange(len(found[i][0])) for i in met], np.int32)
            start, end, sure = (joined([found[i][k] for i in met], kind) for k, kind in enumerate((np.int32, np.int32, float)))
            if not whole:
                of = pa.array(np.repeat(np.arange(len(found)), many))
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), *map(pa.array, (position, joined([tokens[i] for i in met], np.int32), start, end, sure))], schema=arrow)
                continue
            kind = arrow.field("spans").type
            ends = pa.array(np.append(0, np.cumsum(many)).astype(np.int32))
            spans = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(list(map(pa.array, (position, start, end, sure))), fields=list(kind.value_type)), type=kind, mask=pa.array([x is None for x in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(kept)], pc.list_value_length(b.column(len(kept))), spans], schema=arrow)

    return segments.select(*kept, "emissions", "tokens").mapInArrow(run, full)
