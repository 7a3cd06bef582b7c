"""From pitch observations to notes: fused F0, candidates, key, repetition priors and the best path.

All but the two folds (F0 fusion and the path, which need the frame or note before) are joins, windows and aggregates.
"""
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .groups import fold

HOP, CELL = 480, 48000

#: Weight of a scale's degrees, the rest weigh OUTSIDE.
PROFILES = {
    "major": {0: 1.30, 2: 1.00, 4: 1.15, 5: 0.95, 7: 1.20, 9: 0.95, 11: 0.90},
    "minor": {0: 1.30, 2: 0.95, 3: 1.15, 5: 1.00, 7: 1.20, 8: 0.95, 10: 0.95},
}
OUTSIDE = -0.45


def _choose(seen, previous, low, high, threshold):
    heard = [o for o in seen if o["hz"] is not None and o["voiced_probability"] > 0.05]
    hz = np.array([o["hz"] for o in heard], float)
    octaves = hz[:, None] * 2.0 ** np.arange(-2, 3)
    states = np.unique(np.round(octaves[(octaves >= low) & (octaves <= high)], 9))
    if not len(states):
        return None, 0.0, 0.0, None, []
    trust = np.array([o["reliability"] * o["confidence"] for o in heard], float)
    weight = trust * [o["voiced_probability"] for o in heard]
    away = np.log2(states[:, None] / hz)
    shift = np.clip(np.rint(away), -2, 2)
    support = (weight * np.exp(-0.5 * (1200 * (away - shift) / 45) ** 2)).sum(1)
    score = support + 0.08 * (weight * ((1200 * np.abs(away) < 50) - np.abs(shift))).sum(1)
    if previous is not None:
        score -= 0.55 * np.minimum(1200 * np.abs(np.log2(states / previous)) / 600, 2)
    ranked = np.lexsort((states, support, score))[::-1]
    best = ranked[0]
    total = weight.sum()
    voiced = min(1.0, total / trust.sum()) if trust.sum() > 1e-12 else 0.0
    confidence = min(1.0, support[best] / total) if total > 1e-12 else 0.0
    kept = [{"hz": float(states[i]), "score": float(score[i]), "support": float(support[i])} for i in ranked[:8]]
    return (float(states[best]) if voiced >= threshold else None), float(confidence), float(voiced), float(score[best]), kept


def fuse(observations: DataFrame, low: float = 55.0, high: float = 1760.0, threshold: float = 0.55, key: str = "song_id") -> DataFrame:
    """One F0 per frame of the detectors' observations (key, idx, detector, hz, confidence, voiced_probability, reliability).

    Every observation and its octaves are states; a state gains by the observations it explains and loses by octave shifts and by distance from the last voiced frame. The eight best states stay as evidence. A frame without a voiced observation, or with no state within [low, high], has no F0.
    """

    def step(rows):
        frames, previous = {}, None
        for r in rows:
            frames.setdefault(r["idx"], []).append(r)
        for idx, seen in frames.items():
            found = _choose(seen, previous, low, high, threshold)
            previous = found[0] or previous
            yield idx, *found

    cols = ["idx", "detector", "hz", "confidence", "voiced_probability", "reliability"]
    return fold(observations.select(key, *cols), key, ["idx", "detector"], step, "idx long, f0_hz double, confidence double, voiced_probability double, score double, states array<struct<hz:double,score:double,support:double>>")


def estimate_key(candidates: DataFrame, key: str = "song_id") -> DataFrame:
    """(key, tonic, mode, confidence) from the pitch classes of candidates (start_sample, end_sample, base_midi, confidence) weighted by length and confidence, against the 24 profiles; null tonic where no candidate is a MIDI note. Scores equal to six places are ties; the higher tonic wins, then minor."""
    midi = F.rint("base_midi").cast("int")
    weight = F.greatest(F.lit(1), F.col("end_sample") - F.col("start_sample")) * F.greatest(F.lit(0.05), F.coalesce("confidence", F.lit(0.0)))
    heard = F.when(midi.between(0, 127), weight)
    sums = candidates.groupBy(key).agg(*(F.sum(F.when(F.pmod(midi, F.lit(12)) == i, heard)).alias(f"_{i}") for i in range(12)))
    h = [F.coalesce(f"_{i}", F.lit(0.0)) for i in range(12)]
    total = reduce(Column.__add__, h)

    def score(tonic, degrees):
        return F.round(reduce(Column.__add__, (h[i] * degrees.get((i - tonic) % 12, OUTSIDE) for i in range(12))), 6)

    states = F.array(*(F.struct(score(t, w).alias("score"), F.lit(t).alias("tonic"), F.lit(m).alias("mode")) for m, w in PROFILES.items() for t in range(12)))
    ranked = sums.select(key, total.alias("total"), F.sort_array(states, asc=False).alias("s"))
    best, second, known = F.col("s")[0], F.col("s")[1], F.col("total") > 0
    sure = (best.score - second.score) / F.greatest(F.col("total"), F.abs(best.score), F.lit(1.0))
    return ranked.select(key, F.when(known, best.tonic).alias("tonic"), F.when(known, best.mode).alias("mode"), F.when(known, F.least(F.lit(1.0), sure)).otherwise(0.0).alias("confidence"))


def in_scale(midi: Column, tonic: Column, mode: Column) -> Column:
    """False where no key is known."""
    degree = F.pmod(midi - tonic, F.lit(12))
    return F.coalesce(reduce(Column.__or__, ((mode == m) & degree.isin(*w) for m, w in PROFILES.items())), F.lit(False))


def candidates(frames: DataFrame, decisions: DataFrame, voiced: float = 0.6, bridge: int = 2, key: str = "song_id") -> DataFrame:
    """Note candidates: voiced runs cut at accepted boundaries.

    Takes frames (key, idx, start_sample, end_sample, midi, confidence, voiced_probability) and decisions (key, sample, probability, reason, accepted), one per sample. Runs bridge `bridge` unvoiced frames. Of a candidate the outer frames are left out (two a side from fifteen frames on, one from seven); base_midi is the weighted median of the rest. An edge that is no boundary has probability 1 and reason voiced_run_edge.
    """
    song = Window.partitionBy(key)
    by_idx, back, ahead = song.orderBy("idx"), song.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0), song.orderBy("at", "kind").rowsBetween(1, Window.unboundedFollowing)
    heard = frames.where(F.col("midi").isNotNull() & (F.col("voiced_probability") >= voiced))
    new = F.coalesce(F.col("idx") - F.lag("idx").over(by_idx) - 1 > bridge, F.lit(True)).cast("int")
    runs = heard.withColumn("_new", new).withColumn("run", F.sum("_new").over(by_idx.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(key, "run")
    runs = runs.select(
        key, "run", "midi", "confidence", "voiced_probability", F.floor((F.col("start_sample") + F.col("end_sample")) / 2).alias("at"), F.lit(1).alias("kind"),
        F.min("start_sample").over(whole).alias("run_start"), F.max("end_sample").over(whole).alias("run_end"),
    )
    cuts = decisions.where("accepted").select(key, F.col("sample").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("sample"), F.col("probability"), F.col("reason")).alias("cut"))
    near = runs.unionByName(cuts, allowMissingColumns=True).withColumns({"last": F.last("cut", True).over(back), "next": F.first("cut", True).over(ahead)}).where("kind = 1")
    start, end = F.greatest("run_start", "last.sample"), F.least("run_end", "next.sample")
    edge = F.lit("voiced_run_edge")
    near = near.withColumns({
        "start_sample": start, "end_sample": end, "support": F.coalesce(F.col("confidence"), F.lit(0.0)) * F.col("voiced_probability"),
        "before": F.when(F.col("last.sample") == start, F.struct("last.probability", "last.reason")).otherwise(F.struct(F.lit(1.0).alias("probability"), edge.alias("reason"))),
        "after": F.when(F.col("next.sample") == end, F.struct("next.probability", "next.reason")).otherwise(F.struct(F.lit(1.0).alias("probability"), edge.alias("reason"))),
    })
    part = Window.partitionBy(key, "run", "start_sample", "end_sample")
    n, r = F.count(F.lit(1)).over(part), F.row_number().over(part.orderBy("at"))
    trim = F.when(F.col("n") >= 15, 2).when(F.col("n") >= 7, 1).otherwise(0)
    steady = near.withColumns({"n": n, "r": r, "weight": F.greatest(F.lit(0.01), "support")}).where((F.col("r") > trim) & (F.col("r") <= F.col("n") - trim))
    order = part.orderBy("midi", "weight", "at").rowsBetween(Window.unboundedPreceding, 0)
    steady = steady.withColumns({"through": F.sum("weight").over(order), "total": F.sum("weight").over(part)})
    steady = steady.withColumn("base_midi", F.min(F.when(F.col("through") >= F.col("total") / 2, F.col("midi"))).over(part))
    out = steady.groupBy(key, "run", "start_sample", "end_sample", "base_midi").agg(
        (F.sum(F.col("support") * F.col("weight")) / F.sum("weight")).alias("mean"), F.median(F.abs(F.col("midi") - F.col("base_midi"))).alias("deviation"),
        ((F.max("midi") - F.min("midi")) * 100).alias("spread_cents"), F.count(F.lit(1)).alias("frames"), F.max("before").alias("before"), F.max("after").alias("after"),
    )
    stability = F.exp(-0.5 * F.pow(F.col("deviation") * 100 / 65, 2))
    return out.select(
        key, F.row_number().over(song.orderBy("start_sample")).alias("candidate"), "run", "start_sample", "end_sample", "base_midi", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("mean") * (0.65 + 0.35 * stability))).alias("confidence"),
        "spread_cents", "frames", F.col("before.probability").alias("before_probability"), F.col("before.reason").alias("before_reason"), F.col("after.probability").alias("after_probability"), F.col("after.reason").alias("after_reason"),
    )


def _cells(df, name):
    first, last = (F.floor(c / CELL) for c in (F.col("start_sample"), F.greatest("start_sample", F.col("end_sample") - 1)))
    return df.withColumn(name, F.explode(F.sequence(first, last)))


def hypotheses(found: DataFrame, external: DataFrame, key: str = "song_id") -> DataFrame:
    """(key, candidate, midi_note, score): the notes within a semitone of a candidate's base by distance, and external notes (start_sample, end_sample, midi_note, confidence) that share a quarter of the shorter span; evidence for one note joins as 1 - product of the doubts.

    Spans meet by cell, so that a song's notes are not compared all with all, and by grouping, with no second pass over candidates. Candidates without a base are left out; one that no note explains keeps its nearest.
    """
    found = found.where("base_midi IS NOT NULL")
    base = F.rint("base_midi").cast("long")
    cents = F.abs(F.col("base_midi") - F.col("midi_note")) * 100
    own = found.select(key, "candidate", "base_midi", "confidence", F.explode(F.sequence(base - 1, base + 1)).alias("midi_note")).where("midi_note BETWEEN 0 AND 127")
    own = own.select(key, "candidate", "midi_note", (F.col("confidence") * F.exp(-0.5 * F.pow(cents / 45, 2))).alias("score")).where("score > 0.005")
    a = _cells(found.where(F.col(key).isNotNull()).select(key, "candidate", "start_sample", "end_sample"), "cell").select(key, "cell", F.struct("candidate", "start_sample", "end_sample").alias("a"))
    b = _cells(external.where(F.col(key).isNotNull()).select(key, "start_sample", "end_sample", "midi_note", "confidence").where("end_sample > start_sample"), "cell").select(key, "cell", F.struct("start_sample", "end_sample", "midi_note", "confidence").alias("b"))
    met = a.unionByName(b, allowMissingColumns=True).groupBy(key, "cell").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    met = met.select(key, "cell", F.explode("a").alias("a"), "b").select(key, "cell", "a", F.explode("b").alias("b"))
    shared = F.least("a.end_sample", "b.end_sample") - F.greatest("a.start_sample", "b.start_sample")
    shorter = F.greatest(F.lit(1), F.least(F.col("a.end_sample") - F.col("a.start_sample"), F.col("b.end_sample") - F.col("b.start_sample")))
    # Two spans meet in several cells; the cell where both have begun counts.
    once = F.col("cell") == F.floor(F.greatest("a.start_sample", "b.start_sample") / CELL)
    outer = met.where(once & (shared > 0) & (shared / shorter >= 0.25))
    outer = outer.select(key, "a.candidate", "b.midi_note", (0.85 * F.least(F.lit(1.0), F.col("b.confidence") * (0.55 + 0.45 * F.least(F.lit(1.0), shared / shorter)))).alias("score"))
    bare = found.select(key, "candidate", base.alias("midi_note"), F.col("confidence").alias("sure"))
    seen = own.unionByName(outer).withColumn("seen", F.lit(1)).unionByName(bare, allowMissingColumns=True)
    # Dealt by candidate, so that sums by note and the look at all notes of a candidate share one move.
    seen = seen.repartition(key, "candidate")
    joined = seen.groupBy(key, "candidate", "midi_note").agg((1 - F.product(1 - F.col("score"))).alias("score"), F.max("sure").alias("sure"), F.max("seen").alias("seen"))
    explained = F.max("seen").over(Window.partitionBy(key, "candidate"))
    joined = joined.withColumn("explained", explained).where("seen = 1 OR explained IS NULL")
    return joined.select(key, "candidate", "midi_note", F.when(F.col("seen") == 1, F.col("score")).otherwise(F.col("sure")).alias("score"))


def priors(found: DataFrame, pairs: DataFrame, key: str = "song_id") -> DataFrame:
    """(key, candidate, source, midi_note, strength) of candidates within the repeat of a pair (key, pair, source_start, source_end, repeat_start, repeat_end, confidence): the source candidate nearest to the mapped middle, the earlier on ties. Of several pairs the last counts.

    Middles are sorted once per pair; nothing is compared all with all.
    """
    total = F.col("start_sample") + F.col("end_sample")
    c = found.select(key, "candidate", "base_midi", F.col("confidence").alias("sure"), (total / 2).alias("middle"), F.floor(total / 2).alias("center"))
    p = c.join(pairs, key)
    inside = lambda side: (F.col("center") >= F.col(f"{side}_start")) & (F.col("center") < F.col(f"{side}_end"))
    first = Window.partitionBy(key, "pair", "middle").orderBy("candidate")
    sources = p.where(inside("source")).withColumn("_r", F.row_number().over(first)).where("_r = 1").select(key, "pair", F.col("middle").alias("at"), F.lit(0).alias("kind"), F.struct("middle", "candidate", "base_midi", "sure").alias("source"))
    mapped = F.col("source_start") + (F.col("center") - F.col("repeat_start")) / (F.col("repeat_end") - F.col("repeat_start")) * (F.col("source_end") - F.col("source_start"))
    probes = p.where(inside("repeat")).select(key, "pair", mapped.alias("at"), F.lit(1).alias("kind"), "candidate", F.col("confidence").alias("trust"))
    w = Window.partitionBy(key, "pair").orderBy("at", "kind", "candidate")
    near = sources.unionByName(probes, allowMissingColumns=True).withColumns({
        "last": F.last("source", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "next": F.first("source", True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    }).where("kind = 1")
    # The mapped middle is seldom exact, so distances equal to six places are ties.
    away = lambda side: F.round(F.abs(F.col(f"{side}.middle") - F.col("at")), 6)
    later = F.col("last").isNull() | (away("next") < away("last"))
    near = near.withColumn("source", F.when(later & F.col("next").isNotNull(), F.col("next")).otherwise(F.col("last"))).where("source IS NOT NULL")
    out = near.groupBy(key, "candidate").agg(F.max_by(F.struct("source", "trust"), "pair").alias("m"))
    return out.select(key, "candidate", F.col("m.source.candidate").alias("source"), F.rint("m.source.base_midi").cast("long").alias("midi_note"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("m.trust") * F.col("m.source.sure"))).alias("strength"))


def best_path(found: DataFrame, notes: DataFrame, keys: DataFrame, repeats: DataFrame, key: str = "song_id") -> DataFrame:
    """(key, candidate, start_sample, end_sample, midi_note, confidence, before_probability, after_probability): the hypotheses (notes) whose sum of evidence, key and repetition bonus less leaps is greatest along the song.

    Bonuses are joined in the plan; the fold holds the path alone. merge_fragments() takes the result.
    """
    r = repeats.select(key, "candidate", F.col("midi_note").alias("again"), "strength")
    n = notes.join(keys.select(key, "tonic", "mode", F.col("confidence").alias("sure")), key, "left").join(r, [key, "candidate"], "left")
    scale = F.when(in_scale(F.col("midi_note"), F.col("tonic"), F.col("mode")), 0.08 * F.greatest(F.lit(0.25), "sure")).otherwise(-0.02)
    away = F.abs(F.col("midi_note") - F.col("again"))
    again = F.coalesce(F.when(away == 0, 0.15 * F.col("strength")).when(away.isin(12, 24), -0.08 * F.col("strength")), F.lit(0.0))
    states = n.groupBy(key, "candidate").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("doubt"), "midi_note", (2 * F.col("score") + scale + again).alias("worth")))).alias("states"))
    cols = ["candidate", "start_sample", "end_sample", "confidence", "before_probability", "after_probability"]

    def step(rows):
        best, backs, end = np.zeros(1), [], None
        was = np.zeros(1)
        for r in rows:
            midi, worth = np.array([(s["midi_note"], s["worth"]) for s in r["states"]], float).T
            leap = np.abs(midi[:, None] - was)
            if end is not None and r["start_sample"] - end <= 3 * HOP:
                cost = np.minimum(0.25, np.maximum(0, leap - 7) * 0.015)
                cost[(leap == 12) | (leap == 24)] += 0.05
            else:
                cost = 0 * leap
            ways = best - cost
            backs.append(ways.argmax(1))
            best, was, end = ways.max(1) + worth, midi, r["end_sample"]
        at, path = int(best.argmax()), []
        for b in reversed(backs):
            path.append(at)
            at = b[at]
        for r, i in zip(rows, reversed(path)):
            s = r["states"][i]
            sure = min(1.0, max(0.0, 0.55 * r["confidence"] - 0.45 * s["doubt"]))
            yield r["candidate"], r["start_sample"], r["end_sample"], s["midi_note"], sure, r["before_probability"], r["after_probability"]

    return fold(found.select(key, *cols).join(states, [key, "candidate"]), key, ["candidate"], step, "candidate int, start_sample long, end_sample long, midi_note long, confidence double, before_probability double, after_probability double")
