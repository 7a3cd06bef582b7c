"""F0 fusion and the note path against worked cases and plain enumeration; the joins of melody.py have SQL."""
import itertools
import math
import random

import pytest
from pyspark.sql import SparkSession

from cantata.operators import melody


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


OBSERVED = "song_id string, idx long, detector string, hz double, confidence double, voiced_probability double, reliability double"


def test_a_lone_octave_error_is_corrected(spark):
    rows = [("a", i, "first", h, c, v, 1.0) for i, (h, c, v) in enumerate([(220.0, 0.99, 0.99), (440.0, 0.55, 0.75), (220.0, 0.99, 0.99)])]
    rows += [("a", i, "second", 220.0, c, c, 0.85) for i, c in enumerate([0.9, 0.95, 0.9])]
    got = melody.fuse(spark.createDataFrame(rows, OBSERVED), 55.0, 1760.0, 0.55).orderBy("idx").collect()
    assert [r.f0_hz for r in got] == [pytest.approx(220.0)] * 3


def test_frames_without_pitch(spark):
    rows = [("a", 0, "first", None, 0.0, 0.0, 1.0), ("a", 1, "first", 220.0, 0.9, 0.01, 1.0), ("a", 2, "first", 1.0, 0.9, 0.9, 1.0), ("a", 3, "first", 220.0, 0.9, 0.3, 1.0)]
    got = melody.fuse(spark.createDataFrame(rows, OBSERVED), 55.0, 1760.0, 0.5).orderBy("idx").collect()
    assert [r.f0_hz for r in got] == [None] * 4 and len(got[3].states) == 5 and got[3].voiced_probability == pytest.approx(0.3)
    assert melody.fuse(spark.createDataFrame([], OBSERVED)).count() == 0


def _score(seen, state, previous):
    total = 0.0
    for hz, w in seen:
        k = max(-2, min(2, round(math.log2(state / hz))))
        cents = 1200 * math.log2(state / (hz * 2**k))
        total += w * math.exp(-(cents / 45) ** 2 / 2) - w * 0.08 * abs(k) + (0.08 * w if abs(1200 * math.log2(state / hz)) < 50 else 0)
    return total - (0.55 * min(2, abs(1200 * math.log2(state / previous)) / 600) if previous else 0)


def test_fusion_takes_the_state_of_greatest_score(spark):
    rng, rows = random.Random(3), []
    for s, i, k in itertools.product("abc", range(12), ("p", "q", "r")):
        rows.append((s, i, k, rng.uniform(80, 900), rng.random(), rng.uniform(0.1, 1), rng.choice([1.0, 0.85])))
    got = {(r.song_id, r.idx): r for r in melody.fuse(spark.createDataFrame(rows, OBSERVED), 70.0, 1000.0, 0.5).collect()}
    for s in "abc":
        previous = None
        for i in range(12):
            seen = [(r[3], r[4] * r[5] * r[6]) for r in rows if r[:2] == (s, i)]
            states = [round(h * 2**k, 9) for h, _ in seen for k in range(-2, 3) if 70 <= h * 2**k <= 1000]
            best = max(_score(seen, x, previous) for x in states)
            r = got[s, i]
            assert r.score == pytest.approx(best) and len(r.states) == min(8, len(set(states)))
            assert r.states[0].score == pytest.approx(best) and [x.score for x in r.states] == sorted((x.score for x in r.states), reverse=True)
            previous = r.f0_hz or previous


def test_path_is_the_best_of_all(spark):
    rng, rows, hyps = random.Random(5), [], []
    for s in range(12):
        at = 0
        for c in range(1, 6):
            start, at = at + rng.choice([0, 480, 4800]), at + 9600
            rows.append((s, c, start, at, rng.random(), 1.0, 0.5))
            hyps += [(s, c, m, round(rng.random() / 8, 3)) for m in rng.sample(range(50, 80), 3)]
            at += 0
    found = spark.createDataFrame(rows, "song_id int, candidate int, start_sample long, end_sample long, confidence double, before_probability double, after_probability double")
    notes = spark.createDataFrame(hyps, "song_id int, candidate int, midi_note long, score double")
    keys = spark.createDataFrame([(s, 0, "major", 0.5) for s in range(6)], "song_id int, tonic int, mode string, confidence double")
    again = spark.createDataFrame([(1, 2, [h[2] for h in hyps if h[:2] == (1, 2)][0], 0.9)], "song_id int, candidate int, midi_note long, strength double")
    got = {}
    for r in melody.best_path(found, notes, keys, again).orderBy("song_id", "candidate").collect():
        got.setdefault(r.song_id, []).append(r.midi_note)

    def worth(s, path):
        total = 0.0
        for c, (m, score) in enumerate(path, 1):
            total += 2 * score + (0.08 * 0.5 if s < 6 and m % 12 in melody.PROFILES["major"] else -0.02)
            if (s, c) == (1, 2):
                total += {0: 0.135, 12: -0.072, 24: -0.072}.get(abs(m - [h[2] for h in hyps if h[:2] == (1, 2)][0]), 0)
            if c > 1 and rows[s * 5 + c - 1][2] - rows[s * 5 + c - 2][3] <= 1440:
                leap = abs(m - path[c - 2][0])
                total -= min(0.25, max(0, leap - 7) * 0.015) + (0.05 if leap in (12, 24) else 0)
        return total

    for s in range(12):
        ways = itertools.product(*([(h[2], h[3]) for h in hyps if h[:2] == (s, c)] for c in range(1, 6)))
        best = max(ways, key=lambda p: worth(s, p))
        scores = {(h[1], h[2]): h[3] for h in hyps if h[0] == s}
        mine = [(m, scores[c, m]) for c, m in enumerate(got[s], 1)]
        assert worth(s, mine) == pytest.approx(worth(s, best))


def test_key_without_notes_and_nulls(spark):
    rows = [("a", 0, 100, None, 0.5), ("b", 0, 100, 200.0, 0.5), ("c", 0, 100, 60.0, None)]
    got = {r.song_id: r for r in melody.estimate_key(spark.createDataFrame(rows, "song_id string, start_sample long, end_sample long, base_midi double, confidence double")).collect()}
    assert got["a"].tonic is None and got["b"].mode is None and got["b"].confidence == 0
    # One pitch class alone ties as the tonic of both modes; minor wins.
    assert (got["c"].tonic, got["c"].mode) == (0, "minor")


def test_candidates_cut_at_boundaries(spark):
    frames = [("a", i, i * 480, i * 480 + 480, 60.0 if i < 10 else 64.0, 0.9, 0.9) for i in range(20)] + [("a", 20, 9600, 10080, None, 0.0, 0.0), ("a", 24, 11520, 12000, 67.0, 0.5, 0.9)]
    cuts = [("a", 4800, 0.7, "sustained_pitch_change", True), ("a", 2400, 0.4, "expressive_motion_suppressed", False), ("a", 11520, 0.9, "strong_boundary", True)]
    got = melody.candidates(
        spark.createDataFrame(frames, "song_id string, idx long, start_sample long, end_sample long, midi double, confidence double, voiced_probability double"),
        spark.createDataFrame(cuts, "song_id string, sample long, probability double, reason string, accepted boolean"),
    ).orderBy("candidate").collect()
    assert [(r.start_sample, r.end_sample, r.base_midi, r.frames) for r in got] == [(0, 4800, 60.0, 8), (4800, 9600, 64.0, 8), (11520, 12000, 67.0, 1)]
    assert [r.before_reason for r in got] == ["voiced_run_edge", "sustained_pitch_change", "strong_boundary"] and got[0].after_probability == 0.7 and got[1].after_probability == 1.0
    assert got[0].confidence == pytest.approx(0.81)


def test_hypotheses_at_the_edges(spark):
    found = spark.createDataFrame([("a", 1, 0, 100, 200.0, 0.5), ("a", 2, 0, 100, 127.0, 0.5), ("a", 3, 0, 100, None, 0.5), ("a", 4, 0, 100, 60.5, 0.0)], "song_id string, candidate int, start_sample long, end_sample long, base_midi double, confidence double")
    outer = spark.createDataFrame([("a", 0, 20, 61, 1.0), ("a", 90, 400, 30, 1.0), ("a", 50, 50, 40, 1.0)], "song_id string, start_sample long, end_sample long, midi_note long, confidence double")
    got = {(r.candidate, r.midi_note) for r in melody.hypotheses(found, outer).collect()}
    assert got == {(1, 61), (2, 61), (4, 61), (2, 126), (2, 127)}
    assert {(r.candidate, r.midi_note) for r in melody.hypotheses(found, outer.where("false")).collect()} == {(1, 200), (2, 126), (2, 127), (4, 60)}
