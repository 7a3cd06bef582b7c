"""Per-song operators against hand-worked cases and plain readings."""
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import SparkSession

from cantata.functions import text
from cantata.operators import folds, matching
from cantata.plans import analysis
from cantata.sources import smf, strict_json

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _points(spark, case):
    return spark.createDataFrame([(s, x) for s, xs in case.items() for x in xs], "song_id string, sample long")


def test_boundaries_of_the_worked_cases(spark):
    ref = {"clean": [4800, 14400, 24000], "low": [7200, 21600], "legato": [9600]}
    pred = {"clean": [4800, 14880, 24000], "low": [7680, 21600, 36000], "legato": [10080]}
    m = matching.point_metrics(matching.match_points(_points(spark, ref), _points(spark, pred), 1440)).first()
    assert (m.true_positive, m.false_positive, m.false_negative) == (6, 1, 0) and m.f1 == pytest.approx(12 / 13) and m.mean_abs_error_ms == pytest.approx(5.0)
    empty = matching.match_points(_points(spark, {}), _points(spark, {}), 1440)
    assert empty.count() == 0


def test_points_match_like_a_plain_search(spark):
    rng = random.Random(1)
    ref = {f"s{k}": sorted(rng.choices(range(300), k=rng.randrange(12))) for k in range(40)}
    pred = {f"s{k}": sorted(rng.choices(range(300), k=rng.randrange(12))) for k in range(40)}
    got = {}
    for r in matching.match_points(_points(spark, ref), _points(spark, pred), 20).collect():
        if r.sample is not None:
            got.setdefault(r.song_id, []).append((r.sample, r.other))
    for s, refs in ref.items():
        free, want = list(enumerate(pred[s])), []
        for x in refs:
            best = min(((abs(p - x), i) for i, p in free if abs(p - x) <= 20), default=None)
            want.append((x, None if best is None else pred[s][best[1]]))
            free = [f for f in free if best is None or f[0] != best[1]]
        assert sorted(got.get(s, []), key=str) == sorted(want, key=str)


def test_notes(spark):
    schema = "song_id string, start_sample long, end_sample long, midi_note long"
    ref = spark.createDataFrame([("a", 0, 24000, 60), ("a", 24000, 48000, 62), ("b", 0, 17760, 69), ("c", 0, 100, 50)], schema)
    pred = spark.createDataFrame([("a", 480, 24000, 60), ("a", 24000, 47520, 74), ("b", 0, 17760, 69), ("d", 0, 10, 40)], schema)
    m = {r.song_id: r for r in matching.note_metrics(matching.match_notes(ref, pred, 2400), "song_id").collect()}
    assert (m["a"].temporal_matches, m["a"].pitch_true_positive, m["a"].octave_error_count, m["a"].pitch_f1) == (2, 1, 1, 0.5)
    assert m["a"].mean_abs_onset_error_ms == pytest.approx(10.0) and m["b"].pitch_f1 == 1.0 and m["b"].octave_error_rate == 0
    assert m["c"].pitch_f1 is None and m["d"].reference_count == 0


def test_notes_match_like_a_plain_search(spark):
    rng = random.Random(9)
    songs = {s: [sorted((a, a + rng.randrange(0, 9000), rng.randrange(60, 63)) for a in (rng.randrange(40000) for _ in range(rng.randrange(25)))) for _ in range(2)] for s in range(60)}

    def plain(refs, preds):
        free, out = list(enumerate(preds)), []
        for r in refs:
            fits = []
            for i, p in free:
                onset, shared = abs(p[0] - r[0]), max(0, min(p[1], r[1]) - max(p[0], r[0]))
                share = shared / max(1, min(r[1] - r[0], p[1] - p[0]))
                fits += [((onset, -share, i), p)] if onset <= 1500 or share >= 0.5 else []
            best = min(fits, default=None)
            out.append((*r, *(best[1] if best else (None,) * 3)))
            free = [x for x in free if not best or x[0] != best[0][2]]
        return out + [(None, None, None, *p) for _, p in free]

    table = lambda k: spark.createDataFrame([(s, *n) for s, sides in songs.items() for n in sides[k]], "song_id int, start_sample long, end_sample long, midi_note long")
    got = {}
    for r in matching.match_notes(table(0), table(1), 1500).collect():
        got.setdefault(r.song_id, []).append(tuple(r)[1:])
    for s, sides in songs.items():
        assert sorted(map(str, got.get(s, []))) == sorted(map(str, plain(*sides)))


def test_songs_side_by_side_match_like_a_sweep_each():
    rng = random.Random(4)
    song, side, start, end = [], [], [], []
    for s, n in enumerate([3, 0, 90, 1, 200, *(rng.randrange(12) for _ in range(200))]):
        for k in range(2):
            for a, b in sorted((a, a + rng.randrange(1, 9000)) for a in (rng.randrange(200 * n + 1) for _ in range(n + k))):
                song.append(s), side.append(k), start.append(a), end.append(b)
    rows = [np.array(x) for x in (song, side, start, end)]
    got, want = matching._taken(*rows, 1500), np.full(len(song), -1)
    for s in range(song[-1] + 1):
        refs, preds = (np.flatnonzero((rows[0] == s) & (rows[1] == k)) for k in range(2))
        spans = [list(zip(rows[2][i].tolist(), rows[3][i].tolist())) for i in (refs, preds)]
        want[refs] = [-1 if i < 0 else preds[i] for i in matching._swept(*spans, 1500)]
    assert (got == want).all() and (got >= 0).sum() > 500


def test_suppression(spark):
    p = [0.1, 0.9, 0.2, 0.95, 0.1, 0.6, 0.6, 0.1]
    rows = [("a", i * 480, x) for i, x in enumerate(p)]
    got = matching.suppress(spark.createDataFrame(rows, "song_id string, sample long, probability double"), 0.5, 1200).collect()
    assert sorted(r.sample for r in got) == [3 * 480, 6 * 480]


def _paired(rows, extend):
    """A plain reading of note pairing, event after event."""
    sounding, held, down, last = {}, {}, set(), max((r["tick"] for r in rows), default=0)
    ticks = {}
    for r in rows:
        ticks.setdefault(r["tick"], []).append(r)

    def close(notes, k, tick, how):
        start, velocity = notes.pop(k)[:2]
        return [(*k, start, tick, velocity, how)] if start < tick else []

    for tick, group in ticks.items():
        late = []
        for r in group:
            k = (r["channel"], r["note"])
            if r["kind"] == "off" and k in sounding:
                if extend and k[0] in down:
                    held[k] = sounding.pop(k)
                else:
                    yield from close(sounding, k, tick, "off")
            elif r["kind"] == "off":
                late.append((k, r["seq"]))
            elif r["kind"] == "sustain" and k[1] >= 64:
                down.add(k[0])
            elif r["kind"] == "sustain" and k[0] in down:
                down.remove(k[0])
                for h in sorted(x for x in held if x[0] == k[0]):
                    yield from close(held, h, tick, "pedal")
        for r in group:
            if r["kind"] == "on":
                k = (r["channel"], r["note"])
                for notes in (sounding, held):
                    if k in notes:
                        yield from close(notes, k, tick, "retrigger")
                sounding[k] = (tick, r["velocity"], r["seq"])
        for k, seq in late:
            if k in sounding and sounding[k][0] == tick and seq > sounding[k][2]:
                sounding.pop(k)
    for notes in (held, sounding):
        for k in sorted(notes):
            yield from close(notes, k, last, "unterminated")


@pytest.mark.parametrize("extend", [True, False])
def test_notes_pair_like_a_plain_reading(spark, extend):
    rng, songs = random.Random(3), {}
    for s in range(300):
        kinds = [rng.choice(["on", "off", "sustain", "on", "off", "other"]) for _ in range(rng.randrange(1, 30))]
        songs[s] = [dict(tick=rng.randrange(1 + rng.choice([2, 8, 40])), seq=q, kind=k, channel=rng.randrange(2), note=rng.choice([0, 64, 127, 63]) if k == "sustain" else rng.randrange(60, 62), velocity=rng.randrange(99)) for q, k in zip(rng.sample(range(100), 30), kinds)]
    want = [(s, *r) for s, rows in songs.items() for r in _paired(sorted(rows, key=lambda r: (r["tick"], r["seq"])), extend)]
    df = spark.createDataFrame([(s, *r.values()) for s, rows in songs.items() for r in rows], "song_id long, tick long, seq long, kind string, channel long, note long, velocity long")
    assert sorted(map(tuple, folds.pair_notes(df, extend=extend).collect())) == sorted(want)


def test_pairing_moves_songs_once_and_needs_no_python(spark):
    plan = analysis.note_pairing(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan parquet") == 1 and "InArrow" not in plan


def test_note_pairing(spark):
    def on(t, s, n):
        return ("a", t, s, "on", 0, n, 80)

    def off(t, s, n):
        return ("a", t, s, "off", 0, n, 0)

    rows = [on(0, 0, 60), off(10, 1, 60), on(10, 2, 60), on(20, 3, 60), off(30, 4, 60), off(40, 5, 61), on(50, 6, 62), off(50, 7, 62), off(60, 8, 63), on(60, 9, 63), on(70, 10, 64), off(90, 11, 1)]
    got = folds.pair_notes(spark.createDataFrame(rows, "song_id string, tick long, seq long, kind string, channel long, note long, velocity long")).collect()
    assert sorted((r.note, r.start_tick, r.end_tick, r.ended) for r in got) == [(60, 0, 10, "off"), (60, 10, 20, "retrigger"), (60, 20, 30, "off"), (63, 60, 90, "unterminated"), (64, 70, 90, "unterminated")]


def test_fragments(spark):
    rows = [("a", 0, 9600, 60, 1.0, 0.0, 0.2), ("a", 9600, 10560, 61, 0.5, 0.2, 0.2), ("a", 10560, 20160, 60, 1.0, 0.2, 0.9), ("a", 20160, 21120, 60, 1.0, 0.9, 0.9), ("a", 40000, 41000, 70, 1.0, 0.0, 0.0)]
    got = folds.merge_fragments(spark.createDataFrame(rows, "song_id string, start_sample long, end_sample long, midi_note long, confidence double, before_probability double, after_probability double"), 2400).collect()
    assert [(r.start_sample, r.end_sample, r.midi_note, r.parts) for r in got] == [(0, 20160, 60, 3), (20160, 21120, 60, 1), (40000, 41000, 70, 1)]
    assert got[0].confidence == pytest.approx((9600 + 480 + 9600) / 20160)


def test_alignment_is_the_best_of_all_paths(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(12):
        p = rng.dirichlet(np.ones(3), 5)
        rows.append((k, np.log(p).tolist(), [[1], [1, 2], [1, 1], [2, 1, 2], [1, 1, 1, 1], []][k % 6]))
    got = {}
    for r in folds.align_segments(spark.createDataFrame(rows, "segment_id long, emissions array<array<double>>, tokens array<int>")).orderBy("segment_id", "position").collect():
        got.setdefault(r.segment_id, []).append((r.start_frame, r.end_frame))
    for k, e, tokens in rows:
        best = None
        for path in itertools.product(range(3), repeat=5):
            if [x for x, _ in itertools.groupby(path) if x] == tokens:
                score = sum(e[t][x] for t, x in enumerate(path))
                if best is None or score > best[0]:
                    best = (score, path)
        spans, at = [], 0
        for x, g in itertools.groupby(best[1] if best else ()):
            n = len(list(g))
            spans += [(at, at + n)] if x else []
            at += n
        assert got.get(k, []) == spans


def test_text(spark):
    pairs = [(1, "Ｈｅｌｌｏ, world!", "hello world"), (2, "", "abc"), (3, "a b c", "a x c d"), (4, None, None), (5, "あ あ", "あああ")]
    df = spark.createDataFrame(pairs, "id long, reference string, hypothesis string")
    got = {r.id: r for r in text.error_rates(text.compare(df, "id"), "id").collect()}
    assert got[1].cer == got[1].wer == 0 and got[2].cer is None and got[2].inserted == 3 and (got[3].word_errors, got[3].reference_words) == (2, 3)
    assert got[4].cer == 0.0 and got[5].char_errors == 1
    edits = spark.createDataFrame([("kitten", "sitting"), ("x" * 3000, "y" * 3000), ("é😀", "e😀")], "a string, b string").select(text.edits("a", "b").alias("n")).collect()
    assert [r.n for r in edits] == [3, None, 1]
    many = [str(i) for i in range(60000)]
    a, b = text.letters(many, many[::-1])
    assert len(set(a)) == 60000 and a == b[::-1] and a.encode()


def test_text_beyond_the_budget_is_no_perfect_match(spark):
    pairs = [("song", 1, "abcd", "abcd"), ("song", 2, "x" * 2100, "y" * 2100), ("words", 1, "a b", "a c"), ("long", 1, "a " * 2100, "b " * 1900), ("sole", 1, "x" * 2000, "x" * 2000)]
    df = spark.createDataFrame(pairs, "song string, id long, reference string, hypothesis string")
    got = {r.song: r for r in text.error_rates(text.compare(df, "song", "id"), "song").collect()}
    assert (got["song"].cer, got["song"].over_budget, got["song"].reference_chars) == (None, 1, 2104) and got["song"].wer == 0.5
    assert (got["words"].cer, got["words"].wer, got["words"].over_budget) == (0.5, 0.5, 0) and (got["sole"].cer, got["sole"].over_budget) == (0.0, 0)
    assert got["long"].cer == 1.0 and got["long"].over_budget == 0


def test_strict_json():
    read = lambda t: strict_json.read(t, 100)[0]
    assert [read(t) for t in ('{"a": 1}', None, "[1]", '{"a":1,"a":2}', '{"a":NaN}', '{"a":1e999}', "{", "{" + " " * 200 + "}")] == ["ok", "missing", "not_an_object", "duplicate_key", "not_finite", "overflow", "invalid", "too_large"]
    assert strict_json.read('{"b": 1, "a": [1.0]}', 100)[1:] == strict_json.read('{"a":[1.0],"b":1}', 100)[1:]


def test_smf(spark):
    def chunk(name, body):
        return name + len(body).to_bytes(4, "big") + body

    head = chunk(b"MThd", bytes([0, 0, 0, 1, 1, 0xE0]))
    track = bytes([0, 0xFF, 0x51, 3, 0x07, 0xA1, 0x20, 0, 0x90, 60, 80, 0x83, 0x60, 60, 0, 0, 0x90, 62, 80, 0x83, 0x60, 0x80, 62, 0, 0, 0xFF, 0x2F, 0])
    files = [("good", head + chunk(b"junk", b"x") + chunk(b"MTrk", track)), ("cut", head + chunk(b"MTrk", track)[:-3]), ("none", None), ("end", head + chunk(b"MTrk", track[:-4]))]
    rows = smf.events(spark.createDataFrame(files, "path string, content binary")).collect()
    assert [r.kind for r in rows if r.path != "good"] == ["error"] * 3
    good = [(r.tick, r.kind, r.note, r.velocity) for r in rows if r.path == "good"]
    assert good == [(0, "tempo", None, 500000), (0, "on", 60, 80), (480, "off", 60, 0), (480, "on", 62, 80), (960, "off", 62, 0), (960, "end", None, None)]


@pytest.mark.parametrize("name", sorted(analysis.QUERIES))
def test_query_runs(spark, name):
    got = analysis.QUERIES[name](spark, DATA).toPandas()
    assert len(got) and got.nunique(dropna=False).max() > 1


def test_repeats_like_a_plain_search(spark):
    from pyspark.sql import functions as F
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab c", k=rng.randrange(30))) for _ in range(300)] + [None, "", "la la　la\nla", "x" * 1000000, "".join(chr(0x4E00 + i) for i in range(20000)), ("0123456789" * 4)[:33] * 4, ("abcdefghijklmnopqrstuvwxyzABCDEFGH"[:33]) * 4]
    got = [r.r for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.repeats(F.col("t")).alias("r")).orderBy("i").collect()]

    def plain(t):
        t = "".join((t or "").split())[:2000]
        return any(t[i:i + n] * 4 == t[i:i + 4 * n] for n in range(1, 33) for i in range(len(t) - 4 * n + 1))

    assert got == [plain(t) for t in texts] and got[302] and got[303] and not got[-1]
