"""The alignment ladder and staged pipelines: each status, early filters, broken and changed stages, reruns."""
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession, functions as F

from cantata.operators import folds, ladder
from cantata.plans import songs
from cantata.sources import stages
from cantata.sources.publish import work_path

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def _emissions(path, tokens=3, p=0.9):
    """Frames that prefer the tokens of a path."""
    rest = (1 - p) / (tokens - 1)
    return [[float(np.log(p if t == k else rest)) for t in range(tokens)] for k in path]


def _inputs(spark):
    seg = [
        ("ok", "a B!", 1000, 2000), ("none", " ..", 0, 10), ("nulltext", None, 0, 10), ("silent", "ab", 0, 10), ("empty", "ab", 0, 10), ("large", "a" * 513, 0, 10), ("most", "a" * 512, 0, 513), ("oov", "xa b?é", 0, 10), ("path", "aaa", 0, 10),
        ("low", "ab", 0, 100), ("first", "..", 0, 5), ("long", "ab" * 100, 0, 4000),
    ]
    em = [
        ("ok", _emissions([0, 1, 1, 0, 2, 0])), ("none", _emissions([0])), ("empty", []), ("large", _emissions([1])), ("most", _emissions([1])), ("oov", _emissions([1, 2])), ("path", _emissions([1, 1, 1, 1])), ("low", _emissions([1, 0, 0], p=0.99)), ("first", []),
        ("long", _emissions([1, 2] * 100)), ("stray", _emissions([1])),
    ]
    return (spark.createDataFrame(seg, "segment_id string, text string, start_sample long, end_sample long"), spark.createDataFrame(em, "segment_id string, emissions array<array<double>>"), spark.createDataFrame([("a", 1), ("b", 2)], "char string, token int"))


def test_every_step_of_the_ladder(spark):
    got = {r.segment_id: r for r in ladder.align(*_inputs(spark)).collect()}
    assert {k: r.reason for k, r in got.items()} == {
        "ok": None, "none": "no_alignable_text", "nulltext": "no_alignable_text", "first": "no_alignable_text", "silent": "digital_silence_or_too_short", "empty": "digital_silence_or_too_short",
        "large": "text_window_too_large", "most": "no_ctc_path", "oov": "out_of_vocabulary", "path": "no_ctc_path", "low": "low_acoustic_score", "long": None,
    }
    assert all((r.status == "aligned") == (r.reason is None) and (r.start_sample is None) == (r.reason is not None) for r in got.values())
    ok = got["ok"]
    # Frames 1 to 3 and 4 to 5 of six, over 1,000 samples from 1,000 on.
    assert (ok.start_sample, ok.end_sample, ok.frames) == (1167, 1833, 6)
    assert [(c.char, c.char_start, c.char_end, c.start_sample, c.end_sample, round(c.score, 6)) for c in ok.characters] == [("a", 0, 1, 1167, 1500, 0.9), ("b", 2, 3, 1667, 1833, 0.9)]
    assert got["oov"].unsupported == ["x", "é"] and got["ok"].unsupported is None
    low = got["low"].characters
    assert [c.status for c in low] == ["aligned", "unaligned"] and low[1].start_sample is None and low[1].observed_start is not None and low[1].score < 0.05
    assert (got["long"].start_sample, got["long"].end_sample, len(got["long"].characters)) == (0, 4000, 200)
    assert ladder.align(*[df.limit(0) for df in _inputs(spark)[:2]], _inputs(spark)[2]).count() == 0


def test_costly_step_gets_what_the_rules_left(spark, monkeypatch):
    seen = []
    real = folds.align_segments

    def watched(work, *more):
        seen.extend(r.segment_id for r in work.select("segment_id").collect())
        return real(work, *more)

    monkeypatch.setattr(folds, "align_segments", watched)
    ladder.align(*_inputs(spark)).count()
    assert sorted(seen) == ["long", "low", "most", "ok", "path"]


def _plain_path(p, tokens):
    """(first frame, last frame + 1, mean probability) of each token of the best path, state by state; of equal sums the one that stays, then the nearer one, and an end in the blank."""
    labels = [0] + [x for t in tokens for x in (t, 0)]
    best, ways = [0.0] + [-np.inf] * (len(labels) - 1), []
    for row in p:
        now, way = [], []
        for s, x in enumerate(labels):
            steps = [(best[s], 0)] + [(best[s - 1], 1)] * (s > 0) + [(best[s - 2], 2)] * (s > 1 and x != 0 and x != labels[s - 2])
            top, step = max(steps, key=lambda v: (v[0], -v[1]))
            now.append(top + row[x])
            way.append(step)
        best, ways = now, [*ways, way]
    at = len(labels) - (1 if best[-1] >= best[-2] else 2)
    if not np.isfinite(best[at]):
        return None
    path = []
    for way in reversed(ways):
        path.append(at)
        at -= way[at]
    path = np.array(path[::-1])
    spans = [np.flatnonzero(path == 2 * k + 1) for k in range(len(tokens))]
    return [(f[0], f[-1] + 1, float(np.exp(p[f, t]).mean())) for f, t in zip(spans, tokens)]


def test_segments_side_by_side_find_their_own_paths():
    rng, met = np.random.default_rng(9), set()
    for _ in range(12):
        p, tokens = [], []
        for _ in range(rng.integers(1, 70)):
            frames, labels = int(rng.integers(1, 40)), int(rng.integers(2, 6))
            one = np.log(rng.choice([0.1, 0.25, 0.5], (frames, labels)))
            one[rng.random(one.shape) < 0.1] = -np.inf
            p.append(one)
            tokens.append(rng.integers(1, labels, int(rng.integers(1, 18))))
        for one, t, got in zip(p, tokens, folds.align(p, tokens, 0)):
            want = _plain_path(one, t.tolist())
            met.add(want is None)
            assert (got is None) if want is None else list(zip(*(x.tolist() for x in got))) == want
    assert met == {True, False}


def test_emissions_made_by_a_column_are_those_of_a_table_and_are_not_moved(spark):
    seg, em, vocabulary = _inputs(spark)
    own = seg.join(em, "segment_id", "left").localCheckpoint()
    want, got = (sorted(map(str, df.collect())) for df in (ladder.align(seg, em, vocabulary), ladder.align(own, F.col("emissions"), vocabulary)))
    assert want == got and len(got) == 12
    plan = songs.alignment_ladder(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    # Segments are dealt out once, below all that makes arrays of letters and frames.
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "ln(" not in plan.lower().split("exchange hashpartitioning")[1] and "chars" not in plan.split("Exchange hashpartitioning")[1]


def test_ladder_query_meets_every_reason(spark):
    got = {r.reason for r in songs.alignment_ladder(spark, "/root/testdata/sf0.01").select("reason").distinct().collect()}
    assert got >= {None, "digital_silence_or_too_short", "out_of_vocabulary", "no_ctc_path", "low_acoustic_score"}


def _small(spark, n=5):
    return {"base": spark.createDataFrame([(i, i * 10) for i in range(n)], "song_id int, v int")}


def _chain(broken=None, seen=None, options=None):
    """Three stages; one of them may be broken."""
    say = lambda name, df: (seen.append(name) if seen is not None else None, df)[1]
    digest = F.sha2(F.col("v").cast("string"), 256)
    first = lambda base: say("first", base.withColumn("digest", digest))

    def second(first):
        out = first.select("song_id", (F.col("v") + 1).alias("w"), F.col("digest").alias("input_digest"))
        if broken == "other":
            out = out.withColumn("input_digest", F.when(F.col("song_id") == 3, "x").otherwise(F.col("input_digest")))
        return say("second", out.drop("w") if broken == "column" else out)

    def third(second, first):
        if broken == "crash":
            raise OSError("gone")
        return say("third", second.join(first.select("song_id", "v"), "song_id"))

    S = stages.Stage
    return [S("first", ("base",), first, ("digest",)), S("second", ("first",), second, ("w",), options or {}, "first"), S("third", ("second", "first"), third, made_from="first")]


def test_rerun_takes_up_finished_stages(spark):
    root, seen, calls = work_path(spark, "stages"), [], []
    with pytest.raises(OSError):
        stages.run(spark, root, _small(spark), _chain("crash", seen))
    assert seen == ["first", "second"]
    out = stages.run(spark, root, _small(spark), _chain(seen=seen), calls=calls)
    assert seen == ["first", "second", "third"] and calls == ["third"] and sorted((r.song_id, r.w, r.v) for r in out["third"].collect()) == [(i, i * 10 + 1, i * 10) for i in range(5)]
    stages.run(spark, root, _small(spark), _chain(seen=seen), calls=calls)
    assert calls == ["third"]
    # Other options make the stage, and what needs it, again; other sources make all again.
    stages.run(spark, root, _small(spark), _chain(options={"x": 1}), calls=calls)
    assert calls == ["third", "second"]  # its rows are the same, so the third stage has the same inputs
    stages.run(spark, root, _small(spark, 6), _chain(), calls=calls)
    assert calls == ["third", "second", "first", "second", "third"]
    assert stages.fingerprint(_chain(), _small(spark)) == stages.fingerprint(_chain("crash"), {"base": _small(spark)["base"].repartition(7)}) != stages.fingerprint(_chain(options={"x": 1}), _small(spark))


@pytest.mark.parametrize("broken, code", [("column", "invalid_stage"), ("other", "input_mismatch")])
def test_broken_stage_stops_the_next(spark, broken, code):
    root, seen = work_path(spark, "stages"), []
    for _ in range(2):  # a broken stage is not taken up as finished either
        with pytest.raises(stages.StageError) as e:
            stages.run(spark, root, _small(spark), _chain(broken, seen))
        assert e.value.code == code and "third" not in seen
    assert stages.run(spark, root, _small(spark), _chain())["third"].count() == 5


def test_changed_stage_is_seen(spark):
    root = work_path(spark, "stages")
    stages.run(spark, root, _small(spark), _chain())
    part = next(Path(root.removeprefix("file://"), "first/data").glob("*/part-*.parquet"))
    part.with_name("part-again.parquet").write_bytes(part.read_bytes())
    with pytest.raises(stages.StageError, match="first is not what it was"):
        stages.run(spark, root, _small(spark), _chain())
    part.with_name("part-again.parquet").unlink()
    stages.run(spark, root, _small(spark), _chain())
    part.unlink()
    with pytest.raises(stages.StageError, match="input_changed"):
        stages.run(spark, root, _small(spark), _chain())


def test_stages_have_to_fit(spark):
    S = stages.Stage
    for wrong in ([S("base", ("base",), lambda b: b)], [S("x", ("nothing",), lambda b: b)]):
        with pytest.raises(stages.StageError, match="invalid_stage"):
            stages.run(spark, work_path(spark, "stages"), _small(spark), wrong)
