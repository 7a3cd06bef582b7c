"""Fingerprints, plan merging, diff lines and the pedal: worked cases and plain readings."""
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import SparkSession, functions as F

from cantata.operators import folds
from cantata.plans import identity, notes
from cantata.plans.melody import _view

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def _sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_reference_fingerprint_is_that_of_canonical_json(spark):
    texts = [("b", 'say "x"\n\té\\'), ("a", "z"), ("a", None), ("c", ""), ("a", "z")]
    want = _sha(identity.DOMAIN + json.dumps(sorted(([i, t] for i, t in texts), key=lambda x: (x[0], x[1] is not None, x[1] or "")), ensure_ascii=False, separators=(",", ":")))
    for order in (texts, texts[::-1]):
        df = spark.createDataFrame([(1, i, t) for i, t in order], "k int, i string, t string").repartition(3)
        assert [tuple(r) for r in identity.reference_fingerprint(df, "k", "i", "t").collect()] == [(1, 5, want)]


def test_stage_fingerprint_forgets_artifacts_and_key_order(spark):
    schema = "k int, n int, model string, options map<string,string>, source string"
    one = lambda k, options, model="m", n=1: (k, n, model, options, "s")
    rows = [one(1, {"b": "1", "a": None, "x_artifact": "p"}), one(2, {"a": None, "b": "1", "y_artifact": "q"}), one(3, {"a": "", "b": "1"}), one(4, {"a": None, "b": "1"}, 'm"'), one(5, {"a": None, "b": "1"}), one(5, {}, "m", 2), one(6, {}, "m", 1), one(6, {"a": None, "b": "1"}, "m", 2)]
    got = {r.k: r.fingerprint for r in identity.stage_fingerprint(spark.createDataFrame(rows, schema), "k", "n", "source").collect()}
    plain = {"pipeline_version": 1, "source": "s", "stages": [{"model": "m", "options": {"a": None, "b": "1"}}]}
    assert got[1] == got[2] == _sha(json.dumps(plain, separators=(",", ":"))) and len(set(got.values())) == 5


def test_plan_takes_up_what_it_lacks(spark):
    cases = [
        ({"p": {"source": "r", "model": None}}, {"p": {"model": "late", "device": "gpu", "w": None}, "q": {"device": "x"}}, {"p": {"source": "r", "model": None, "device": "gpu"}}),
        ({"p": {}}, None, {"p": {}}), ({"p": {"a": "1"}}, {}, {"p": {"a": "1"}}), ({}, {"p": {"a": "1"}}, {}), (None, {"p": {"a": "1"}}, None), ({"p": None}, {"p": {"a": "1"}}, {}),
    ]
    kind = "map<string,map<string,string>>"
    df = spark.createDataFrame([(i, p, r) for i, (p, r, _) in enumerate(cases)], f"i int, plan {kind}, report {kind}")
    got = {r.i: r.m for r in df.select("i", identity.merge_runtime(F.col("plan"), F.col("report")).alias("m")).collect()}
    assert got == {i: w for i, (*_, w) in enumerate(cases)}


def _plain_lines(diff):
    out, path, n = [], None, None
    for t in re.split(r"\r\n|\n|\r", diff):
        if t.startswith("diff --git "):
            path = n = None
        elif t.startswith("+++ b/"):
            path = t[6:]
        elif t.startswith("+++ /dev/null"):
            path = n = None
        elif t.startswith("@@ "):
            m = re.search(r"\+(\d+)(?:,\d+)?\s+@@", t)
            n = int(m.group(1)) if m else None
        elif path is not None and n is not None and t[:1] in ("+", " "):
            out += [(path, n)] * (t[0] == "+")
            n += 1
    return out


def test_added_lines(spark):
    golden = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +3,4 @@ def f\n+one\n kept\n-gone\n+two\n@@ -9 +20 @@\n+three\ndiff --git a/y b/y\n+++ /dev/null\n@@ -1 +1 @@\n+no\n+++ b/z\n+no number\n@@ bad\n+no\n@@ -0,0 +1 @@\n+yes"
    rng = random.Random(2)
    lines = ["diff --git a/x b/x", "+++ b/x", "+++ b/y z", "+++ /dev/null", "@@ -1 +7 @@", "@@ -1,2 +30,9 @@ f", "@@ none", "+a", "+", " b", "-c", "", "+++ b", "\\ No newline"]
    diffs = [golden, "", "+x", None] + [rng.choice(["\n", "\r\n"]).join(rng.choices(lines, k=rng.randrange(40))) for _ in range(300)]
    got = {}
    for r in identity.added_lines(spark.createDataFrame(list(enumerate(diffs)), "i int, diff string"), "i").collect():
        got.setdefault(r.i, []).append((r.path, r.line))
    assert sorted(got[0]) == [("x", 3), ("x", 5), ("x", 20), ("z", 1)]
    for i, d in enumerate(diffs):
        assert sorted(got.get(i, [])) == sorted(set(_plain_lines(d or ""))), d


def _paired(spark, events, extend):
    rows = [(1, t, s, k, c, n, 80) for s, (t, k, c, n) in enumerate(events)]
    df = spark.createDataFrame(rows, "song_id int, tick long, seq long, kind string, channel long, note long, velocity long")
    return sorted((r.channel, r.note, r.start_tick, r.end_tick, r.ended) for r in folds.pair_notes(df, extend=extend).collect())


def test_pedal_holds_notes(spark):
    events = [(0, "on", 0, 60), (5, "sustain", 0, 64), (10, "off", 0, 60), (12, "on", 0, 62), (12, "on", 1, 62), (14, "off", 1, 62), (15, "on", 0, 60), (18, "off", 0, 60), (20, "off", 0, 62), (30, "sustain", 0, 63), (31, "sustain", 0, 0), (40, "end", 0, 0)]
    assert _paired(spark, events, False) == [(0, 60, 0, 10, "off"), (0, 60, 15, 18, "off"), (0, 62, 12, 20, "off"), (1, 62, 12, 14, "off")]
    assert _paired(spark, events, True) == [(0, 60, 0, 15, "retrigger"), (0, 60, 15, 30, "pedal"), (0, 62, 12, 30, "pedal"), (1, 62, 12, 14, "off")]
    # A pedal that stays down holds to the end; one that goes down with the off holds it, one that goes up with it does not.
    assert _paired(spark, [(0, "on", 0, 60), (4, "sustain", 0, 127), (4, "off", 0, 60), (9, "end", 0, 0)], True) == [(0, 60, 0, 9, "unterminated")]
    assert _paired(spark, [(0, "sustain", 0, 127), (0, "on", 0, 60), (4, "sustain", 0, 0), (4, "off", 0, 60), (9, "end", 0, 0)], True) == [(0, 60, 0, 4, "off")]


def test_every_reason_of_a_boundary_is_met(spark):
    got = {r.reason for r in _view(spark, DATA.replace("0.001", "0.01"), ["boundary", "note"], notes.Q["boundary_decision"][2]).select("reason").distinct().collect()}
    assert got == {"strong_boundary", "silence_or_breath", "sustained_pitch_change", "external_transition", "expressive_motion_suppressed"}
