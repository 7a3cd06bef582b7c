"""Queries from pitch observations to notes; ORACLE holds SQL of another form for those that SQL can express."""
from pyspark.sql import functions as F

from cantata.sources.publish import work_path
from cantata.operators import folds, melody

from . import notes, views

ORACLE = {}


def _view(spark, d, needs, body, **own):
    """SQL over views of the driver tables of one folder, read by path; `own` gives views another text."""
    sql = views.with_views(needs, body, views.DEALT | own)
    for t in {t for n in views.closure(needs) for t in views.SOURCES[n]}:
        sql = sql.replace(f"FROM {t}", f"FROM parquet.`{d}/{t}.parquet`")
    return spark.sql(sql)


def f0_fusion(spark, d):
    """Two detectors: the second is a little sharp, an octave up at every fifth event, and silent at every seventh."""
    body = """
        SELECT song_id, idx, 'first' AS detector, f0_hz * 2 AS hz, confidence, voiced_probability, 1.0E0 AS reliability FROM pitch_frame
        UNION ALL SELECT song_id, idx, 'second', CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN f0_hz * 4 ELSE f0_hz * 2.004 END, 1 - confidence / 2, voiced_probability, 0.85E0 FROM pitch_frame"""
    return melody.fuse(_view(spark, d, ["pitch_frame"], body)).drop("states").withColumns({c: F.round(c, 6) for c in ("f0_hz", "confidence", "voiced_probability", "score")})


_NOTES = "SELECT song_id, seq AS candidate, start_sample, end_sample, midi_note + (seq % 3 - 1) * 0.3E0 AS base_midi, confidence FROM note"


def key_estimate(spark, d):
    return melody.estimate_key(_view(spark, d, ["note"], _NOTES)).withColumn("confidence", F.round("confidence", 6))


_PROFILES = ", ".join(f"({i}, {w.get(i, melody.OUTSIDE)}, '{m}')" for m, w in melody.PROFILES.items() for i in range(12))
ORACLE["key_estimate"] = views.with_views(["note"], f"""
    WITH p AS (SELECT * FROM (VALUES {_PROFILES}) p(degree, worth, mode)), c AS ({_NOTES}),
    h AS (SELECT song_id, CAST(round_even(base_midi, 0) AS BIGINT) % 12 AS pc, sum((end_sample - start_sample) * greatest(0.05, confidence)) AS weight FROM c GROUP BY ALL),
    s AS (SELECT song_id, tonic, mode, round(sum(CAST(weight AS DOUBLE) * CAST(worth AS DOUBLE)), 6) AS score, sum(weight) AS total FROM h CROSS JOIN range(12) t(tonic) JOIN p ON (pc + 12 - tonic) % 12 = degree GROUP BY ALL),
    r AS (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY song_id ORDER BY score DESC, tonic DESC, mode DESC))
    SELECT song_id, CAST(tonic AS INT) AS tonic, mode, round(least(1, (score - second) / greatest(total, abs(score), 1)), 6) AS confidence FROM r WHERE r = 1""")

_PAIRS = """SELECT DISTINCT song_id, 1 AS pair, 0 AS source_start, 40000 AS source_end, 40000 AS repeat_start, 90000 AS repeat_end, 0.8E0 AS confidence FROM note
    UNION ALL SELECT DISTINCT song_id, 2, 0, 30000, 60000, 84000, 0.6E0 FROM note"""


def repetition_priors(spark, d):
    found = melody.priors(_view(spark, d, ["note"], _NOTES), _view(spark, d, ["note"], _PAIRS))
    return found.withColumn("strength", F.round("strength", 6))


ORACLE["repetition_priors"] = views.with_views(["note"], f"""
    WITH c AS (SELECT *, (start_sample + end_sample) / 2 AS middle, (start_sample + end_sample) // 2 AS center FROM ({_NOTES})), p AS ({_PAIRS}),
    j AS (SELECT r.song_id, r.candidate, p.pair, s.candidate AS source, s.base_midi, p.confidence * s.confidence AS strength,
            row_number() OVER (PARTITION BY r.song_id, r.candidate, p.pair ORDER BY round(abs(s.middle - (source_start + (r.center - repeat_start) / (repeat_end - repeat_start) * (source_end - source_start))), 6), s.middle, s.candidate) AS n
          FROM c r JOIN p USING (song_id) JOIN c s USING (song_id) WHERE r.center >= repeat_start AND r.center < repeat_end AND s.center >= source_start AND s.center < source_end)
    SELECT song_id, candidate, source, CAST(round_even(base_midi, 0) AS BIGINT) AS midi_note, round(strength, 6) AS strength FROM (SELECT *, max(pair) OVER (PARTITION BY song_id, candidate) AS last FROM j WHERE n = 1) WHERE pair = last""")


def _candidates(spark, d, **own):
    frames = _view(spark, d, ["pitch_frame"], "SELECT song_id, idx, idx * 480 AS start_sample, idx * 480 + 480 AS end_sample, midi, confidence, voiced_probability FROM pitch_frame")
    return melody.candidates(frames, _view(spark, d, ["boundary", "note"], notes.Q["boundary_decision"][2], **own))


def note_candidates(spark, d):
    return _candidates(spark, d).withColumns({c: F.round(c, 6) for c in ("base_midi", "confidence", "spread_cents", "before_probability", "after_probability")})


ORACLE["note_candidates"] = views.with_views(["boundary", "note"], f"""
    {notes.ORACLE["boundary_decision"].replace("WITH", "WITH d AS (WITH", 1)}),
    ok AS (SELECT * FROM d WHERE accepted), v AS (SELECT * FROM pitch_frame WHERE midi IS NOT NULL AND voiced_probability >= 0.6),
    s AS (SELECT song_id, idx FROM v WHERE NOT EXISTS (SELECT 1 FROM v p WHERE p.song_id = v.song_id AND p.idx BETWEEN v.idx - 3 AND v.idx - 1)),
    e AS (SELECT v.*, (SELECT count(*) FROM s WHERE s.song_id = v.song_id AND s.idx <= v.idx) AS run FROM v),
    u AS (SELECT song_id, run, min(idx) * 480 AS lo, max(idx) * 480 + 480 AS hi FROM e GROUP BY ALL),
    cut AS (SELECT song_id, run, lo AS p FROM u UNION SELECT song_id, run, hi FROM u UNION SELECT u.song_id, run, sample FROM u JOIN ok ON ok.song_id = u.song_id AND sample > lo AND sample < hi),
    seg AS (SELECT song_id, run, p AS a, lead(p) OVER (PARTITION BY song_id, run ORDER BY p) AS b FROM cut),
    l AS (SELECT seg.song_id, seg.run, a, b, list({{'m': midi, 'w': greatest(0.01, confidence * voiced_probability), 's': confidence * voiced_probability, 'i': idx}} ORDER BY idx) AS l FROM seg JOIN e ON e.song_id = seg.song_id AND e.run = seg.run AND idx * 480 + 240 >= a AND idx * 480 + 240 < b GROUP BY ALL),
    k AS (SELECT song_id, run, a, b, list_slice(l, 1 + t, len(l) - t) AS l FROM (SELECT *, CASE WHEN len(l) >= 15 THEN 2 WHEN len(l) >= 7 THEN 1 ELSE 0 END AS t FROM l)),
    x AS (SELECT song_id, run, a, b, unnest(l) AS f FROM k), y AS (SELECT *, sum(f.w) OVER (PARTITION BY song_id, run, a ORDER BY f.m, f.w, f.i ROWS UNBOUNDED PRECEDING) AS through, sum(f.w) OVER (PARTITION BY song_id, run, a) AS total FROM x),
    z AS (SELECT *, min(f.m) FILTER (through >= total / 2) OVER (PARTITION BY song_id, run, a) AS base FROM y)
    SELECT z.song_id, CAST(row_number() OVER (PARTITION BY z.song_id ORDER BY z.a) AS INT) AS candidate, run, a AS start_sample, b AS end_sample, round(base, 6) AS base_midi,
      round(sum(f.s * f.w) / sum(f.w) * (0.65 + 0.35 * exp(-0.5 * (median(abs(f.m - base)) * 100 / 65) ** 2)), 6) AS confidence, round((max(f.m) - min(f.m)) * 100, 6) AS spread_cents, count(*) AS frames,
      round(coalesce(max(o.probability), 1), 6) AS before_probability, coalesce(max(o.reason), 'voiced_run_edge') AS before_reason, round(coalesce(max(q.probability), 1), 6) AS after_probability, coalesce(max(q.reason), 'voiced_run_edge') AS after_reason
    FROM z LEFT JOIN ok o ON o.song_id = z.song_id AND o.sample = a LEFT JOIN ok q ON q.song_id = z.song_id AND q.sample = b GROUP BY z.song_id, run, a, b, base""")


def _external(spark, d, **own):
    return _view(spark, d, ["note"], "SELECT song_id, seq, start_sample, end_sample, midi_note, confidence FROM note", **own)


#: Many scores are short decimals that end in 5, whose halves engines round either way; so millionths begin off the decimals.
_OFF = 0.4142135623731


def note_hypotheses(spark, d):
    own = _view(spark, d, ["note"], _NOTES)
    return melody.hypotheses(own, _external(spark, d).withColumn("start_sample", F.col("start_sample") + 3000)).withColumn("score", F.floor(F.col("score") * 1e6 + _OFF) / 1e6)


# A quarter of the shorter span; doubts multiply
ORACLE["note_hypotheses"] = views.with_views(["note"], f"""
    WITH c AS ({_NOTES}), x AS (SELECT song_id, seq, start_sample + 3000 AS a, end_sample AS b, midi_note, confidence FROM note),
    own AS (SELECT song_id, candidate, n AS midi_note, confidence * exp(-0.5 * ((base_midi - n) * 100 / 45) ** 2) AS score FROM c CROSS JOIN range(0, 128) r(n) WHERE abs(n - round_even(base_midi, 0)) <= 1),
    o AS (SELECT c.song_id, c.candidate, x.midi_note, (least(b, end_sample) - greatest(a, start_sample)) / greatest(1, least(b - a, end_sample - start_sample)) AS share, x.confidence FROM c JOIN x USING (song_id) WHERE b > a AND b > start_sample AND end_sample > a),
    w AS (SELECT song_id, candidate, midi_note, score FROM own WHERE score > 0.005 UNION ALL SELECT song_id, candidate, midi_note, 0.85 * confidence * (0.55 + 0.45 * share) FROM o WHERE share >= 0.25)
    SELECT song_id, candidate, midi_note, floor((1 - product(1 - score)) * 1e6 + {_OFF}) / 1e6 AS score FROM w GROUP BY ALL""")


def _written(spark, name, df):
    """The path of a table that several steps read, written once."""
    path = work_path(spark, name)
    df.write.parquet(path)
    return path


def _notes_of_heard_songs(spark, d):
    """The path of the imported notes of songs with a pitch. A candidate comes from frames with a pitch, and notes only cut or explain candidates of their own song, so the rest of the notes are left out before they are moved and numbered.

    The songs are written first, so that their size is known when Spark chooses how to join them.
    """
    songs = _written(spark, "songs", _view(spark, d, ["pitch_frame"], "SELECT DISTINCT song_id FROM pitch_frame WHERE midi IS NOT NULL"))
    heard = views.DEALT["note"].replace("FROM lineitem", f"FROM lineitem LEFT SEMI JOIN parquet.`{songs}` s ON l_orderkey = s.song_id")
    return _written(spark, "notes", _external(spark, d, note=heard))


def note_path(spark, d):
    """Candidates, hypotheses with imported notes, key and repetition bonus, best path."""
    imported = f"SELECT * FROM parquet.`{_notes_of_heard_songs(spark, d)}`"
    # Written once: keys, hypotheses, priors and the path all read them.
    found = _candidates(spark, d, note=imported)
    found = spark.read.schema(found.schema).parquet(_written(spark, "candidates", found))
    pairs = found.select("song_id").distinct().selectExpr("song_id", "1 AS pair", "0 AS source_start", "9600 AS source_end", "9600 AS repeat_start", "24000 AS repeat_end", "0.8D AS confidence")
    best = melody.best_path(found, melody.hypotheses(found, _external(spark, d, note=imported)), melody.estimate_key(found), melody.priors(found, pairs))
    return best.withColumn("confidence", F.round("confidence", 6))


def recovered_notes(spark, d):
    """The path with weak fragments merged: the notes of a song."""
    return folds.merge_fragments(note_path(spark, d), 3840).withColumn("confidence", F.round("confidence", 6))


QUERIES = {f.__name__: f for f in (f0_fusion, key_estimate, repetition_priors, note_candidates, note_hypotheses, note_path, recovered_notes)}
