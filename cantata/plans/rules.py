"""Checks, comparisons and signals of the song data by their full rules; ORACLE holds a second reading of each in another form."""

Q, ORACLE = {}, {}


def _q(name, needs, tables, sql, oracle):
    Q[name], ORACLE[name] = (needs, tables, sql), oracle


# Cents between two frequencies; a pair that has none says so
_q("cents_between", ["pitch_frame"], [], """
    SELECT event_id, CASE WHEN a > 0 AND b > 0 THEN round(1200 * log2(a / b), 6) END AS cents, CASE WHEN a > 0 AND b > 0 THEN 'ok' ELSE 'not_positive' END AS status FROM (SELECT event_id, value AS a, value - 20 AS b FROM pitch_frame) p""",
   """
    SELECT event_id, round((ln(a) - ln(b)) / ln(2) * 1200, 6) AS cents, 'ok' AS status FROM (SELECT event_id, value AS a, value - 20 AS b FROM pitch_frame) WHERE least(a, b) > 0 AND a IS NOT NULL AND b IS NOT NULL
    UNION ALL SELECT event_id, NULL, 'not_positive' FROM pitch_frame WHERE NOT coalesce(value > 20, false)""")

# Stream to song samples by the anchor of the domain in the current epoch; halves away from zero
_CLOCK = """
    moment AS (SELECT song_id, event_id, idx, CAST(floor(idx / 40) AS BIGINT) AS now, CAST(floor(idx / 40) AS BIGINT) - CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS epoch, CASE WHEN event_id % 3 = 0 THEN 'capture' ELSE 'output' END AS domain, event_type FROM pitch_frame),
    anchor AS (SELECT song_id, now AS epoch, domain, min(idx) AS at, CAST(max(event_id % 401) - 300 AS BIGINT) AS ppm, CAST(min(event_id % 997) * 60 - 30000 AS BIGINT) AS latency FROM moment WHERE event_type = 'click' GROUP BY song_id, now, domain)"""
_q("clock_map", ["pitch_frame"], [], f"""
    WITH {_CLOCK}, mapped AS (
      SELECT m.song_id, m.event_id, m.epoch, m.now, a.at, a.at * 470 + CASE WHEN d >= 0 THEN (d + 500000) div 1000000 ELSE -((500000 - d) div 1000000) END + a.latency AS sample FROM (
        SELECT m.*, (m.idx * 480 - coalesce(a.at, 0) * 480) * (1000000 + coalesce(a.ppm, 0)) AS d FROM moment m LEFT JOIN anchor a ON a.song_id = m.song_id AND a.epoch = m.now AND a.domain = m.domain) m
      LEFT JOIN anchor a ON a.song_id = m.song_id AND a.epoch = m.now AND a.domain = m.domain)
    SELECT song_id, event_id, CASE WHEN epoch <> now THEN 'stale_epoch' WHEN at IS NULL THEN 'unanchored' WHEN sample < 0 THEN 'before_start' ELSE 'ok' END AS status, CASE WHEN epoch = now AND sample >= 0 THEN sample END AS song_sample FROM mapped""",
   f"""
    WITH {_CLOCK}, fresh AS (SELECT * FROM moment WHERE epoch = now),
    mapped AS (SELECT f.song_id, f.event_id, CAST(a.at * 470 + round((f.idx - a.at) * 480 * (1000000 + a.ppm) / 1000000.0) + a.latency AS BIGINT) AS sample FROM fresh f JOIN anchor a USING (song_id, epoch, domain))
    SELECT song_id, event_id, 'stale_epoch' AS status, NULL AS song_sample FROM moment WHERE epoch <> now
    UNION ALL SELECT song_id, event_id, 'unanchored', NULL FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM anchor a WHERE a.song_id = f.song_id AND a.epoch = f.epoch AND a.domain = f.domain)
    UNION ALL SELECT song_id, event_id, CASE WHEN sample >= 0 THEN 'ok' ELSE 'before_start' END, CASE WHEN sample >= 0 THEN sample END FROM mapped""")

# Discontinuities by priority, from counters that an audio device reports; each begins an epoch
_COUNTERS = """
    report AS (SELECT song_id, idx, event_id % 23 IN (0, 1) AS out_error, event_id % 29 = 0 AS in_error, CASE WHEN event_id % 31 = 0 THEN 0 ELSE idx * 480 END AS played, idx * 480 AS heard,
               sum(CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY song_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS overrun, event_id % 41 > 5 AS playing FROM pitch_frame)"""
_q("clock_epochs", ["pitch_frame"], [], f"""
    WITH {_COUNTERS}, reason AS (SELECT song_id, idx, CASE
        WHEN (out_error AND NOT coalesce(lag(out_error) OVER w, false)) OR (in_error AND NOT coalesce(lag(in_error) OVER w, false)) THEN 'device_error'
        WHEN played < lag(played) OVER w OR heard < lag(heard) OVER w OR overrun < lag(overrun) OVER w THEN 'counter_reset' WHEN overrun > lag(overrun) OVER w THEN 'capture_gap' WHEN playing <> lag(playing) OVER w THEN 'playback_transition' END AS reason
      FROM report WINDOW w AS (PARTITION BY song_id ORDER BY idx))
    SELECT song_id, idx, reason, count(reason) OVER (PARTITION BY song_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch FROM reason""",
   f"""
    WITH {_COUNTERS}, pair AS (SELECT b.*, a.out_error AS o, a.in_error AS i, a.played AS p, a.heard AS h, a.overrun AS r, a.playing AS y FROM report b LEFT JOIN report a ON a.song_id = b.song_id AND a.idx = b.idx - 1),
    held AS (SELECT song_id, idx, list_filter(['device_error', 'counter_reset', 'capture_gap', 'playback_transition'], lambda x, k: [out_error > coalesce(o, false) OR in_error > coalesce(i, false), coalesce(least(played - p, heard - h, overrun - r) < 0, false), coalesce(overrun <> r AND overrun > r, false), coalesce(playing IS DISTINCT FROM y AND y IS NOT NULL, false)][k])[1] AS reason FROM pair)
    SELECT song_id, idx, reason, (SELECT count(x.reason) FROM held x WHERE x.song_id = held.song_id AND x.idx <= held.idx) AS epoch FROM held""")

# Frame to frame: pitch jump with its ramp, and change of voicing, at least 0.8 where a voice begins or ends
_DELTA_OUT = "round(jump, 6) AS jump, round(least(1.0E0, greatest(0.0E0, (jump - 35) / 165)), 6) AS ramp"
_q("frame_deltas", ["pitch_frame"], [], f"""
    WITH step AS (SELECT song_id, idx, coalesce(abs(1200 * log2(f0_hz / lag(f0_hz) OVER w)), 0.0E0) AS jump, coalesce(abs(voiced_probability - lag(voiced_probability) OVER w), 0.0E0) AS vuv, (f0_hz IS NULL) <> (lag(f0_hz) OVER w IS NULL) AND idx > 0 AS turns
      FROM pitch_frame WINDOW w AS (PARTITION BY song_id ORDER BY idx))
    SELECT song_id, idx, {_DELTA_OUT}, round(least(1.0E0, CASE WHEN turns THEN greatest(vuv, 0.8E0) ELSE vuv END), 6) AS voicing FROM step""",
   f"""
    WITH step AS (SELECT b.song_id, b.idx, coalesce(abs(100 * (b.midi - a.midi)), 0) AS jump, coalesce(abs(b.voiced_probability - a.voiced_probability), 0) AS vuv, a.idx IS NOT NULL AND (a.midi IS NULL) <> (b.midi IS NULL) AS turns
      FROM pitch_frame b LEFT JOIN pitch_frame a ON a.song_id = b.song_id AND a.idx + 1 = b.idx)
    SELECT song_id, idx, {_DELTA_OUT}, round(greatest(least(vuv, 1), CASE WHEN turns THEN 0.8 ELSE 0 END), 6) AS voicing FROM step""")

# Silence, breath and their boundaries from energy, flux and voicing
_AIR = "air AS (SELECT song_id, idx, (1 - coalesce(voiced_probability, 0.0E0)) * (1 - confidence) AS silence, (1 - coalesce(voiced_probability, 0.0E0)) * confidence / 1.03E0 * least(1.0E0, 0.35E0 + (event_id % 90) / 97.0E0) AS breath FROM pitch_frame)"
_q("silence_signals", ["pitch_frame"], [], f"""
    WITH {_AIR} SELECT song_id, idx, round(least(1.0E0, silence), 6) AS silence, round(least(1.0E0, breath), 6) AS breath,
        round(least(1.0E0, greatest(coalesce(abs(silence - lag(silence) OVER (PARTITION BY song_id ORDER BY idx)), 0.0E0), breath * 0.65E0)), 6) AS boundary FROM air""",
   f"""
    WITH {_AIR} SELECT b.song_id, b.idx, round(b.silence, 6) AS silence, round(b.breath, 6) AS breath, round(CASE WHEN abs(b.silence - a.silence) > b.breath * 0.65 THEN abs(b.silence - a.silence) ELSE b.breath * 0.65 END, 6) AS boundary
    FROM air b LEFT JOIN air a ON a.song_id = b.song_id AND a.idx = b.idx - 1""")

# The grid of a pitch document against what its duration asks for; some frames of the data are off
_GRID = """
    doc AS (SELECT song_id, count(*) * 480 - CASE WHEN song_id % 8 = 0 THEN 480 ELSE song_id % 480 END AS duration FROM pitch_frame GROUP BY song_id),
    frame AS (SELECT f.song_id, f.idx AS place, f.idx + CASE WHEN event_id % 1499 = 0 THEN 1 ELSE 0 END AS idx, f.idx * 480 + CASE WHEN event_id % 1009 = 0 THEN 1 ELSE 0 END AS s, duration, midi, CASE WHEN event_id % 997 = 0 THEN 1.5E0 ELSE confidence END AS confidence, voiced_probability,
                     least(f.idx * 480 + 1920, duration) - CASE WHEN event_id % 1201 = 0 THEN 2 ELSE 0 END AS e FROM pitch_frame f JOIN doc d ON f.song_id = d.song_id),
    row AS (SELECT *, CAST(floor((s + e) / 2) AS BIGINT) AS c FROM frame)"""
_q("grid_validation", ["pitch_frame"], [], f"""
    WITH {_GRID} SELECT song_id, count(*) AS frames, count(*) = max(CAST(ceil(duration / 480) AS BIGINT)) AS covers, count(CASE WHEN idx <> place OR s <> place * 480 OR e <> least(s + 1920, duration) OR c <> floor((s + e) / 2) THEN 1 END) AS off_grid,
        count(CASE WHEN midi < 0 OR midi > 127 THEN 1 END) AS bad_midi, count(CASE WHEN confidence NOT BETWEEN 0 AND 1 OR confidence IS NULL OR voiced_probability NOT BETWEEN 0 AND 1 OR voiced_probability IS NULL THEN 1 END) AS bad_confidence FROM row GROUP BY song_id""",
   f"""
    WITH {_GRID}, want AS (SELECT song_id, i AS place, i AS idx, i * 480 AS s, least(i * 480 + 1920, duration) AS e FROM (SELECT song_id, duration, unnest(range(0, (duration + 479) // 480)) AS i FROM doc)),
    off AS (SELECT r.song_id, count(*) AS off_grid FROM row r ANTI JOIN (SELECT w.*, (s + e) // 2 AS c FROM want w) w USING (song_id, place, idx, s, e, c) WHERE r.place * 480 < r.duration OR r.e <> least(r.s + 1920, r.duration) OR r.idx <> r.place OR r.s <> r.place * 480 GROUP BY r.song_id),
    n AS (SELECT song_id, count(*) AS frames, count(*) FILTER (NOT coalesce(midi BETWEEN 0 AND 127, true)) AS bad_midi, count(*) FILTER (NOT coalesce(least(confidence, voiced_probability) >= 0 AND greatest(confidence, voiced_probability) <= 1 AND voiced_probability IS NOT NULL, false)) AS bad_confidence FROM row GROUP BY song_id)
    SELECT n.song_id, frames, frames = (SELECT count(*) FROM want w WHERE w.song_id = n.song_id) AS covers, coalesce(off_grid, 0) AS off_grid, bad_midi, bad_confidence FROM n LEFT JOIN off USING (song_id)""")

# Diagnostics of recognised segments, and their flags; values that cannot be are an outcome of their own
_SPEECH = "speech AS (SELECT event_id, CASE WHEN event_id % 17 > 0 THEN -(event_id % 240) / 120.0E0 END AS logprob, CASE WHEN event_id % 19 > 0 THEN (event_id % 103) / 100.0E0 END AS nospeech, CASE WHEN event_id % 7 > 0 THEN (event_id % 61) / 20.0E0 END AS ratio FROM events)"
_q("diagnostic_flags", [], ["events"], f"""
    WITH {_SPEECH} SELECT event_id, CASE WHEN nospeech < 0 OR nospeech > 1 THEN 'invalid_asr_output' ELSE 'ok' END AS status, CASE WHEN nospeech < 0 OR nospeech > 1 THEN NULL ELSE
        concat_ws(',', CASE WHEN logprob < -1 THEN 'low_logprob' END, CASE WHEN nospeech > 0.6E0 THEN 'suspected_nonspeech' END, CASE WHEN ratio > 2.4E0 THEN 'high_compression_ratio' END) END AS flags FROM speech""",
   f"""
    WITH {_SPEECH}, flag AS (SELECT event_id, 1 AS k, 'low_logprob' AS f FROM speech WHERE logprob < -1 UNION ALL SELECT event_id, 2, 'suspected_nonspeech' FROM speech WHERE nospeech > 0.6 UNION ALL SELECT event_id, 3, 'high_compression_ratio' FROM speech WHERE ratio > 2.4)
    SELECT s.event_id, CASE WHEN coalesce(nospeech BETWEEN 0 AND 1, true) THEN 'ok' ELSE 'invalid_asr_output' END AS status, CASE WHEN coalesce(nospeech BETWEEN 0 AND 1, true) THEN coalesce(string_agg(f, ',' ORDER BY k), '') END AS flags FROM speech s LEFT JOIN flag USING (event_id) GROUP BY s.event_id, nospeech""")

# Thresholds of a ledger over measured results: a direction or threshold of another kind is an error, a missing value leaves the result open
_LEDGER = """
    ledger AS (SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'min' ELSE 'max' END AS direction, CASE WHEN p_size > 5 THEN CAST(p_size AS DOUBLE) END AS value FROM part WHERE p_size < 45),
    result AS (SELECT l_partkey AS k, CASE WHEN max(l_linenumber) = 7 AND count(*) % 5 = 0 THEN 'min' ELSE max(CASE WHEN p_size % 2 = 0 THEN 'min' ELSE 'max' END) END AS direction, CASE WHEN count(*) % 4 > 0 THEN max(l_quantity) END AS value, CASE WHEN count(*) % 3 = 0 THEN CAST(max(p_size) + CASE WHEN count(*) % 9 = 0 THEN 1 ELSE 0 END AS DOUBLE) END AS threshold
               FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey)"""
_q("threshold_check", [], ["part", "lineitem"], f"""
    WITH {_LEDGER} SELECT r.k AS part, l.value AS threshold, CASE WHEN l.k IS NULL THEN 'not_listed' WHEN l.direction <> r.direction THEN 'direction_differs' WHEN r.threshold IS NOT NULL AND NOT r.threshold <=> l.value THEN 'threshold_differs'
        WHEN l.value IS NULL OR r.value IS NULL THEN 'unverified' WHEN CASE WHEN r.direction = 'min' THEN r.value >= l.value ELSE r.value <= l.value END THEN 'pass' ELSE 'fail' END AS status FROM result r LEFT JOIN ledger l ON l.k = r.k""",
   f"""
    WITH {_LEDGER}, j AS (SELECT r.k, r.direction, r.value, r.threshold, l.direction AS d, l.value AS v FROM result r JOIN ledger l USING (k)), fits AS (SELECT * FROM j WHERE direction = d AND (threshold IS NULL OR threshold IS NOT DISTINCT FROM v))
    SELECT k AS part, NULL AS threshold, 'not_listed' AS status FROM result ANTI JOIN ledger USING (k) UNION ALL SELECT k, v, 'direction_differs' FROM j WHERE direction <> d UNION ALL SELECT k, v, 'threshold_differs' FROM j WHERE direction = d AND threshold IS NOT NULL AND threshold IS DISTINCT FROM v
    UNION ALL SELECT k, v, CASE WHEN v - value IS NULL THEN 'unverified' WHEN (value - v) * CASE direction WHEN 'min' THEN 1 ELSE -1 END >= 0 THEN 'pass' ELSE 'fail' END FROM fits""")

# Boundary errors of aligned units: mean, linear 95th percentile, coverage, the missing ones, and the gate
_ALIGNED = """
    unit AS (SELECT song_id, turn, start_sample AS a, end_sample AS b, CASE WHEN (song_id * 7 + turn) % 9 > 0 OR song_id % 3 = 0 THEN start_sample + (turn * 37 % 11 - 4) * CASE WHEN song_id % 2 = 0 THEN 240 ELSE 1100 END END AS c, end_sample + (song_id % 5) * 480 AS d FROM lyric_segment)"""
_q("alignment_error", ["lyric_segment"], [], f"""
    WITH {_ALIGNED}, error AS (SELECT song_id, abs(a - c) / 48.0E0 AS e FROM unit WHERE c IS NOT NULL UNION ALL SELECT song_id, abs(b - d) / 48.0E0 FROM unit WHERE c IS NOT NULL),
    stat AS (SELECT song_id, avg(e) AS mean, percentile_cont(0.95) WITHIN GROUP (ORDER BY e) AS p95 FROM error GROUP BY song_id),
    seen AS (SELECT song_id, count(*) AS units, count(c) AS matched, array_join(array_sort(collect_list(CASE WHEN c IS NULL THEN turn END)), ',') AS missing FROM unit GROUP BY song_id)
    SELECT s.song_id, units, matched, missing, round(matched / units, 6) AS coverage, round(mean, 4) AS mean_ms, round(p95, 4) AS p95_ms, coalesce(matched = units AND mean <= 50 AND p95 <= 100, false) AS passed FROM seen s LEFT JOIN stat t ON s.song_id = t.song_id""",
   f"""
    WITH {_ALIGNED}, l AS (SELECT song_id, count(*) AS units, count(c) AS matched, coalesce(string_agg(CASE WHEN c IS NULL THEN turn END, ',' ORDER BY turn), '') AS missing, list_sort(flatten(list([abs(a - c) / 48.0, abs(b - d) / 48.0]) FILTER (c IS NOT NULL))) AS e FROM unit GROUP BY song_id),
    p AS (SELECT *, 0.95 * (len(e) - 1) AS pos, list_avg(e) AS mean FROM l), q AS (SELECT *, e[1 + CAST(floor(pos) AS INT)] + (e[1 + CAST(ceil(pos) AS INT)] - e[1 + CAST(floor(pos) AS INT)]) * (pos - floor(pos)) AS p95 FROM p)
    SELECT song_id, units, matched, missing, round(matched / units, 6) AS coverage, round(mean, 4) AS mean_ms, round(p95, 4) AS p95_ms, matched = units AND coalesce(mean <= 50 AND p95 <= 100, false) AS passed FROM q""")

# The graph of derived artifacts: six kinds, what each depends on, none stale
_EDGES = "(VALUES (1, ''), (2, '1'), (3, '1'), (4, '2'), (5, '2,4'), (6, '4,5'))"
_ARTIFACTS = """
    artifact AS (SELECT l_orderkey AS song_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS kind, l_tax < 0.08E0 AS valid, CASE WHEN l_quantity = 13 THEN 0 ELSE 1 END AS generation, CASE WHEN l_partkey % 40 = 0 THEN '1,2' END AS other FROM lineitem),
    state AS (SELECT song_id, kind, valid, generation, coalesce(other, CASE kind WHEN 1 THEN '' WHEN 2 THEN '1' WHEN 3 THEN '1' WHEN 4 THEN '2' WHEN 5 THEN '2,4' ELSE '4,5' END) AS needs FROM artifact)"""
_q("dependency_shape", [], ["lineitem"], f"""
    WITH {_ARTIFACTS} SELECT song_id, CASE WHEN count(*) <> 6 THEN 'incomplete' WHEN max(CASE WHEN needs <> want OR generation = 0 OR NOT (valid OR kind >= 4) THEN 1 ELSE 0 END) = 1 THEN 'stale' ELSE 'ok' END AS status
    FROM state LEFT JOIN (SELECT col1 AS k, col2 AS want FROM {_EDGES}) e ON k = kind GROUP BY song_id""",
   f"""
    WITH {_ARTIFACTS}, e(k, want) AS (SELECT * FROM {_EDGES}), good AS (SELECT song_id, count(*) AS n FROM state JOIN e ON kind = k AND needs = want WHERE generation > 0 AND (valid OR kind IN (4, 5, 6)) GROUP BY song_id)
    SELECT song_id, CASE WHEN n = 6 AND g = 6 THEN 'ok' WHEN n = 6 THEN 'stale' ELSE 'incomplete' END AS status FROM (SELECT song_id, count(*) AS n FROM state GROUP BY song_id) LEFT JOIN (SELECT song_id, n AS g FROM good) USING (song_id)""")

# Ids of lyrics, notes and the song itself: none blank, none twice, none missing that evidence names
_IDS = """
    named AS (SELECT l.song_id, CASE WHEN role IS NULL THEN ' ' ELSE concat('l', turn) END AS id FROM lyric_segment l UNION ALL SELECT song_id, CASE WHEN midi_note % 12 = 0 AND seq < 4 THEN concat('l', seq) WHEN midi_note = 61 THEN '' WHEN midi_note = 62 THEN 'song' ELSE concat('n', seq) END FROM note UNION ALL SELECT DISTINCT song_id, 'song' FROM note),
    told AS (SELECT song_id, concat('n', seq + CASE WHEN confidence < 0.91E0 THEN 50 ELSE 0 END) AS target FROM note WHERE midi_note % 12 > 2 AND midi_note NOT IN (61, 62))"""
_q("key_uniqueness", ["lyric_segment", "note"], ["conversations"], f"""
    WITH {_IDS} SELECT song_id, id, CASE WHEN trim(id) = '' THEN 'blank' ELSE 'twice' END AS fault, count(*) AS n FROM named GROUP BY song_id, id HAVING trim(id) = '' OR count(*) > 1
    UNION ALL SELECT t.song_id, target, 'missing', count(*) FROM told t LEFT ANTI JOIN named n ON n.song_id = t.song_id AND n.id = t.target GROUP BY t.song_id, target""",
   f"""
    WITH {_IDS}, r AS (SELECT *, count(*) OVER (PARTITION BY song_id, id) AS n FROM named)
    SELECT DISTINCT song_id, id, CASE WHEN length(trim(id)) > 0 THEN 'twice' ELSE 'blank' END AS fault, n FROM r WHERE n > 1 OR length(trim(id)) = 0
    UNION ALL SELECT song_id, target, 'missing', count(*) FROM told t WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.song_id = t.song_id AND n.id = t.target) GROUP BY song_id, target""")
# Notes whose lyric segment is not there
_SUNG = "sung AS (SELECT song_id, seq, CASE WHEN midi_note % 5 > 0 THEN seq - 1 + midi_note % 3 END AS segment FROM note)"
_q("note_references", ["lyric_segment", "note"], [], f"WITH {_SUNG} SELECT s.song_id, seq, segment FROM sung s LEFT ANTI JOIN lyric_segment l ON l.song_id = s.song_id AND l.turn = s.segment WHERE segment IS NOT NULL",
   f"WITH {_SUNG} SELECT song_id, seq, segment FROM sung WHERE segment IS NOT NULL AND (song_id, segment) NOT IN (SELECT (song_id, turn) FROM lyric_segment)")

# The first lyric after a point, forwards over one sort
_q("next_lyric", ["lyric_segment", "note"], [], """
    WITH line AS (SELECT song_id, start_sample AS at, 1 AS kind, CAST(NULL AS BIGINT) AS seq, turn FROM lyric_segment UNION ALL SELECT song_id, start_sample, 0, CAST(seq AS BIGINT), NULL FROM note WHERE song_id IN (SELECT song_id FROM lyric_segment)),
    behind AS (SELECT *,
               min(CASE WHEN kind = 1 THEN named_struct('at', at, 'turn', turn) END) OVER (PARTITION BY song_id ORDER BY at RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM line)
    SELECT song_id, seq, at AS start_sample, nxt.turn AS next_turn FROM behind WHERE kind = 0""",
   """
    SELECT n.song_id, n.seq, n.start_sample, (SELECT arg_min(l.turn, (l.start_sample, l.turn)) FROM lyric_segment l WHERE l.song_id = n.song_id AND l.start_sample > n.start_sample) AS next_turn
    FROM note n SEMI JOIN lyric_segment l ON l.song_id = n.song_id""")

# The operations that lead from one state of a song to another, in the order in which they have to be applied
_STATES = """
    old_note AS (SELECT song_id, seq AS id, start_sample AS a, end_sample AS b, midi_note AS v FROM note), new_note AS (
      SELECT song_id, seq AS id, start_sample AS a, end_sample AS b, midi_note + CASE WHEN confidence < 0.92E0 THEN 1 ELSE 0 END AS v FROM note WHERE midi_note <> 95 UNION ALL SELECT song_id, seq + 1000, start_sample, end_sample, midi_note FROM note WHERE midi_note = 36),
    old_lyric AS (SELECT song_id, turn AS id, start_sample AS a, end_sample AS b FROM lyric_segment), new_lyric AS (
      SELECT song_id, turn AS id, start_sample AS a, end_sample + CASE WHEN role = 'assistant' THEN 480 ELSE 0 END AS b FROM lyric_segment WHERE end_sample - start_sample > 24000 UNION ALL SELECT song_id, turn + 500, end_sample, end_sample + 480 FROM lyric_segment WHERE turn = 1)"""
_ORDERED = "SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY k, id) AS position, op, id FROM ops"
_q("edit_diff", ["lyric_segment", "note"], [], f"""
    WITH {_STATES}, n AS (SELECT coalesce(o.song_id, w.song_id) AS song_id, coalesce(o.id, w.id) AS id, o.id IS NULL AS fresh, w.id IS NULL AS gone, o.a <> w.a OR o.b <> w.b OR o.v <> w.v AS moved FROM old_note o FULL OUTER JOIN new_note w ON o.song_id = w.song_id AND o.id = w.id),
    l AS (SELECT coalesce(o.song_id, w.song_id) AS song_id, coalesce(o.id, w.id) AS id, o.id IS NULL AS fresh, w.id IS NULL AS gone, o.a <> w.a OR o.b <> w.b AS moved FROM old_lyric o FULL OUTER JOIN new_lyric w ON o.song_id = w.song_id AND o.id = w.id),
    ops AS (SELECT song_id, CASE WHEN fresh THEN 1 WHEN gone THEN 6 ELSE 2 END AS k, CASE WHEN fresh THEN 'add_lyric' WHEN gone THEN 'delete_lyric' ELSE 'update_lyric' END AS op, CAST(id AS BIGINT) AS id FROM l WHERE fresh OR gone OR moved
            UNION ALL SELECT song_id, CASE WHEN fresh THEN 3 WHEN gone THEN 5 ELSE 4 END, CASE WHEN fresh THEN 'add_note' WHEN gone THEN 'delete_note' ELSE 'update_note' END, CAST(id AS BIGINT) FROM n WHERE fresh OR gone OR moved)
    {_ORDERED}""",
   f"""
    WITH {_STATES}, ops AS (
      SELECT song_id, 1 AS k, 'add_lyric' AS op, id FROM new_lyric ANTI JOIN old_lyric USING (song_id, id) UNION ALL SELECT song_id, 2, 'update_lyric', id FROM (SELECT * FROM new_lyric EXCEPT SELECT * FROM old_lyric) SEMI JOIN old_lyric USING (song_id, id)
      UNION ALL SELECT song_id, 3, 'add_note', id FROM new_note ANTI JOIN old_note USING (song_id, id) UNION ALL SELECT song_id, 4, 'update_note', id FROM (SELECT * FROM new_note EXCEPT SELECT * FROM old_note) SEMI JOIN old_note USING (song_id, id)
      UNION ALL SELECT song_id, 5, 'delete_note', id FROM old_note ANTI JOIN new_note USING (song_id, id) UNION ALL SELECT song_id, 6, 'delete_lyric', id FROM old_lyric ANTI JOIN new_lyric USING (song_id, id))
    {_ORDERED}""")

# Imports against what is published: a known song with the same content is used again, with another one it is a conflict
_LIBRARY = """
    published AS (SELECT o_orderkey AS id, concat(o_orderstatus, CASE WHEN o_totalprice > 400000 THEN 'old' ELSE '' END) AS digest FROM orders WHERE o_orderdate < '1996-07-01'),
    arrived AS (SELECT o_orderkey AS id, o_orderstatus AS digest FROM orders UNION ALL SELECT o_orderkey, 'second' FROM orders WHERE o_totalprice < 2000)"""
_q("idempotent_import", [], ["orders"], f"""
    WITH {_LIBRARY}, first AS (SELECT id, digest, count(*) OVER (PARTITION BY id) AS versions FROM arrived)
    SELECT a.id, a.digest, CASE WHEN p.digest = a.digest THEN 'reuse' WHEN p.id IS NOT NULL OR versions > 1 THEN 'conflict' ELSE 'publish' END AS outcome FROM first a LEFT JOIN published p ON p.id = a.id""",
   f"""
    WITH {_LIBRARY}, reuse AS (SELECT * FROM arrived INTERSECT SELECT * FROM published), rest AS (SELECT * FROM arrived EXCEPT SELECT * FROM published)
    SELECT id, digest, 'reuse' AS outcome FROM reuse UNION ALL SELECT id, digest, CASE WHEN id IN (SELECT id FROM published) OR id IN (SELECT id FROM arrived GROUP BY id HAVING count(*) > 1) THEN 'conflict' ELSE 'publish' END FROM rest""")

# What a media probe reports of its first stream: whole numbers, or strings of them
_PROBE = """
    probe AS (SELECT event_id, concat(CASE WHEN event_id % 31 = 0 THEN '{"streams":[' WHEN event_id % 37 = 0 THEN '{"format":[{' ELSE '{"streams":[{' END, CASE WHEN event_id % 31 = 0 THEN '' ELSE concat('"sample_rate":', CASE event_id % 7 WHEN 0 THEN '"48000"' WHEN 1 THEN '44100' WHEN 2 THEN '"44.1"' WHEN 3 THEN '-1' WHEN 4 THEN 'true' ELSE '5000000000' END,
              CASE WHEN event_id % 5 > 0 THEN ',"channels":2' ELSE '' END, ',"duration_ts":', CASE WHEN event_id % 11 = 0 THEN '"12x"' WHEN event_id % 13 = 0 THEN '1.5' ELSE concat('"', event_id, '"') END, '}') END, ']}') AS doc FROM events)"""


def _field(name, kind):
    path = f"get_json_object(doc, '$.streams[0].{name}')"
    return f"CASE WHEN {path} RLIKE '^[0-9]+$' AND try_cast({path} AS {kind}) IS NOT NULL THEN try_cast({path} AS BIGINT) END"


def _field2(name, most):
    return f"CASE json_type(doc, '$.streams[0].{name}') WHEN 'UBIGINT' THEN 1 WHEN 'VARCHAR' THEN CAST(regexp_full_match(json_extract_string(doc, '$.streams[0].{name}'), '\\d+') AS INT) ELSE 0 END = 1 AND TRY_CAST(json_extract_string(doc, '$.streams[0].{name}') AS HUGEINT) <= {most}"


_q("probe_json", [], ["events"], f"""
    WITH {_PROBE}, f AS (SELECT event_id, get_json_object(doc, '$.streams[0]') AS stream, {_field("sample_rate", "BIGINT")} AS rate, {_field("channels", "BIGINT")} AS channels, {_field("duration_ts", "BIGINT")} AS duration FROM probe)
    SELECT event_id, CASE WHEN stream IS NULL THEN 'no_stream' WHEN rate IS NULL OR rate > 4294967295 THEN 'sample_rate' WHEN channels IS NULL OR channels > 4294967295 THEN 'channels' WHEN duration IS NULL THEN 'duration_ts' ELSE 'ok' END AS status,
           CASE WHEN rate <= 4294967295 AND channels <= 4294967295 THEN duration END AS duration_samples FROM f""",
   f"""
    WITH {_PROBE}, f AS (SELECT event_id, doc, json_type(doc, '$.streams[0]') AS stream, coalesce({_field2("sample_rate", 4294967295)}, false) AS r, coalesce({_field2("channels", 4294967295)}, false) AS c, coalesce({_field2("duration_ts", 9223372036854775807)}, false) AS d FROM probe)
    SELECT event_id, CASE WHEN stream IS NULL THEN 'no_stream' WHEN NOT r THEN 'sample_rate' WHEN NOT c THEN 'channels' WHEN NOT d THEN 'duration_ts' ELSE 'ok' END AS status, CASE WHEN r AND c AND d THEN CAST(json_extract_string(doc, '$.streams[0].duration_ts') AS BIGINT) END AS duration_samples FROM f""")

# Samples of each split, and of each split and stratum; phenomena are several to a sample, or none
_STRATA = """
    sample AS (SELECT doc_id, CASE WHEN source IN (SELECT min(source) FROM documents) OR n_chars > 3000 THEN 'holdout' ELSE 'development' END AS split, lang, source, text FROM documents)"""
_q("split_strata", [], ["documents"], f"""
    WITH {_STRATA}, marked AS (SELECT split, filter(array(CASE WHEN text RLIKE '[0-9]' THEN 'digits' END, CASE WHEN text LIKE '%@%' THEN 'address' END, CASE WHEN text RLIKE '[!?]' THEN 'voice' END), x -> x IS NOT NULL) AS p FROM sample)
    SELECT split, CASE WHEN lang_out = 0 THEN 'language' WHEN source_out = 0 THEN 'source' ELSE 'all' END AS field, coalesce(lang, source) AS value, n FROM (
      SELECT split, lang, source, grouping(lang) AS lang_out, grouping(source) AS source_out, count(*) AS n FROM sample GROUP BY GROUPING SETS ((split), (split, lang), (split, source))) g
    UNION ALL SELECT split, 'phenomena', x, count(*) FROM (SELECT split, explode(CASE WHEN size(p) = 0 THEN array('none') ELSE p END) AS x FROM marked) m GROUP BY split, x""",
   f"""
    WITH {_STRATA}, mark AS (SELECT doc_id, split, 'digits' AS x FROM sample WHERE regexp_matches(text, '\\d') UNION ALL SELECT doc_id, split, 'address' FROM sample WHERE contains(text, '@') UNION ALL SELECT doc_id, split, 'voice' FROM sample WHERE contains(text, '!') OR contains(text, '?'))
    SELECT split, 'all' AS field, NULL AS value, count(*) AS n FROM sample GROUP BY split UNION ALL SELECT split, 'language', lang, count(*) FROM sample GROUP BY split, lang UNION ALL SELECT split, 'source', source, count(*) FROM sample GROUP BY split, source
    UNION ALL SELECT split, 'phenomena', x, count(*) FROM mark GROUP BY split, x UNION ALL SELECT split, 'phenomena', 'none', count(*) FROM sample WHERE doc_id NOT IN (SELECT doc_id FROM mark) GROUP BY split HAVING count(*) > 0""")

# The tempo at a tick is the last change at or before it: one sort, no range join
_q("tempo_at_tick", ["pitch_frame"], [], """
    SELECT song_id, idx * 120 AS tick, coalesce(last_value(CASE WHEN event_type = 'click' THEN 400000 + (event_id % 9) * 50000 END) IGNORE NULLS OVER (PARTITION BY song_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 500000) AS tempo FROM pitch_frame""",
   """
    WITH c AS (SELECT song_id, idx, 400000 + (event_id % 9) * 50000 AS tempo FROM pitch_frame WHERE event_type = 'click')
    SELECT f.song_id, f.idx * 120 AS tick, coalesce(c.tempo, 500000) AS tempo FROM pitch_frame f ASOF LEFT JOIN c ON c.song_id = f.song_id AND f.idx >= c.idx""")

# Spans that share a quarter of the shorter one: they meet by cell, in the cell where both have begun
_OTHER = "other AS (SELECT song_id, seq, start_sample + 3000 AS start_sample, end_sample + 3000 AS end_sample FROM note)"
_q("external_overlap", ["note"], [], f"""
    WITH {_OTHER}, a AS (SELECT *, explode(sequence(start_sample div 48000, greatest(start_sample, end_sample - 1) div 48000)) AS cell FROM note), b AS (SELECT *, explode(sequence(start_sample div 48000, greatest(start_sample, end_sample - 1) div 48000)) AS cell FROM other)
    SELECT a.song_id, a.seq, b.seq AS other FROM a JOIN b ON a.song_id = b.song_id AND a.cell = b.cell
    WHERE a.cell = greatest(a.start_sample, b.start_sample) div 48000 AND a.start_sample < b.end_sample AND b.start_sample < a.end_sample AND least(a.end_sample, b.end_sample) - greatest(a.start_sample, b.start_sample) >= 0.25 * least(a.end_sample - a.start_sample, b.end_sample - b.start_sample)""",
   f"""
    WITH {_OTHER} SELECT a.song_id, a.seq, b.seq AS other FROM note a JOIN other b ON a.song_id = b.song_id AND a.start_sample < b.end_sample AND b.start_sample < a.end_sample
    WHERE least(a.end_sample, b.end_sample) - greatest(a.start_sample, b.start_sample) >= 0.25 * least(a.end_sample - a.start_sample, b.end_sample - b.start_sample)""")
