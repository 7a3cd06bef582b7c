"""Timeline operators: time formats, tempo, windows, runs and boundary decisions."""

Q = {}

Q["time_format"] = (["note"], [], """
    SELECT song_id, seq, concat(CAST(CAST(floor(start_sample / 2880000) AS BIGINT) AS VARCHAR(20)), ':',
           lpad(CAST(CAST(floor(start_sample / 48000) AS BIGINT) % 60 AS VARCHAR(20)), 2, '0'), '.', CAST(CAST(floor(start_sample / 4800) AS BIGINT) % 10 AS VARCHAR(20))) AS shown FROM note""")
Q["frame_to_sample"] = (["pitch_frame"], [], "SELECT event_id, CAST(floor(idx * 320 * 3 / 2) AS BIGINT) AS sample FROM pitch_frame")
Q["line_interval"] = (["lyric_segment"], [], """
    SELECT song_id, turn, s AS start_sample, e AS end_sample FROM (
      SELECT song_id, turn, coalesce(CASE WHEN turn % 3 > 0 THEN start_sample END, 4800 * turn - 240) AS s, coalesce(CASE WHEN turn % 3 > 0 THEN end_sample END, 4800 * turn + 2400) AS e FROM lyric_segment) x WHERE s < e AND s >= 0""")
# Tempo: a change at each click, microseconds a quarter, 480 ticks a quarter
Q["tempo_integral"] = (["pitch_frame"], [], """
    SELECT song_id, tick, tempo, CAST(coalesce(sum((tick - before) * before_tempo) OVER (PARTITION BY song_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS numerator FROM (
      SELECT song_id, tick, tempo, lag(tick) OVER (PARTITION BY song_id ORDER BY tick) AS before, lag(tempo) OVER (PARTITION BY song_id ORDER BY tick) AS before_tempo
      FROM (SELECT song_id, idx * 120 AS tick, 400000 + (event_id % 9) * 50000 AS tempo FROM pitch_frame WHERE event_type = 'click') t) u""")
Q["external_transitions"] = (["note"], [], """
    SELECT song_id, start_sample AS sample FROM (SELECT song_id, start_sample, midi_note, lag(midi_note) OVER w AS was, lag(end_sample) OVER w AS ended FROM note WINDOW w AS (PARTITION BY song_id ORDER BY start_sample, end_sample, seq)) x
    WHERE was IS NOT NULL AND (midi_note <> was OR start_sample > ended)""")
Q["split_runs"] = (["pitch_frame", "boundary"], [], """
    SELECT song_id, part, min(idx) * 480 AS start_sample, max(idx) * 480 + 480 AS end_sample FROM (
      SELECT f.song_id, f.idx, sum(CASE WHEN b.sample IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY f.song_id ORDER BY f.idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part
      FROM pitch_frame f LEFT JOIN (SELECT song_id, sample FROM boundary WHERE probability >= 0.5) b ON f.song_id = b.song_id AND f.idx * 480 = b.sample) x GROUP BY song_id, part""")
# 28 s of core and 1 s of context on both sides; the core that holds the midpoint owns a segment
Q["window_owner"] = (["note"], [], """
    SELECT song_id, seq, w AS window_id FROM (
      SELECT song_id, seq, start_sample, end_sample, CAST(floor((start_sample + end_sample) / 2 / 1344000) AS BIGINT) AS w FROM note) x
    WHERE start_sample >= w * 1344000 - 48000 AND end_sample <= (w + 1) * 1344000 + 48000""")
Q["onset_mix"] = (["pitch_frame"], [], "SELECT song_id, idx, round(0.65 * confidence + 0.35 * voiced_probability, 6) AS onset FROM pitch_frame")
Q["top_states"] = (["pitch_frame"], [], """
    SELECT song_id, idx, r AS place FROM (SELECT song_id, idx, row_number() OVER (PARTITION BY song_id ORDER BY confidence DESC, voiced_probability DESC, idx) AS r FROM pitch_frame) x WHERE r <= 8""")
Q["canonical_order"] = (["lyric_segment"], [], "SELECT song_id, turn, row_number() OVER (PARTITION BY song_id ORDER BY start_sample, end_sample, role, turn) AS place FROM lyric_segment")
