"""Second readings of queries whose own text another engine can run too: the same meaning by other means."""

ORACLE = {
    "hz_to_midi": "SELECT event_id, round(CASE WHEN value >= 55 THEN 69 + 12 * (ln(value) - ln(440)) / ln(2) END, 6) AS midi FROM pitch_frame",
    "clamp": "SELECT event_id, CASE WHEN value < 20 THEN 20.0 WHEN value > 80 THEN 80.0 ELSE value END AS clamped FROM pitch_frame WHERE value = value",
    "lyric_at_sample": """
        SELECT p.song_id, p.probe, (SELECT arg_max(s.turn, (s.start_sample, -s.turn)) FROM lyric_segment s WHERE s.song_id = p.song_id AND p.probe BETWEEN s.start_sample AND s.end_sample - 1) AS turn
        FROM (SELECT song_id, start_sample + 2400 AS probe FROM lyric_segment GROUP BY ALL) p""",
    "window_cells": """
        WITH f AS (SELECT song_id, idx, idx * 480 + 240 AS c FROM pitch_frame)
        SELECT b.song_id, b.idx, coalesce((a.c + b.c) // 2, 0) AS cell_start, coalesce((b.c + d.c) // 2, b.c + 240) AS cell_end
        FROM f b LEFT JOIN f a ON a.song_id = b.song_id AND a.idx = b.idx - 1 LEFT JOIN f d ON d.song_id = b.song_id AND d.idx = b.idx + 1""",
    "interval_union": """
        WITH s AS (SELECT * FROM lyric_segment a WHERE NOT EXISTS (SELECT 1 FROM lyric_segment b WHERE b.song_id = a.song_id AND (b.start_sample, b.end_sample, b.turn) < (a.start_sample, a.end_sample, a.turn) AND b.end_sample >= a.start_sample)),
        n AS (SELECT song_id, start_sample, row_number() OVER (PARTITION BY song_id ORDER BY start_sample, end_sample, turn) - 1 AS island, lead(start_sample, 1, 9223372036854775807) OVER (PARTITION BY song_id ORDER BY start_sample, end_sample, turn) AS until FROM s)
        SELECT n.song_id, island, n.start_sample, max(l.end_sample) AS end_sample FROM n JOIN lyric_segment l ON l.song_id = n.song_id AND l.start_sample >= n.start_sample AND l.start_sample < n.until GROUP BY n.song_id, island, n.start_sample""",
    "near_event_strength": """
        SELECT f.song_id, f.idx, coalesce((SELECT max(b.probability) FROM boundary b WHERE b.song_id = f.song_id AND b.sample BETWEEN f.idx * 480 - 480 AND f.idx * 480 + 480), 0.0) AS strength FROM pitch_frame f""",
    "median_pitch": """
        WITH l AS (SELECT song_id, list_sort(list(midi) FILTER (midi IS NOT NULL)) AS m FROM pitch_frame GROUP BY song_id)
        SELECT song_id, round((m[(len(m) + 1) // 2] + m[len(m) // 2 + 1]) / 2, 6) AS median_midi FROM l""",
    "normalise_p95": """
        WITH l AS (SELECT song_id, list_sort(list(value) FILTER (value > 1e-12)) AS v FROM pitch_frame GROUP BY song_id), p AS (SELECT *, 0.95 * (len(v) - 1) AS pos FROM l),
        q AS (SELECT song_id, v[1 + CAST(floor(pos) AS INT)] * (1 - (pos - floor(pos))) + coalesce(v[2 + CAST(floor(pos) AS INT)], 0) * (pos - floor(pos)) AS top FROM p)
        SELECT f.song_id, event_id, round(CASE WHEN top > 0 THEN greatest(least(value, top) / top, 0) ELSE 0 END, 6) AS strength FROM pitch_frame f JOIN q USING (song_id)""",
    "local_maxima": """
        SELECT b.song_id, b.idx FROM pitch_frame b LEFT JOIN pitch_frame a ON a.song_id = b.song_id AND a.idx = b.idx - 1 LEFT JOIN pitch_frame c ON c.song_id = b.song_id AND c.idx = b.idx + 1
        WHERE b.confidence >= 0.5 AND NOT coalesce(a.confidence > b.confidence, false) AND NOT coalesce(c.confidence > b.confidence, false)""",
    "energy_rise": """
        WITH e AS (SELECT song_id, idx, 20 * ln(CASE WHEN abs(value) > 1e-8 THEN abs(value) ELSE 1e-8 END) / ln(10) AS db FROM pitch_frame)
        SELECT b.song_id, b.idx, round(b.db - a.db, 6) AS delta_db FROM e b LEFT JOIN e a ON a.song_id = b.song_id AND a.idx = b.idx - 1""",
    "grid_splat": """
        WITH k(step, w) AS (VALUES (-480, 0.35), (0, 1.0), (480, 0.35)), g AS (SELECT DISTINCT song_id, sample + step AS sample FROM boundary, k)
        SELECT song_id, sample, (SELECT max(CASE WHEN b.sample = g.sample THEN probability ELSE probability * 0.35 END) FROM boundary b WHERE b.song_id = g.song_id AND abs(b.sample - g.sample) IN (0, 480)) AS strength FROM g WHERE sample >= 0""",
    "ordered_ids": """
        SELECT a.song_id, a.seq, 'note-' || lpad(CAST(1 + (SELECT count(*) FROM note b WHERE b.song_id = a.song_id AND (b.start_sample, b.end_sample, b.seq) < (a.start_sample, a.end_sample, a.seq)) AS VARCHAR), 4, '0') AS note_id FROM note a""",
    "retention": """
        SELECT o_custkey, unnest(list_slice(list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC), 1, 8)) AS o_orderkey FROM orders GROUP BY o_custkey""",
    "argmax_runner_up": """
        WITH l AS (SELECT song_id, list(midi_note ORDER BY d DESC, midi_note) AS m FROM (SELECT song_id, midi_note, sum(end_sample - start_sample) AS d FROM note GROUP BY ALL) GROUP BY song_id) SELECT song_id, m[1] AS best, m[2] AS second FROM l""",
    "external_transitions": """
        WITH n AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY start_sample, end_sample, seq) AS i FROM note)
        SELECT b.song_id, b.start_sample AS sample FROM n a JOIN n b ON a.song_id = b.song_id AND a.i + 1 = b.i WHERE NOT (a.midi_note = b.midi_note AND b.start_sample <= a.end_sample)""",
    "split_runs": """
        WITH cut AS (SELECT song_id, idx, (SELECT count(*) FROM boundary b WHERE b.song_id = f.song_id AND b.probability >= 0.5 AND b.sample <= f.idx * 480) AS part FROM pitch_frame f)
        SELECT song_id, part, min(idx) * 480 AS start_sample, (max(idx) + 1) * 480 AS end_sample FROM cut GROUP BY song_id, part""",
    "tempo_integral": """
        WITH c AS (SELECT song_id, idx * 120 AS tick, 400000 + (event_id % 9) * 50000 AS tempo FROM pitch_frame WHERE event_type = 'click'), n AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY tick) AS i FROM c),
        p AS (SELECT b.song_id, b.tick, (b.tick - a.tick) * a.tempo AS part FROM n a JOIN n b ON a.song_id = b.song_id AND b.i = a.i + 1)
        SELECT song_id, tick, tempo, CAST(coalesce((SELECT sum(part) FROM p WHERE p.song_id = c.song_id AND p.tick <= c.tick), 0) AS BIGINT) AS numerator FROM c""",
    "window_owner": """
        SELECT n.song_id, n.seq, w AS window_id FROM note n, range(0, 1000) r(w) WHERE n.start_sample + n.end_sample >= 2 * w * 1344000 AND n.start_sample + n.end_sample < 2 * (w + 1) * 1344000 AND n.start_sample + 48000 >= w * 1344000 AND n.end_sample - 48000 <= (w + 1) * 1344000""",
    "frame_to_sample": "SELECT event_id, idx * 480 AS sample FROM pitch_frame",
    "time_format": """
        SELECT song_id, seq, (start_sample // 48000 // 60) || ':' || right('0' || (start_sample // 48000 % 60), 2) || '.' || (start_sample % 48000 // 4800) AS shown FROM note""",
    "top_states": """
        SELECT song_id, unnest(list_slice(l, 1, 8)) AS idx, unnest(range(1, least(len(l), 8) + 1)) AS place FROM (SELECT song_id, list(idx ORDER BY confidence DESC, voiced_probability DESC NULLS LAST, idx) AS l FROM pitch_frame GROUP BY song_id)""",
    "canonical_order": """
        SELECT song_id, unnest(l) AS turn, unnest(range(1, len(l) + 1)) AS place FROM (SELECT song_id, list(turn ORDER BY start_sample, end_sample, role, turn) AS l FROM lyric_segment GROUP BY song_id)""",
    "key_set_equality": """
        SELECT c_nationkey AS nation, 'only_left' AS side FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT s_nationkey, 'only_right' FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)
        UNION ALL SELECT c_nationkey, 'both' FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)""",
    "release_verdict": """
        WITH s AS (SELECT n_nationkey, n_regionkey, (SELECT CASE WHEN count(*) = 0 THEN 'unverified' WHEN count(*) FILTER (s_acctbal < 0) > 0 THEN 'fail' ELSE 'pass' END FROM supplier WHERE s_nationkey = n_nationkey) AS status FROM nation), l AS (SELECT n_regionkey, list(status) AS l FROM s GROUP BY n_regionkey)
        SELECT n_regionkey AS release, CASE WHEN len(list_filter(l, lambda x: x <> 'pass')) = 0 THEN 'pass' WHEN list_contains(l, 'fail') THEN 'fail' ELSE 'unverified' END AS verdict, len(list_filter(l, lambda x: x = 'unverified')) AS missing FROM l""",
    "cer_regression": """
        WITH h AS (SELECT l_suppkey, l_linenumber % 2 AS side, CAST(count(*) AS HUGEINT) AS n, CAST(count(*) FILTER (l_returnflag = 'R') AS HUGEINT) AS e FROM lineitem GROUP BY ALL)
        SELECT a.l_suppkey, CAST(b.e AS DECIMAL(30, 0)) * a.n * 50 <= a.n * b.n + CAST(a.e AS DECIMAL(30, 0)) * b.n * 50 AS within FROM h a JOIN h b ON a.l_suppkey = b.l_suppkey AND a.side = 0 AND b.side = 1""",
    "score_eligibility": """
        SELECT user_id, x.event_type AS reason, x.event_id FROM (SELECT user_id, arg_min({'event_type': event_type, 'event_id': event_id}, (ts, event_id)) AS x FROM events WHERE value > 200 GROUP BY user_id)""",
    "monotone_position": """
        SELECT a.user_id, a.event_id, CASE WHEN a.value IS NOT NULL AND EXISTS (SELECT 1 FROM events b WHERE b.user_id IS NOT DISTINCT FROM a.user_id AND (b.ts, b.event_id) < (a.ts, a.event_id) AND b.value > a.value) THEN 'regressed' ELSE 'moved' END AS status FROM events a""",
    "event_log_gap": """
        WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, greatest(n - 63, 1) AS oldest, n AS newest, n > 74 AS gap FROM n""",
    "command_dedup": """
        WITH c AS (SELECT o_orderkey, o_custkey, o_orderkey % 3 AS k, o_orderstatus FROM orders), h AS (SELECT o_custkey, k, min(o_orderkey) AS first, arg_min(o_orderstatus, o_orderkey) AS content FROM c GROUP BY ALL)
        SELECT o_orderkey, CASE WHEN o_orderkey = first THEN 'applied' WHEN o_orderstatus IS NOT DISTINCT FROM content THEN 'replay' ELSE 'conflict' END AS outcome FROM c JOIN h USING (o_custkey, k)""",
    "job_latest": """
        WITH n AS (SELECT l_orderkey, l_quantity, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem), e AS (SELECT l_orderkey, min(i) FILTER (l_returnflag = 'R') AS last FROM n GROUP BY l_orderkey)
        SELECT l_orderkey AS job, max(l_quantity) FILTER (i <= coalesce(last, i)) AS progress, bool_or(last IS NOT NULL) AS finished FROM n JOIN e USING (l_orderkey) GROUP BY l_orderkey""",
    "stream_gaps": """
        SELECT user_id, event_id, event_id - before - 1 AS missing FROM (SELECT a.user_id, a.event_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id IS NOT DISTINCT FROM a.user_id AND b.event_id < a.event_id) AS before FROM events a) WHERE event_id - before > 1""",
    "backlog_last_two": "SELECT user_id, unnest(list_slice(list(event_id ORDER BY ts DESC, event_id DESC), 1, 2)) AS event_id FROM events GROUP BY user_id",
    "preview_stop": "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE value >= 150 GROUP BY user_id",
    "busy_session": """
        SELECT a.o_orderkey, EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus <> 'F' AND (b.o_orderdate, b.o_orderkey) < (a.o_orderdate, a.o_orderkey)) AS busy FROM orders a""",
    "evidence_union": """
        SELECT DISTINCT song_id, sample, 'event' AS source FROM boundary UNION ALL SELECT DISTINCT song_id, start_sample, 'external' FROM note n ANTI JOIN boundary b ON b.song_id = n.song_id AND b.sample = n.start_sample""",
    "distinct_ranges": """
        SELECT song_id, start_sample, end_sample, turn AS first_turn FROM lyric_segment a WHERE NOT EXISTS (SELECT 1 FROM lyric_segment b WHERE b.song_id = a.song_id AND b.start_sample = a.start_sample AND b.end_sample = a.end_sample AND b.turn < a.turn)""",
    "capped_history": """
        SELECT o_custkey, unnest(l[:-5]) AS o_orderkey FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS l FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)""",
    "rate_with_empty": """
        WITH n AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n, count(*) FILTER (l_linestatus = 'F') AS d FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN n + d = 0 THEN 0.0 ELSE round(n / nullif(d, 0), 6) END AS rate FROM n""",
    "pitch_class_histogram": """
        SELECT song_id, k AS pitch_class, round(sum(span), 4) AS weight FROM (SELECT song_id, CASE WHEN midi_note >= 12 THEN midi_note - 12 * (midi_note // 12) ELSE midi_note END AS k, confidence * end_sample - confidence * start_sample AS span FROM note) GROUP BY song_id, k""",
    "rollup_cases": """
        SELECT song_id, count(*) AS notes, sum(end_sample - start_sample) AS samples FROM note GROUP BY song_id UNION ALL SELECT NULL, count(*), sum(end_sample) - sum(start_sample) FROM note""",
}
