"""Note candidates: boundaries, runs, merges and ledgers; ORACLE holds a second reading of each query in another form."""

Q, ORACLE = {}, {}


def _q(name, needs, tables, sql, oracle):
    Q[name], ORACLE[name] = (needs, tables, sql), oracle


# Vocal events and pitch transitions between notes; of one sample the most probable, on ties the vocal event
_BOTH = """
    marks AS (SELECT song_id, sample, probability, 0 AS external FROM boundary UNION ALL
             SELECT song_id, start_sample, confidence, 1 FROM (
               SELECT song_id, start_sample, confidence, midi_note, lag(midi_note) OVER (PARTITION BY song_id ORDER BY start_sample, end_sample, seq) AS was FROM note) t WHERE was <> midi_note)"""
_q("boundary_dedup", ["boundary", "note"], [], f"""
    WITH {_BOTH} SELECT song_id, sample, probability, external FROM (
      SELECT song_id, sample, probability, external, row_number() OVER (PARTITION BY song_id, sample ORDER BY probability DESC, external) AS r FROM marks) x WHERE r = 1""",
   f"""
    WITH {_BOTH}, top AS (SELECT song_id, sample, max(probability) AS probability FROM marks GROUP BY song_id, sample)
    SELECT song_id, sample, probability, min(external) AS external FROM marks JOIN top USING (song_id, sample, probability) GROUP BY song_id, sample, probability""")

# Vocal events, and passages between external notes: both at least 0.6 sure, and another pitch or a gap of two hops
_CANDIDATES = "candidate AS (SELECT song_id, start_sample, end_sample, midi_note, seq, round(confidence - 0.15E0, 4) AS sure FROM note)"
_MARKS = f"""
    {_CANDIDATES}, both_marks AS (
      SELECT song_id, sample, probability, 0 AS external FROM boundary UNION ALL
      SELECT song_id, start_sample, strength, 1 FROM (
        SELECT song_id, start_sample, least(sure, lag(sure) OVER w) AS strength, midi_note <> lag(midi_note) OVER w OR start_sample - lag(end_sample) OVER w >= 960 AS passes
        FROM candidate WINDOW w AS (PARTITION BY song_id ORDER BY start_sample, end_sample, seq)) p WHERE strength >= 0.6E0 AND passes),
    mark AS (SELECT song_id, sample, probability, external FROM (
      SELECT song_id, sample, probability, external, row_number() OVER (PARTITION BY song_id, sample ORDER BY probability DESC, external) AS r FROM both_marks) m WHERE r = 1)"""
_SLOW_MARKS = f"""
    {_CANDIDATES}, placed AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY start_sample, end_sample, seq) AS n FROM candidate),
    both_marks AS (SELECT song_id, sample, probability, 0 AS external FROM boundary UNION ALL
      SELECT b.song_id, b.start_sample, least(a.sure, b.sure), 1 FROM placed a JOIN placed b ON a.song_id = b.song_id AND b.n = a.n + 1
      WHERE least(a.sure, b.sure) >= 0.6 AND NOT (a.midi_note = b.midi_note AND b.start_sample < a.end_sample + 960)),
    mark AS (SELECT song_id, sample, max(probability) AS probability, min(external) FILTER (probability = top) AS external FROM (SELECT *, max(probability) OVER (PARTITION BY song_id, sample) AS top FROM both_marks) GROUP BY song_id, sample)"""

# Five hops before and after a boundary: frames and boundaries stand in one line per song, and each boundary looks five hops back and four ahead, so that no row is repeated and songs move once
_AROUND = "OVER (PARTITION BY song_id ORDER BY hop RANGE BETWEEN"
_FACTS = f"""
    line AS (SELECT song_id, idx AS hop, CAST(NULL AS BIGINT) AS sample, CAST(NULL AS DOUBLE) AS probability, CAST(NULL AS INT) AS external, CASE WHEN voiced_probability >= 0.6 THEN midi END AS midi, 1 - voiced_probability AS silence, (event_id * 7 % 100) / 100.0E0 AS breath FROM pitch_frame
             UNION ALL SELECT song_id, CAST(sample / 480 AS BIGINT), sample, probability, external, NULL, NULL, NULL FROM mark),
    around AS (SELECT song_id, sample, probability, external, array_sort(collect_list(midi) {_AROUND} 5 PRECEDING AND 1 PRECEDING)) AS b, array_sort(collect_list(midi) {_AROUND} CURRENT ROW AND 4 FOLLOWING)) AS a,
                      coalesce(max(silence) {_AROUND} 1 PRECEDING AND 1 FOLLOWING), 0.0E0) AS silence, coalesce(max(breath) {_AROUND} 1 PRECEDING AND 1 FOLLOWING), 0.0E0) AS breath
               FROM line),
    facts AS (SELECT song_id, sample, probability, external, (get(b, CAST((size(b) - 1) / 2 AS INT)) + get(b, CAST(size(b) / 2 AS INT))) / 2 AS before_midi, (get(a, CAST((size(a) - 1) / 2 AS INT)) + get(a, CAST(size(a) / 2 AS INT))) / 2 AS after_midi, silence, breath FROM around WHERE external IS NOT NULL)"""
_REASON = "CASE WHEN probability >= 0.85 THEN 'strong_boundary' WHEN silence >= 0.55 OR breath >= 0.65 THEN 'silence_or_breath' WHEN abs(after_midi - before_midi) * 100.0 >= 70.0 THEN 'sustained_pitch_change' WHEN external = 1 AND probability >= 0.8E0 THEN 'external_transition' ELSE 'expressive_motion_suppressed' END"
_SLOW = """
    facts AS (SELECT b.song_id, b.sample, b.probability, b.external,
        (SELECT median(f.midi) FROM pitch_frame f WHERE f.song_id = b.song_id AND f.voiced_probability >= 0.6 AND f.idx * 480 + 240 >= b.sample - 2400 AND f.idx * 480 + 240 < b.sample) AS before_midi,
        (SELECT median(f.midi) FROM pitch_frame f WHERE f.song_id = b.song_id AND f.voiced_probability >= 0.6 AND f.idx * 480 + 240 >= b.sample AND f.idx * 480 + 240 < b.sample + 2400) AS after_midi,
        coalesce((SELECT max(1 - f.voiced_probability) FROM pitch_frame f WHERE f.song_id = b.song_id AND f.idx * 480 BETWEEN b.sample - 480 AND b.sample + 480), 0.0) AS silence,
        coalesce((SELECT max((f.event_id * 7 % 100) / 100.0) FROM pitch_frame f WHERE f.song_id = b.song_id AND f.idx * 480 BETWEEN b.sample - 480 AND b.sample + 480), 0.0) AS breath FROM mark b)"""
_q("median_around", ["boundary", "note"], [], f"WITH {_MARKS}, {_FACTS} SELECT song_id, sample, round(before_midi, 6) AS before_midi, round(after_midi, 6) AS after_midi FROM facts",
   f"WITH {_SLOW_MARKS}, {_SLOW} SELECT song_id, sample, round(before_midi, 6) AS before_midi, round(after_midi, 6) AS after_midi FROM facts")
_q("boundary_decision", ["boundary", "note"], [], f"WITH {_MARKS}, {_FACTS} SELECT song_id, sample, probability, {_REASON} AS reason, {_REASON} <> 'expressive_motion_suppressed' AS accepted FROM facts",
   f"""
    WITH {_SLOW_MARKS}, {_SLOW} SELECT song_id, sample, probability, r AS reason, r <> 'expressive_motion_suppressed' AS accepted FROM (
      SELECT *, list_filter(['strong_boundary', 'silence_or_breath', 'sustained_pitch_change', 'external_transition', 'expressive_motion_suppressed'],
        lambda x, i: [probability >= 0.85, greatest(silence - 0.55, breath - 0.65) >= 0, coalesce(abs(after_midi - before_midi) * 100 >= 70, false), external > 0 AND probability >= 0.8, true][i])[1] AS r FROM facts)""")

_q("voiced_runs", ["pitch_frame"], [], """
    SELECT song_id, run, min(idx) * 480 AS start_sample, max(idx) * 480 + 480 AS end_sample, count(*) AS frames, round(median(midi), 6) AS median_midi FROM (
      SELECT song_id, idx, midi, sum(brk) OVER (PARTITION BY song_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (
        SELECT song_id, idx, midi, CASE WHEN idx - lag(idx) OVER (PARTITION BY song_id ORDER BY idx) - 1 <= 2 THEN 0 ELSE 1 END AS brk
        FROM pitch_frame WHERE midi IS NOT NULL AND voiced_probability >= 0.6) a) b
    GROUP BY song_id, run""",
   """
    WITH v AS (SELECT song_id, idx, midi FROM pitch_frame WHERE midi IS NOT NULL AND voiced_probability >= 0.6),
    s AS (SELECT song_id, idx FROM v WHERE NOT EXISTS (SELECT 1 FROM v p WHERE p.song_id = v.song_id AND p.idx BETWEEN v.idx - 3 AND v.idx - 1)),
    e AS (SELECT v.*, (SELECT count(*) FROM s WHERE s.song_id = v.song_id AND s.idx <= v.idx) AS run FROM v)
    SELECT song_id, run, min(idx) * 480 AS start_sample, (max(idx) + 1) * 480 AS end_sample, count(*) AS frames, round(median(midi), 6) AS median_midi FROM e GROUP BY song_id, run""")

# Zero total weight falls back to the plain median
_WEIGHT = "weighed AS (SELECT song_id, event_id, value, CASE WHEN song_id % 5 = 0 THEN 0 ELSE event_id % 100 END AS weight FROM pitch_frame WHERE value IS NOT NULL)"
_q("weighted_median", ["pitch_frame"], [], f"""
    WITH {_WEIGHT} SELECT song_id, round(CASE WHEN max(total) = 0 THEN median(value) ELSE min(CASE WHEN 2 * run >= total THEN value END) END, 6) AS weighted_median FROM (
      SELECT song_id, value, sum(weight) OVER (PARTITION BY song_id ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(weight) OVER (PARTITION BY song_id) AS total FROM weighed) w GROUP BY song_id""",
   f"""
    WITH {_WEIGHT}, t AS (SELECT song_id, sum(weight) AS total, median(value) AS middle FROM weighed GROUP BY song_id)
    SELECT song_id, round(CASE WHEN total = 0 THEN middle ELSE (SELECT min(a.value) FROM weighed a WHERE a.song_id = t.song_id AND 2 * (SELECT sum(b.weight) FROM weighed b WHERE b.song_id = a.song_id AND b.value <= a.value) >= t.total) END, 6) AS weighted_median FROM t""")

_q("monophonic", ["note"], [], """
    SELECT song_id, midi_note, start_sample, end_sample FROM (
      SELECT song_id, midi_note, start_sample, least(end_sample, coalesce(lead(start_sample) OVER (PARTITION BY song_id ORDER BY start_sample), end_sample)) AS end_sample FROM (
        SELECT song_id, midi_note, start_sample, end_sample, row_number() OVER (PARTITION BY song_id, start_sample ORDER BY midi_note DESC, end_sample DESC) AS r FROM note) a WHERE r = 1) b WHERE end_sample > start_sample""",
   """
    WITH top AS (SELECT song_id, start_sample, max(midi_note) AS midi_note FROM note GROUP BY ALL),
    one AS (SELECT song_id, start_sample, midi_note, max(end_sample) AS end_sample FROM note JOIN top USING (song_id, start_sample, midi_note) GROUP BY ALL)
    SELECT a.song_id, a.midi_note, a.start_sample, least(a.end_sample, coalesce((SELECT min(b.start_sample) FROM one b WHERE b.song_id = a.song_id AND b.start_sample > a.start_sample), a.end_sample)) AS end_sample FROM one a""")

# Equal pitch, at most two hops apart, no strong boundary between
_LINE = "melody AS (SELECT song_id, seq, start_sample, start_sample + 9000 AS end_sample, 60 + midi_note % 3 AS pitch, (seq * 37 + midi_note * 13) % 100 / 100.0E0 AS strength FROM note)"
_q("equal_pitch_islands", ["note"], [], f"""
    WITH {_LINE} SELECT song_id, island, min(start_sample) AS start_sample, max(end_sample) AS end_sample, max(pitch) AS pitch, count(*) AS notes FROM (
      SELECT song_id, pitch, start_sample, end_sample, sum(brk) OVER (PARTITION BY song_id ORDER BY start_sample, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (
        SELECT song_id, seq, pitch, start_sample, end_sample, CASE WHEN pitch = lag(pitch) OVER w AND start_sample - lag(end_sample) OVER w <= 960 AND greatest(strength, lag(strength) OVER w) < 0.85 THEN 0 ELSE 1 END AS brk
        FROM melody WINDOW w AS (PARTITION BY song_id ORDER BY start_sample, seq)) a) b GROUP BY song_id, island""",
   f"""
    WITH {_LINE}, p AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY start_sample, seq) AS pos FROM melody),
    h AS (SELECT b.song_id, b.pos FROM p b LEFT JOIN p a ON a.song_id = b.song_id AND a.pos = b.pos - 1
          WHERE a.pos IS NULL OR a.pitch <> b.pitch OR b.start_sample > a.end_sample + 960 OR a.strength >= 0.85 OR b.strength >= 0.85)
    SELECT song_id, island, min(start_sample) AS start_sample, max(end_sample) AS end_sample, max(pitch) AS pitch, count(*) AS notes
    FROM (SELECT p.*, (SELECT count(*) FROM h WHERE h.song_id = p.song_id AND h.pos <= p.pos) AS island FROM p) GROUP BY song_id, island""")

# A ledger whose entries name the value before them; every thirteenth names a wrong one
_LEDGER = """
    chain AS (SELECT o_custkey, o_orderkey, o_totalprice AS new, row_number() OVER w AS version, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice ELSE lag(o_totalprice) OVER w END AS old
              FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
_q("ledger_replay", [], ["orders"], f"""
    WITH {_LEDGER} SELECT o_custkey, count(*) AS entries, min(CASE WHEN broken THEN version END) AS first_broken, max(CASE WHEN last = 1 THEN new END) AS current_value FROM (
      SELECT o_custkey, version, new, NOT (old <=> lag(new) OVER (PARTITION BY o_custkey ORDER BY version)) AS broken, row_number() OVER (PARTITION BY o_custkey ORDER BY version DESC) AS last FROM chain) x GROUP BY o_custkey""",
   f"""
    WITH {_LEDGER}, j AS (SELECT b.*, a.new AS prev FROM chain b LEFT JOIN chain a ON a.o_custkey = b.o_custkey AND a.version = b.version - 1)
    SELECT o_custkey, count(*) AS entries, min(version) FILTER (old IS DISTINCT FROM prev) AS first_broken, arg_max(new, version) AS current_value FROM j GROUP BY o_custkey""")

_q("in_scale", ["note"], [], "SELECT song_id, seq, pmod(midi_note - song_id % 12, 12) IN (0, 2, 4, 5, 7, 9, 11) AS in_scale FROM note",
   "SELECT song_id, seq, substr('101011010101', CAST((midi_note + 144 - song_id % 12) % 12 AS INT) + 1, 1) = '1' AS in_scale FROM note")

# Lines of a conversation: the other role's line that overlaps most, the first on ties; none keeps the line.
# The longest overlap is among the lines of both roles only, so ranges are joined per conversation and cell of 48,000 samples.
_CELLS = "(SELECT song_id, turn, role, start_sample, end_sample, explode(sequence(CAST(floor(start_sample / 48000) AS BIGINT), CAST(floor(greatest(start_sample, end_sample - 1) / 48000) AS BIGINT))) AS cell FROM lyric_segment)"
_q("lyric_by_overlap", ["lyric_segment"], [], f"""
    SELECT song_id, turn, max(CASE WHEN r = 1 THEN other END) AS other FROM (
      SELECT song_id, turn, other, row_number() OVER (PARTITION BY song_id, turn ORDER BY held DESC NULLS LAST, other) AS r FROM (
        SELECT a.song_id, a.turn, b.turn AS other, max(CASE WHEN b.turn IS NOT NULL THEN least(a.end_sample, b.end_sample) - greatest(a.start_sample, b.start_sample) END) AS held
        FROM {_CELLS} a LEFT JOIN {_CELLS} b ON a.song_id = b.song_id AND a.cell = b.cell AND NOT (a.role <=> b.role) AND a.start_sample < b.end_sample AND b.start_sample < a.end_sample GROUP BY a.song_id, a.turn, b.turn) o) x GROUP BY song_id, turn""",
   """
    SELECT DISTINCT a.song_id, a.turn, (SELECT b.turn FROM lyric_segment b WHERE b.song_id = a.song_id AND b.role IS DISTINCT FROM a.role AND a.start_sample < b.end_sample AND b.start_sample < a.end_sample
      ORDER BY least(a.end_sample, b.end_sample) - greatest(a.start_sample, b.start_sample) DESC, b.turn LIMIT 1) AS other FROM lyric_segment a""")

# Nearest ranks over few groups: values are counted first, so no task sorts a group's rows
_q("load_phase", [], ["lineitem"], """
    SELECT l_returnflag AS phase, max(n) AS n, min(CASE WHEN run >= ceil(n * 0.5E0) THEN q END) AS p50, min(CASE WHEN run >= ceil(n * 0.95E0) THEN q END) AS p95, min(CASE WHEN run >= ceil(n * 0.99E0) THEN q END) AS p99,
           max(q) AS most, sum(CASE WHEN q > 45 THEN c ELSE 0 END) AS late FROM (
      SELECT l_returnflag, q, c, sum(c) OVER (PARTITION BY l_returnflag ORDER BY q) AS run, sum(c) OVER (PARTITION BY l_returnflag) AS n FROM (
        SELECT l_returnflag, l_quantity AS q, count(*) AS c FROM lineitem GROUP BY l_returnflag, l_quantity) a) b GROUP BY l_returnflag""",
   """
    SELECT l_returnflag AS phase, count(*) AS n, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.95) AS p95, quantile_disc(l_quantity, 0.99) AS p99, max(l_quantity) AS most, count(*) FILTER (l_quantity > 45) AS late FROM lineitem GROUP BY l_returnflag""")
_q("benchmark_stats", [], ["orders"], """
    SELECT o_orderstatus AS outcome, max(n) AS n, min(v) AS least, round(avg(CASE WHEN run >= floor((n + 1) / 2) AND run - c < floor((n + 1) / 2) OR run >= floor(n / 2) + 1 AND run - c < floor(n / 2) + 1 THEN v END), 2) AS middle,
           round(sum(v * c) / max(n), 2) AS mean, max(v) AS most FROM (
      SELECT o_orderstatus, v, c, sum(c) OVER (PARTITION BY o_orderstatus ORDER BY v) AS run, sum(c) OVER (PARTITION BY o_orderstatus) AS n FROM (
        SELECT o_orderstatus, round(o_totalprice / 100) AS v, count(*) AS c FROM orders GROUP BY o_orderstatus, round(o_totalprice / 100)) a) b GROUP BY o_orderstatus""",
   """
    SELECT o_orderstatus AS outcome, count(*) AS n, min(v) AS least, round(median(v), 2) AS middle, round(avg(v), 2) AS mean, max(v) AS most FROM (SELECT o_orderstatus, round(o_totalprice / 100) AS v FROM orders) GROUP BY o_orderstatus""")
