"""Operators of the song-preparation domain as declarative plans: name -> (views, tables, SQL)."""
from functools import partial

from . import checks, evaluation, library, metrics, notes, provenance, rules, second, session, signals, timeline, views

Q = {}


def _q(name, needs, tables, sql):
    Q[name] = (needs, tables, sql)


# Scalars and predicates
_q("hz_to_midi", ["pitch_frame"], [], "SELECT event_id, round(midi, 6) AS midi FROM pitch_frame")
_q("clamp", ["pitch_frame"], [], "SELECT event_id, least(80.0E0, greatest(20.0E0, value)) AS clamped FROM pitch_frame WHERE value IS NOT NULL")
_q("voiced_projection", ["pitch_frame"], [], "SELECT event_id, CASE WHEN midi IS NOT NULL AND voiced_probability >= 0.6 THEN round(midi, 6) END AS voiced_midi FROM pitch_frame")
_q("single_detector", ["pitch_frame"], [], "SELECT event_id, CASE WHEN voiced_probability >= 0.6 THEN f0_hz END AS hz, CASE WHEN voiced_probability >= 0.6 AND f0_hz IS NOT NULL THEN confidence ELSE 0.0E0 END AS confidence FROM pitch_frame")
_q("window_cells", ["pitch_frame"], [], """
    SELECT song_id, idx, CASE WHEN before IS NULL THEN 0 ELSE CAST(floor((before + center) / 2) AS BIGINT) END AS cell_start,
           CASE WHEN after IS NULL THEN center + 240 ELSE CAST(floor((center + after) / 2) AS BIGINT) END AS cell_end
    FROM (SELECT song_id, idx, idx * 480 + 240 AS center, lag(idx * 480 + 240) OVER (PARTITION BY song_id ORDER BY idx) AS before,
                 lead(idx * 480 + 240) OVER (PARTITION BY song_id ORDER BY idx) AS after FROM pitch_frame) w""")
_q("seconds_to_samples", [], ["orders"], "SELECT o_orderkey, CAST(round(CAST(o_totalprice / 1000 AS DECIMAL(20,6)) * 48000) AS BIGINT) AS sample FROM orders WHERE o_totalprice BETWEEN 0 AND 3600000")
_q("span_validity", ["lyric_segment"], [], "SELECT song_id, turn, CASE WHEN start_sample < 0 THEN 'negative' WHEN end_sample <= start_sample THEN 'empty' ELSE 'ok' END AS status FROM lyric_segment")
_q("confidence_range", ["note"], [], "SELECT song_id, seq, confidence BETWEEN 0 AND 1 AS valid FROM note")
_q("unreferenced_orders", [], ["orders", "lineitem"], "SELECT l_orderkey, l_linenumber FROM lineitem LEFT ANTI JOIN orders ON l_orderkey = o_orderkey")

# Joins; every range carries song equality
_q("lyric_at_sample", ["lyric_segment"], [], """
    SELECT song_id, probe, turn FROM (
      SELECT p.song_id, p.probe, s.turn, row_number() OVER (PARTITION BY p.song_id, p.probe ORDER BY s.start_sample DESC, s.turn) AS r
      FROM (SELECT DISTINCT song_id, start_sample + 2400 AS probe FROM lyric_segment) p
      LEFT JOIN lyric_segment s ON p.song_id = s.song_id AND s.start_sample <= p.probe AND p.probe < s.end_sample) x WHERE r = 1""")
_q("notes_overlapping", ["note"], [], "SELECT song_id, seq, midi_note FROM note WHERE start_sample < 24000 AND end_sample > 4800")
_q("asof_boundary", ["pitch_frame", "boundary"], [], """
    SELECT song_id, idx, max(sample) OVER (PARTITION BY song_id ORDER BY idx, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_boundary, kind FROM (
      SELECT song_id, idx, 1 AS kind, CAST(NULL AS BIGINT) AS sample FROM pitch_frame
      UNION ALL SELECT song_id, CAST(floor(sample / 480) AS BIGINT) AS idx, 0 AS kind, CAST(sample AS BIGINT) AS sample FROM boundary) u""")
_q("near_event_strength", ["pitch_frame", "boundary"], [], """
    SELECT f.song_id, f.idx, coalesce(max(b.probability), 0.0E0) AS strength FROM (SELECT song_id, idx, explode_at FROM pitch_frame CROSS JOIN (SELECT -1 AS explode_at UNION ALL SELECT 0 UNION ALL SELECT 1) o) f
    LEFT JOIN boundary b ON f.song_id = b.song_id AND (f.idx + f.explode_at) * 480 = b.sample GROUP BY f.song_id, f.idx""")

# Aggregates
_q("median_pitch", ["pitch_frame"], [], "SELECT song_id, round(median(midi), 6) AS median_midi FROM pitch_frame GROUP BY song_id")
_q("split_leakage", [], ["documents"], "SELECT source, count(DISTINCT CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS splits FROM documents GROUP BY source HAVING count(DISTINCT CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) > 1")
_q("normalise_p95", ["pitch_frame"], [], """
    SELECT f.song_id, f.event_id, round(CASE WHEN p.q > 0 THEN least(1.0E0, greatest(0.0E0, f.value / p.q)) ELSE 0.0E0 END, 6) AS strength
    FROM pitch_frame f JOIN (SELECT song_id, percentile_cont(0.95) WITHIN GROUP (ORDER BY CASE WHEN value > 1E-12 THEN value END) AS q FROM pitch_frame GROUP BY song_id) p ON f.song_id = p.song_id""")
_q("rollup_cases", ["note"], [], "SELECT song_id, count(*) AS notes, sum(end_sample - start_sample) AS samples FROM note GROUP BY ROLLUP(song_id)")

# Windows
_q("energy_rise", ["pitch_frame"], [], "SELECT song_id, idx, round(db - lag(db) OVER (PARTITION BY song_id ORDER BY idx), 6) AS delta_db FROM (SELECT song_id, idx, 20 * log10(greatest(abs(value), 1E-8)) AS db FROM pitch_frame) e")
_q("local_maxima", ["pitch_frame"], [], """
    SELECT song_id, idx FROM (SELECT song_id, idx, confidence AS c, coalesce(lag(confidence) OVER (PARTITION BY song_id ORDER BY idx), -1) AS a, coalesce(lead(confidence) OVER (PARTITION BY song_id ORDER BY idx), -1) AS b FROM pitch_frame) x
    WHERE c >= 0.5 AND c >= a AND c >= b""")
_q("grid_splat", ["boundary"], [], "SELECT song_id, sample + step * 480 AS sample, max(probability * w) AS strength FROM boundary CROSS JOIN (SELECT -1 AS step, 0.35E0 AS w UNION ALL SELECT 0, 1.0E0 UNION ALL SELECT 1, 0.35E0) k WHERE sample + step * 480 >= 0 GROUP BY song_id, sample + step * 480")
_q("interval_union", ["lyric_segment"], [], """
    SELECT song_id, island, min(start_sample) AS start_sample, max(end_sample) AS end_sample FROM (
      SELECT song_id, start_sample, end_sample, sum(brk) OVER (PARTITION BY song_id ORDER BY start_sample, end_sample, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (
        SELECT song_id, turn, start_sample, end_sample, CASE WHEN start_sample > max(end_sample) OVER (PARTITION BY song_id ORDER BY start_sample, end_sample, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS brk FROM lyric_segment) a) b
    GROUP BY song_id, island""")
_q("ordered_ids", ["note"], [], "SELECT song_id, seq, concat('note-', lpad(CAST(row_number() OVER (PARTITION BY song_id ORDER BY start_sample, end_sample, seq) AS VARCHAR(20)), 4, '0')) AS note_id FROM note")

# Sorts, top-k, retention
_q("retention", [], ["orders"], "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) x WHERE r <= 8")
_q("argmax_runner_up", ["note"], [], """
    SELECT song_id, max(CASE WHEN r = 1 THEN midi_note END) AS best, max(CASE WHEN r = 2 THEN midi_note END) AS second FROM (
      SELECT song_id, midi_note, row_number() OVER (PARTITION BY song_id ORDER BY d DESC, midi_note) AS r FROM (SELECT song_id, midi_note, sum(end_sample - start_sample) AS d FROM note GROUP BY song_id, midi_note) a) b WHERE r <= 2 GROUP BY song_id""")

for _more in (timeline, evaluation, library, session, signals, notes, checks, metrics, rules, provenance):
    Q.update(_more.Q)


def _run(name, spark, sf_dir):
    """The query over the tables of one folder, which stand in it by path, so that folders do not meet in a session's names."""
    needs, tables, sql = Q[name]
    used = dict.fromkeys([t for v in views.closure(needs) for t in views.SOURCES[v]] + tables)
    text = views.with_views(needs, sql, views.DEALT if name in notes.Q else views.VIEWS).strip()
    own = ", ".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in used)
    return spark.sql(f"WITH {own}, {text[5:]}" if text[:5].upper() == "WITH " else f"WITH {own} {text}")


def queries():
    return {n: partial(_run, n) for n in Q}


def oracle_sql():
    """SQL for each query: a reading of its own where notes, checks, metrics, rules, provenance or second has one, else the query's text."""
    return {n: views.with_views(needs, (notes.ORACLE | checks.ORACLE | metrics.ORACLE | rules.ORACLE | provenance.ORACLE | second.ORACLE).get(n, sql)).replace("LEFT ANTI JOIN", "ANTI JOIN") for n, (needs, _, sql) in Q.items()}
