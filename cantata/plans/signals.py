"""Scores, gates and geometry over frames and notes."""

Q = {}

Q["energy_gate"] = (["pitch_frame"], [], "SELECT event_id, round(least(1.0E0, greatest(0.0E0, (20 * log10(greatest(abs(value), 1E-8)) + 60) / 30)), 6) AS gate FROM pitch_frame WHERE value IS NOT NULL")
Q["parabolic_peak"] = (["pitch_frame"], [], """
    SELECT song_id, idx, round(CASE WHEN a - 2 * b + c = 0 THEN 0.0E0 ELSE 0.5E0 * (a - c) / (a - 2 * b + c) END, 5) AS shift FROM (
      SELECT song_id, idx, lag(value) OVER (PARTITION BY song_id ORDER BY idx) AS a, value AS b, lead(value) OVER (PARTITION BY song_id ORDER BY idx) AS c FROM pitch_frame) x
    WHERE a IS NOT NULL AND c IS NOT NULL AND b >= a AND b >= c""")
Q["gaussian_distance"] = (["pitch_frame"], [], "SELECT event_id, round(exp(-0.5E0 * pow(100 * (midi - round(midi)) / 45, 2)), 6) AS score FROM pitch_frame WHERE midi IS NOT NULL")
Q["noisy_or"] = (["boundary"], [], """
    SELECT song_id, round(1 - exp(sum(ln(1 - least(0.999E0, greatest(0.0E0, probability))))), 6) AS combined FROM boundary GROUP BY song_id""")
# Steps of the major scale
Q["pitch_bars"] = (["note"], [], """
    SELECT song_id, seq, round(greatest(0, start_sample) / 288000.0E0, 6) AS x, round((least(288000, end_sample) - greatest(0, start_sample)) / 288000.0E0, 6) AS width, 127 - midi_note AS y
    FROM note WHERE start_sample < 288000 AND end_sample > 0""")
Q["feature_fusion"] = (["pitch_frame"], [], """
    SELECT event_id, round((0.6E0 * confidence + CASE WHEN midi IS NULL THEN 0.0E0 ELSE 0.4E0 * voiced_probability END) / (0.6E0 + CASE WHEN midi IS NULL THEN 0.0E0 ELSE 0.4E0 END), 6) AS fused FROM pitch_frame""")
Q["evidence_union"] = (["boundary", "note"], [], """
    SELECT song_id, sample, min(source) AS source FROM (
      SELECT song_id, sample, 'event' AS source FROM boundary UNION ALL SELECT song_id, start_sample AS sample, 'external' AS source FROM note) u GROUP BY song_id, sample""")
Q["distinct_ranges"] = (["lyric_segment"], [], "SELECT song_id, start_sample, end_sample, min(turn) AS first_turn FROM lyric_segment GROUP BY song_id, start_sample, end_sample")
Q["capped_history"] = ([], ["orders"], """
    SELECT o_custkey, o_orderkey FROM (
      SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderstatus = 'F') x WHERE r <= n - 4""")
Q["settings_clamp"] = ([], ["supplier"], """
    SELECT s_suppkey, least(5000.0E0, greatest(0.0E0, s_acctbal)) AS clamped, CAST(floor(least(5000.0E0, greatest(0.0E0, s_acctbal)) * 48) AS BIGINT) AS frames, s_acctbal BETWEEN 0 AND 5000 AS in_range FROM supplier""")
Q["melody_keyword"] = ([], ["part"], """
    SELECT p_partkey, lower(p_name) LIKE '%melody%' OR lower(p_name) LIKE '%vocal%' OR lower(p_name) LIKE '%1%' AS named FROM part""")
Q["rate_with_empty"] = ([], ["lineitem"], """
    SELECT l_orderkey, CASE WHEN d > 0 THEN round(n * 1.0E0 / d, 6) WHEN n = 0 THEN 0.0E0 END AS rate FROM (
      SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS d FROM lineitem GROUP BY l_orderkey) x""")
