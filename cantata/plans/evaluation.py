"""Evaluation, gates and ledgers: error rates, verdicts, thresholds and regressions."""

Q = {}

_PAIRS = "(SELECT p_brand AS stratum, lower(p_type) AS ref, lower(p_name) AS hyp FROM part)"
Q["cer_wer"] = ([], ["part"], f"""
    SELECT stratum, sum(levenshtein(ref, hyp)) AS errors, sum(length(ref)) AS chars, CASE WHEN sum(length(ref)) > 0 THEN round(sum(levenshtein(ref, hyp)) * 1.0E0 / sum(length(ref)), 6) END AS cer,
           sum(CASE WHEN ref = hyp THEN 1 ELSE 0 END) AS same FROM {_PAIRS} p GROUP BY stratum""")
Q["empty_reference"] = ([], ["part"], "SELECT p_brand, sum(CASE WHEN p_size % 5 = 0 THEN length(p_name) ELSE 0 END) AS inserted FROM part GROUP BY p_brand")
Q["key_set_equality"] = ([], ["customer", "supplier"], """
    SELECT coalesce(c.k, s.k) AS nation, CASE WHEN c.k IS NULL THEN 'only_right' WHEN s.k IS NULL THEN 'only_left' ELSE 'both' END AS side
    FROM (SELECT DISTINCT c_nationkey AS k FROM customer) c FULL OUTER JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) s ON c.k = s.k""")
Q["release_verdict"] = ([], ["nation", "supplier"], """
    SELECT n_regionkey AS release, CASE WHEN min(CASE WHEN status = 'pass' THEN 1 ELSE 0 END) = 1 THEN 'pass' WHEN max(CASE WHEN status = 'fail' THEN 1 ELSE 0 END) = 1 THEN 'fail' ELSE 'unverified' END AS verdict,
           sum(CASE WHEN status = 'unverified' THEN 1 ELSE 0 END) AS missing FROM (
      SELECT n.n_regionkey, coalesce(r.status, 'unverified') AS status FROM nation n LEFT JOIN (SELECT s_nationkey, CASE WHEN min(s_acctbal) < 0 THEN 'fail' ELSE 'pass' END AS status FROM supplier GROUP BY s_nationkey) r ON n.n_nationkey = r.s_nationkey) x GROUP BY n_regionkey""")
# Counts, not rates, so the comparison stays exact: e1 / n1 - e0 / n0 <= 1 / 50
Q["cer_regression"] = ([], ["lineitem"], """
    SELECT l_suppkey, (e1 * n0 - e0 * n1) * 50 <= n0 * n1 AS within FROM (
      SELECT l_suppkey, sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END) AS n0, sum(CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 0 END) AS n1,
             sum(CASE WHEN l_linenumber % 2 = 0 AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS e0, sum(CASE WHEN l_linenumber % 2 = 1 AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS e1 FROM lineitem GROUP BY l_suppkey) x WHERE n0 > 0 AND n1 > 0""")
Q["detector_support"] = (["pitch_frame"], [], """
    SELECT song_id, round(CASE WHEN sum(confidence * r) > 1E-12 THEN sum(confidence * r * voiced_probability) / sum(confidence * r) ELSE 0.0E0 END, 6) AS probability
    FROM (SELECT song_id, confidence, coalesce(voiced_probability, 0.0E0) AS voiced_probability, CASE WHEN event_type = 'click' THEN 0.9E0 ELSE 0.7E0 END AS r FROM pitch_frame) x GROUP BY song_id""")
Q["playability"] = (["note"], [], """
    SELECT song_id, CASE WHEN max(CASE WHEN flag = 'blocking' THEN 1 ELSE 0 END) = 1 THEN 'blocked' WHEN count(flag) > 0 THEN 'warning' ELSE 'playable' END AS status, count(DISTINCT flag) AS codes
    FROM (SELECT song_id, CASE WHEN confidence < 0.92 AND midi_note > 90 THEN 'blocking' WHEN confidence < 0.92 THEN 'low_confidence' WHEN midi_note > 90 THEN 'range' END AS flag FROM note) x GROUP BY song_id""")
Q["all_violations"] = (["note"], [], """
    SELECT song_id, seq, 'confidence' AS code FROM note WHERE confidence < 0.95 UNION ALL SELECT song_id, seq, 'range' AS code FROM note WHERE midi_note > 90 UNION ALL SELECT song_id, seq, 'empty' AS code FROM note WHERE end_sample <= start_sample""")
Q["pitch_class_histogram"] = (["note"], [], "SELECT song_id, midi_note % 12 AS pitch_class, round(sum((end_sample - start_sample) * confidence), 4) AS weight FROM note GROUP BY song_id, midi_note % 12")
