"""Selections, validations and flags; ORACLE holds a second reading of each query in another form."""

Q, ORACLE = {}, {}

#: Words that name a melody track, and the drum channel.
MELODY_WORDS, DRUMS = ("melody", "vocal", "voice", "lead", "メロ", "ボーカル", "歌"), 9
#: Thresholds of the quality flags.
REPEAT, HALLUCINATION, COVERAGE, OVERLAP = 0.5, 0.8, 0.6, 0


def _q(name, needs, tables, sql, oracle):
    Q[name], ORACLE[name] = (needs, tables, sql), oracle


# Melody track and channel of a file: drums out, what was asked for, the only one, the only one with a melody's name
_UNITS = f"""
    played AS (SELECT l_orderkey AS song_id, l_partkey % 3 AS track, CASE WHEN l_suppkey % 4 = 0 THEN {DRUMS} ELSE l_suppkey % 2 END AS channel,
                 CASE (l_orderkey + l_partkey % 3) % 4 WHEN 0 THEN 'Lead Vocal' WHEN 1 THEN 'MELODY' WHEN 2 THEN 'Bass' END AS name,
                 CASE WHEN l_orderkey % 5 = 0 THEN l_orderkey % 3 END AS asked FROM lineitem)"""
_NAMED = " OR ".join(f"lower(name) LIKE '%{w}%'" for w in MELODY_WORDS)
_q("melody_selection", [], ["lineitem"], f"""
    WITH {_UNITS} SELECT song_id, CASE WHEN n = 1 THEN a.track WHEN k = 1 THEN b.track END AS track, CASE WHEN n = 1 THEN a.channel WHEN k = 1 THEN b.channel END AS channel,
        CASE WHEN pitched = 0 THEN 'midi_no_notes' WHEN n = 0 THEN 'midi_track_not_found' WHEN n = 1 AND asked IS NOT NULL THEN 'explicit' WHEN n = 1 THEN 'single-candidate' WHEN k = 1 THEN 'melody-track-name' ELSE 'midi_track_ambiguous' END AS reason FROM (
      SELECT song_id, max(asked) AS asked, count(CASE WHEN channel <> {DRUMS} THEN 1 END) AS pitched, count(CASE WHEN fits THEN 1 END) AS n, count(CASE WHEN fits AND named THEN 1 END) AS k,
             min(CASE WHEN fits THEN struct(track, channel) END) AS a, min(CASE WHEN fits AND named THEN struct(track, channel) END) AS b FROM (
        SELECT song_id, track, channel, max(asked) AS asked, max({_NAMED}) AS named, max(channel <> {DRUMS} AND (asked IS NULL OR asked = track)) AS fits FROM played GROUP BY song_id, track, channel) u GROUP BY song_id) x""",
   f"""
    WITH {_UNITS}, u AS (SELECT DISTINCT * FROM played WHERE channel <> {DRUMS}), f AS (SELECT * FROM u WHERE coalesce(asked = track, true)),
    m AS (SELECT * FROM f WHERE regexp_matches(lower(name), '{"|".join(MELODY_WORDS)}')),
    one AS (SELECT song_id, track, channel, CASE WHEN asked IS NULL THEN 'single-candidate' ELSE 'explicit' END AS reason FROM f QUALIFY count(*) OVER (PARTITION BY song_id) = 1),
    two AS (SELECT song_id, track, channel, 'melody-track-name' AS reason FROM m WHERE song_id NOT IN (SELECT song_id FROM one) QUALIFY count(*) OVER (PARTITION BY song_id) = 1),
    got AS (SELECT * FROM one UNION ALL SELECT * FROM two), s AS (SELECT DISTINCT song_id FROM played)
    SELECT song_id, track, channel, coalesce(reason, CASE WHEN song_id NOT IN (SELECT song_id FROM u) THEN 'midi_no_notes' WHEN song_id NOT IN (SELECT song_id FROM f) THEN 'midi_track_not_found' ELSE 'midi_track_ambiguous' END) AS reason FROM s LEFT JOIN got USING (song_id)""")

# Words of a line: characters between white space; a word is timed where all its characters are
_SCORE = "(p * 31 + turn * 7) % 100 / 100.0E0"
_q("word_units", [], ["conversations"], f"""
    WITH chars AS (SELECT conv_id, turn, p, c, {_SCORE} AS score FROM conversations LATERAL VIEW posexplode(split(text, '')) AS p, c WHERE text <> ''),
    marked AS (SELECT *, c RLIKE '[ \\\\t\\\\n\\\\r\\\\f]' AS gap, lag(c RLIKE '[ \\\\t\\\\n\\\\r\\\\f]', 1, true) OVER (PARTITION BY conv_id, turn ORDER BY p) AS after_gap FROM chars),
    words AS (SELECT *, sum(CASE WHEN after_gap AND NOT gap THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS unit FROM marked)
    SELECT conv_id, turn, unit, min(p) AS char_start, max(p) + 1 AS char_end, CASE WHEN min(score) >= 0.1 THEN 'aligned' ELSE 'unaligned' END AS status,
           CASE WHEN min(score) >= 0.1 THEN min(p) * 240 END AS start_sample, CASE WHEN min(score) >= 0.1 THEN (max(p) + 1) * 240 END AS end_sample, CASE WHEN min(score) >= 0.1 THEN min(score) END AS score
    FROM words WHERE NOT gap GROUP BY conv_id, turn, unit""",
   f"""
    WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '[^ \\t\\n\\r\\f]+') AS ws, regexp_split_to_array(text, '[^ \\t\\n\\r\\f]+') AS gs FROM conversations),
    u AS (SELECT conv_id, turn, unnest(range(1, len(ws) + 1)) AS unit, ws, gs FROM w),
    b AS (SELECT conv_id, turn, unit, CAST(list_sum(list_transform(gs[1:unit], lambda x: length(x))) + coalesce(list_sum(list_transform(ws[1:unit - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(ws[unit]) AS n FROM u),
    s AS (SELECT *, list_min(list_transform(range(a, a + n), lambda p: (p * 31 + turn * 7) % 100)) / 100 AS m FROM b)
    SELECT conv_id, turn, unit, a AS char_start, a + n AS char_end, CASE WHEN m >= 0.1 THEN 'aligned' ELSE 'unaligned' END AS status, CASE WHEN m >= 0.1 THEN a * 240 END AS start_sample, CASE WHEN m >= 0.1 THEN (a + n) * 240 END AS end_sample, CASE WHEN m >= 0.1 THEN m END AS score FROM s""")

# What an edited artifact makes invalid, by each song's own edges
_EDGES = """
    edge AS (SELECT o_orderkey AS song_id, kind, needs FROM orders CROSS JOIN (
        SELECT 'events' AS kind, 'pitch' AS needs, 2 AS every UNION ALL SELECT 'notes', 'pitch', 1 UNION ALL SELECT 'notes', 'events', 3 UNION ALL SELECT 'lyrics', 'stems', 1 UNION ALL SELECT 'alignment', 'lyrics', 2
        UNION ALL SELECT 'notes', 'alignment', 3 UNION ALL SELECT 'evidence', 'notes', 1 UNION ALL SELECT 'pitch', 'stems', 2) k WHERE o_orderkey % every = 0),
    root AS (SELECT o_orderkey AS song_id, CASE o_orderkey % 5 WHEN 0 THEN 'stems' WHEN 1 THEN 'pitch' WHEN 2 THEN 'lyrics' WHEN 3 THEN 'alignment' ELSE 'notes' END AS kind FROM orders)"""
_q("invalidation_closure", [], ["orders"], f"""
    WITH {_EDGES}, graph AS (SELECT song_id, collect_list(struct(kind, needs)) AS edges FROM edge GROUP BY song_id)
    SELECT song_id, explode(aggregate(edges, array(root.kind), (found, x) -> array_union(found, transform(filter(edges, e -> array_contains(found, e.needs)), e -> e.kind)))) AS kind
    FROM root JOIN graph USING (song_id)""",
   f"""
    WITH RECURSIVE {_EDGES}, reached AS (SELECT song_id, kind FROM root UNION SELECT e.song_id, e.kind FROM reached r JOIN edge e ON e.song_id = r.song_id AND e.needs = r.kind) SELECT song_id, kind FROM reached""")

# Imported candidates: a missing id is numbered, bad fields are named
_OUTER = """
    given AS (SELECT song_id, seq, CASE WHEN seq % 2 = 0 THEN concat('n', CAST(seq AS VARCHAR(9))) END AS id, start_sample - 9600 * (seq % 3 - 1) AS start_sample, end_sample, midi_note + 40 AS midi_note, confidence * 1.04 AS confidence FROM note)"""
_q("external_candidates", ["note"], [], f"""
    WITH {_OUTER} SELECT song_id, seq, coalesce(id, concat('external-', lpad(CAST(seq AS STRING), 4, '0'))) AS id,
      concat_ws(',', CASE WHEN NOT (start_sample >= 0 AND start_sample < end_sample AND end_sample <= 96000) THEN 'span' END, CASE WHEN midi_note NOT BETWEEN 0 AND 127 THEN 'midi_note' END, CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence' END) AS bad FROM given""",
   f"""
    WITH {_OUTER} SELECT song_id, seq, CASE WHEN id IS NULL THEN 'external-' || right('000' || seq, 4) ELSE id END AS id,
      array_to_string(list_filter([CASE WHEN least(start_sample, end_sample - start_sample - 1, 96000 - end_sample) < 0 THEN 'span' END, CASE WHEN abs(midi_note - 63.5) > 63.5 THEN 'midi_note' END, CASE WHEN abs(confidence - 0.5) > 0.5 THEN 'confidence' END], lambda x: x IS NOT NULL), ',') AS bad FROM given""")

# Signals over their thresholds, and failed checks, in one order
_SIGNALS = """
    signal AS (SELECT song_id, turn, start_sample, end_sample, turn * 37 % 100 / 100.0E0 AS repeated, turn * 53 % 100 / 100.0E0 AS doubt, turn * 71 % 100 / 100.0E0 AS covered, turn % 3 AS overlap, role = 'user' AS passed FROM lyric_segment)"""
_q("quality_flags", ["lyric_segment"], [], f"""
    WITH {_SIGNALS} SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY start_sample, end_sample, stage, code, turn) AS place, turn, f.stage AS stage, f.code AS code, f.severity AS severity, f.value AS value FROM (
      SELECT *, f.stage AS stage, f.code AS code FROM signal LATERAL VIEW explode(filter(array(
        CASE WHEN repeated >= {REPEAT} THEN named_struct('code', 'whisper_repeat', 'stage', 'lyrics', 'severity', repeated, 'value', repeated) END,
        CASE WHEN doubt >= {HALLUCINATION} THEN named_struct('code', 'whisper_hallucination', 'stage', 'lyrics', 'severity', doubt, 'value', doubt) END,
        CASE WHEN covered < {COVERAGE} THEN named_struct('code', 'alignment_low_coverage', 'stage', 'alignment', 'severity', round(1 - covered, 6), 'value', covered) END,
        CASE WHEN overlap > {OVERLAP} THEN named_struct('code', 'boundary_inconsistent', 'stage', 'notes', 'severity', CAST(NULL AS DOUBLE), 'value', CAST(overlap AS DOUBLE)) END,
        CASE WHEN NOT passed THEN named_struct('code', 'integrity_failed', 'stage', 'job', 'severity', CAST(NULL AS DOUBLE), 'value', CAST(NULL AS DOUBLE)) END), x -> x IS NOT NULL)) e AS f) y""",
   f"""
    WITH {_SIGNALS}, u AS (
      SELECT signal.*, 'whisper_repeat' AS code, 'lyrics' AS stage, repeated AS severity, repeated AS value FROM signal WHERE NOT repeated < {REPEAT}
      UNION ALL SELECT signal.*, 'whisper_hallucination', 'lyrics', doubt, doubt FROM signal WHERE NOT doubt < {HALLUCINATION}
      UNION ALL SELECT signal.*, 'alignment_low_coverage', 'alignment', round(1 - covered, 6), covered FROM signal WHERE NOT covered >= {COVERAGE}
      UNION ALL SELECT signal.*, 'boundary_inconsistent', 'notes', NULL, overlap FROM signal WHERE NOT overlap <= {OVERLAP}
      UNION ALL SELECT signal.*, 'integrity_failed', 'job', NULL, NULL FROM signal WHERE role_is(passed))
    SELECT song_id, rank() OVER (PARTITION BY song_id ORDER BY start_sample, end_sample, stage, code, turn) AS place, turn, stage, code, severity, value FROM u""".replace("role_is(passed)", "passed = false"))

# Lines of a text that are not blank, by their number among all
_q("numbered_lines", [], ["documents"], r"""
    SELECT doc_id, p + 1 AS line_number, concat('reference-', lpad(CAST(p + 1 AS STRING), 6, '0')) AS id, length(line) AS n FROM documents
    LATERAL VIEW posexplode(split(text, '\\r\\n|[\\n\\r\\u000B\\u000C\\u001C-\\u001E\\u0085\\u2028\\u2029]')) AS p, line WHERE line RLIKE '[^\\s\\u00A0\\u0085\\u001C-\\u001F\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\u1680]'""",
   r"""
    SELECT doc_id, i AS line_number, printf('reference-%06d', i) AS id, length(ls[i]) AS n FROM (
      SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]', chr(10), 'g'), chr(10)) AS ls FROM documents) a) b WHERE trim(ls[i], ' ' || chr(9) || chr(160) || chr(31) || chr(12288)) <> ''""")

# Versions part by part as numbers; a missing part is older
_VERSIONS = "v AS (SELECT p_partkey, concat(p_size % 4, '.', p_partkey % 12, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('.', p_partkey % 10) END) AS installed FROM part)"
_q("minimum_version", [], ["part"], f"""
    WITH {_VERSIONS} SELECT p_partkey, installed, transform(split(installed, '[.]'), x -> CAST(x AS INT)) >= array(2, 9, 1) AS enough FROM v""",
   f"""
    WITH {_VERSIONS}, s AS (SELECT *, string_split(installed, '.') AS x FROM v) SELECT p_partkey, installed, CAST(x[1] AS INT) > 2 OR CAST(x[1] AS INT) = 2 AND (CAST(x[2] AS INT) > 9 OR CAST(x[2] AS INT) = 9 AND coalesce(CAST(x[3] AS INT), 0) >= 1 AND len(x) = 3) AS enough FROM s""")

# Artifacts two jobs share, and which one lacks; equal, subset or neither
_q("artifact_sets", [], ["orders", "lineitem"], """
    SELECT song_id, concat_ws(',', array_sort(array_except(a, b))) AS missing, concat_ws(',', array_sort(array_except(b, a))) AS extra,
           CASE WHEN size(array_except(a, b)) = 0 AND size(array_except(b, a)) = 0 THEN 'equal' WHEN size(array_except(b, a)) = 0 THEN 'subset' ELSE 'other' END AS verdict FROM (
      SELECT l_orderkey AS song_id, collect_set(concat('m', CAST(l_partkey % 5 AS VARCHAR(9)))) AS a, collect_set(CASE WHEN l_linenumber % 4 <> 3 THEN CASE WHEN l_suppkey % 6 = 0 THEN 'NONE' ELSE concat('m', CAST(l_partkey % 5 AS VARCHAR(9))) END END) AS b FROM lineitem GROUP BY l_orderkey) x""",
   """
    WITH a AS (SELECT DISTINCT l_orderkey AS s, concat('m', CAST(l_partkey % 5 AS VARCHAR(9))) AS m FROM lineitem), b AS (SELECT DISTINCT l_orderkey AS s, CASE WHEN l_suppkey % 6 = 0 THEN 'NONE' ELSE concat('m', CAST(l_partkey % 5 AS VARCHAR(9))) END AS m FROM lineitem WHERE l_linenumber % 4 <> 3),
    d AS (SELECT s, coalesce(string_agg(m, ',' ORDER BY m) FILTER (side = 1), '') AS missing, coalesce(string_agg(m, ',' ORDER BY m) FILTER (side = 2), '') AS extra FROM (
      SELECT *, 1 AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 2 FROM (FROM b EXCEPT FROM a)) GROUP BY s)
    SELECT song_id, coalesce(missing, '') AS missing, coalesce(extra, '') AS extra, CASE WHEN coalesce(missing, '') = '' AND coalesce(extra, '') = '' THEN 'equal' WHEN coalesce(extra, '') = '' THEN 'subset' ELSE 'other' END AS verdict
    FROM (SELECT DISTINCT l_orderkey AS song_id FROM lineitem) o LEFT JOIN d ON d.s = o.song_id""")
