"""Checks of paths, plans, runtime facts, manifests and provenance; ORACLE holds a second reading of each in another form."""

Q, ORACLE = {}, {}
#: Characters of a reference and of a runtime text, and entries of a version table.
MOST_PATH, MOST_TEXT, MOST_ENTRIES = 1024, 64, 32


def _q(name, needs, tables, sql, oracle):
    Q[name], ORACLE[name] = (needs, tables, sql), oracle


# References to artifacts: relative, normal, of plain characters; the first rule that fails names the outcome
_PATHS = """
    path AS (SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN concat('/', p_name) WHEN 1 THEN concat('jobs//', p_partkey) WHEN 2 THEN concat('jobs/../', p_partkey) WHEN 3 THEN concat('c:', p_partkey) WHEN 4 THEN concat('jobs', chr(92), p_partkey) WHEN 5 THEN concat('a', chr(9), p_partkey)
               WHEN 6 THEN repeat(concat('x', p_partkey, '/'), 200 + p_size) WHEN 7 THEN concat('jobs/', p_partkey, '/') WHEN 8 THEN CASE WHEN p_size % 2 = 0 THEN '' ELSE '.' END ELSE concat('jobs/', p_partkey, '/..a/b.wav') END AS ref FROM part)"""
_q("artifact_paths", [], ["part"], f"""
    WITH {_PATHS} SELECT p_partkey, CASE WHEN length(ref) > {MOST_PATH} THEN 'too_long' WHEN ref RLIKE '[\\\\\\\\:\\\\p{{Cntrl}}]' THEN 'forbidden_character' WHEN exists(split(ref, '/', -1), s -> s IN ('', '.', '..')) THEN 'not_normalized' ELSE 'ok' END AS status FROM path""",
   f"""
    WITH {_PATHS}, s AS (SELECT *, contains('/' || ref || '/', '//') OR contains('/' || ref || '/', '/./') OR contains('/' || ref || '/', '/../') AS odd, length(replace(replace(replace(ref, ':', ''), chr(92), ''), chr(9), '')) < length(ref) AS bad FROM path)
    SELECT p_partkey, 'ok' AS status FROM s WHERE length(ref) <= {MOST_PATH} AND NOT bad AND NOT odd UNION ALL SELECT p_partkey, CASE WHEN length(ref) > {MOST_PATH} THEN 'too_long' WHEN bad THEN 'forbidden_character' ELSE 'not_normalized' END FROM s WHERE length(ref) > {MOST_PATH} OR bad OR odd""")

_LINE = "line AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem)"

# Jobs whose plan has to be exact: no source, a fallback, a song without stages, or a stage that fell back (the first by name)
_JOBS = f"""
    {_LINE}, job AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_totalprice < 30000 THEN 'default_fallback' ELSE 'request' END AS source, o_totalprice > 60000 AS song FROM orders),
    stage AS (SELECT l_orderkey AS id, concat('s', n) AS name, CASE WHEN l_tax = 0.05E0 AND l_quantity > 25 THEN 'default_fallback' ELSE 'selection' END AS source FROM line WHERE l_quantity > 5)"""
_q("plan_exact", [], ["orders", "lineitem"], f"""
    WITH {_JOBS}, s AS (SELECT id, min(CASE WHEN source = 'default_fallback' THEN name END) AS fell, count(*) AS n FROM stage GROUP BY id)
    SELECT job.id, CASE WHEN source IS NULL THEN 'model_plan_missing' WHEN source = 'default_fallback' THEN 'model_plan_fallback' WHEN song AND s.id IS NULL THEN 'model_plan_missing' WHEN song AND fell IS NOT NULL THEN concat('model_plan_fallback:', fell) ELSE 'ok' END AS status FROM job LEFT JOIN s ON s.id = job.id""",
   f"""
    WITH {_JOBS}, fell AS (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY name) AS r FROM stage WHERE source = 'default_fallback'), sound AS (SELECT * FROM job WHERE source IN ('request'))
    SELECT id, 'model_plan_missing' AS status FROM job WHERE source IS NULL UNION ALL SELECT id, 'model_plan_fallback' FROM job WHERE source = 'default_fallback' UNION ALL SELECT id, 'ok' FROM sound WHERE NOT song
    UNION ALL SELECT s.id, CASE WHEN f.id IS NOT NULL THEN 'model_plan_fallback:' || f.name WHEN s.id IN (SELECT id FROM stage) THEN 'ok' ELSE 'model_plan_missing' END FROM sound s LEFT JOIN fell f ON f.id = s.id AND f.r = 1 WHERE song""")

# Runtime facts of a stage, as far as they are well formed: digest, versions (all or none), device
_FACTS = f"""
    fact AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN upper(sha2(p_name, 256)) WHEN p_size % 7 = 0 THEN left(sha2(p_name, 256), 63) WHEN p_size % 11 > 0 THEN sha2(p_name, 256) END AS digest,
               CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN concat('cuda', chr(7)) WHEN 2 THEN NULL WHEN 3 THEN repeat('g', 60 + p_size % 10) ELSE 'cuda:0' END AS device,
               CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN p_size ELSE 1 + p_size % 3 END AS entries, CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 17 = 0 THEN NULL ELSE concat('1.', p_size) END AS version FROM part)"""
_SHORT = "{0} IS NOT NULL AND length({0}) BETWEEN 1 AND " + str(MOST_TEXT)
_q("runtime_record", [], ["part"], f"""
    WITH {_FACTS}, m AS (SELECT *, map_from_entries(transform(CASE WHEN entries = 0 THEN array() ELSE sequence(1, entries) END, i -> struct(concat('k', lpad(i, 3, '0')) AS k, version AS v))) AS versions FROM fact)
    SELECT p_partkey, CASE WHEN digest RLIKE '^[0-9a-f]{{64}}$' THEN digest END AS digest, CASE WHEN device RLIKE '^\\\\P{{Cntrl}}{{1,{MOST_TEXT}}}$' THEN device END AS device,
      CASE WHEN size(versions) BETWEEN 1 AND {MOST_ENTRIES} AND forall(map_entries(versions), e -> length(e.key) BETWEEN 1 AND {MOST_TEXT} AND (e.value IS NULL OR e.value RLIKE '^\\\\P{{Cntrl}}{{1,{MOST_TEXT}}}$')) THEN array_join(transform(array_sort(map_entries(versions)), e -> concat(e.key, '=', coalesce(e.value, 'null'))), ',') END AS versions FROM m""",
   f"""
    WITH {_FACTS.replace("sha2(p_name, 256)", "sha256(p_name)")}
    SELECT p_partkey, CASE WHEN length(digest) = 64 AND lower(digest) = digest THEN digest END AS digest, CASE WHEN {_SHORT.format("device")} AND NOT contains(device, chr(7)) THEN device END AS device,
      CASE WHEN entries > 0 AND entries <= {MOST_ENTRIES} AND version IS DISTINCT FROM '' THEN (SELECT string_agg('k' || lpad(CAST(i AS VARCHAR), 3, '0') || '=' || coalesce(version, 'null'), ',' ORDER BY i) FROM range(1, entries + 1) r(i)) END AS versions FROM fact""")

# Manifests of a runtime: the first fault of the components in their order, then of the models; names and ids once each
_MANIFEST = f"""
    {_LINE}, entry AS (SELECT l_orderkey AS id, n, CASE WHEN n <= 3 THEN 1 ELSE 2 END AS part, CASE WHEN l_partkey % 50 = 0 THEN '  ' ELSE concat('c', l_partkey % 60) END AS name, CASE WHEN l_suppkey = 7 THEN repeat('v', 513) ELSE '1.0' END AS version, CASE WHEN l_tax = 0.07E0 AND l_quantity > 40 THEN 'ABC' ELSE repeat('ab', 32) END AS sha, CASE WHEN l_quantity = 11 THEN 0 ELSE 9 END AS bytes FROM line),
    head AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS version, CASE WHEN o_totalprice < 9000 THEN ' ' ELSE '1.2' END AS app FROM orders)"""
_q("runtime_manifest", [], ["orders", "lineitem"], f"""
    WITH {_MANIFEST}, judged AS (SELECT id, part, n, CASE WHEN trim(name) = '' OR length(name) > 512 THEN 'text' WHEN trim(version) = '' OR length(version) > 512 THEN 'text' WHEN NOT sha RLIKE '^[0-9a-f]{{64}}$' THEN 'sha256' WHEN part = 2 AND bytes = 0 THEN 'zero_size'
        WHEN row_number() OVER (PARTITION BY id, part, name ORDER BY n) > 1 THEN 'duplicate' END AS fault FROM entry),
    first AS (SELECT id, min_by(fault, named_struct('part', part, 'n', n)) AS fault, min(named_struct('part', part, 'n', n)) AS at FROM judged WHERE fault IS NOT NULL GROUP BY id)
    SELECT h.id, CASE WHEN h.version <> 1 THEN 'schema' WHEN trim(app) = '' THEN 'text' ELSE coalesce(fault, 'ok') END AS status, CASE WHEN h.version = 1 AND trim(app) <> '' THEN at.n END AS entry FROM head h LEFT JOIN first f ON f.id = h.id""",
   f"""
    WITH {_MANIFEST}, fault AS (
      SELECT id, part, n, 1 AS k, 'text' AS fault FROM entry WHERE length(trim(name)) = 0 OR length(version) > 512 UNION ALL SELECT id, part, n, 2, 'sha256' FROM entry WHERE sha = 'ABC' UNION ALL SELECT id, part, n, 3, 'zero_size' FROM entry WHERE part = 2 AND bytes = 0
      UNION ALL SELECT DISTINCT b.id, b.part, b.n, 4, 'duplicate' FROM entry a JOIN entry b ON a.id = b.id AND a.part = b.part AND a.name = b.name AND a.n < b.n),
    first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part, n, k) AS r FROM fault) WHERE r = 1)
    SELECT h.id, CASE WHEN h.version = 2 THEN 'schema' WHEN app = ' ' THEN 'text' WHEN f.id IS NULL THEN 'ok' ELSE fault END AS status, CASE WHEN h.version = 1 AND app <> ' ' THEN f.n END AS entry FROM head h LEFT JOIN first f USING (id)""")

# Provenance of a song: its audio has the hashes of its assets, and six stages stand in their order, each with a model of its role
_ROLES = ["stems", "lyrics", "alignment", "pitch", "events", "notes"]
_SPANS = f"""
    {_LINE}, song AS (SELECT o_orderkey AS id, concat('h', o_custkey % 5) AS source, concat('h', o_custkey % 5) AS vocals, CASE WHEN o_totalprice < 20000 THEN NULL ELSE concat('h', CASE WHEN o_orderstatus = 'P' THEN 9 ELSE o_custkey % 5 END) END AS asset FROM orders),
    role AS (SELECT l_orderkey AS id, n, CASE n {" ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_ROLES, 1))} ELSE 'more' END AS own, CASE WHEN l_quantity = 17 THEN 'pitch' END AS swapped, CASE WHEN l_tax = 0.03E0 AND l_quantity > 30 THEN '' ELSE 'm' END AS model FROM line)"""
_q("stage_provenance", [], ["orders", "lineitem"], f"""
    WITH {_SPANS}, s AS (SELECT id, array_sort(collect_list(named_struct('n', n, 'role', coalesce(swapped, own)))) AS roles, min(length(model)) AS least FROM role GROUP BY id)
    SELECT song.id, CASE WHEN asset IS NULL THEN 'audio_missing' WHEN NOT (asset = source AND asset = vocals) THEN 'audio_mismatch' WHEN s.id IS NULL OR size(roles) <> 6 THEN 'incomplete' WHEN transform(roles, x -> x.role) <> array({", ".join(f"'{r}'" for r in _ROLES)}) OR least = 0 THEN 'inconsistent' ELSE 'ok' END AS status FROM song LEFT JOIN s ON s.id = song.id""",
   f"""
    WITH {_SPANS}, want(n, own) AS (VALUES {", ".join(f"({i}, '{r}')" for i, r in enumerate(_ROLES, 1))}), c AS (SELECT id, count(*) AS n FROM role GROUP BY id), g AS (SELECT id, count(*) AS good FROM role r JOIN want w ON w.n = r.n AND w.own = coalesce(r.swapped, r.own) WHERE model <> '' GROUP BY id)
    SELECT song.id, CASE WHEN asset IS NULL THEN 'audio_missing' WHEN asset IS DISTINCT FROM source OR asset <> vocals THEN 'audio_mismatch' WHEN coalesce(n, 0) <> 6 THEN 'incomplete' WHEN coalesce(good, 0) < 6 THEN 'inconsistent' ELSE 'ok' END AS status FROM song LEFT JOIN c USING (id) LEFT JOIN g USING (id)""")

# The region of a frame: of regions that hold it, the first in the order in which they were given
_REGIONS = "region AS (SELECT song_id, turn AS n, start_sample AS a, end_sample AS b, role FROM lyric_segment), place AS (SELECT song_id, idx, idx * 480 + 240 AS at FROM pitch_frame)"
_q("region_lookup", ["lyric_segment", "pitch_frame"], [], f"""
    WITH {_REGIONS}, cells AS (SELECT *, explode(sequence(a div 96000, greatest(a, b - 1) div 96000)) AS cell FROM region),
    hit AS (SELECT p.song_id, p.idx, min(r.n) AS n FROM place p JOIN cells r ON r.song_id = p.song_id AND r.cell = p.at div 96000 WHERE r.a <= p.at AND p.at < r.b GROUP BY p.song_id, p.idx)
    SELECT p.song_id, p.idx, n AS region FROM place p LEFT JOIN hit h ON h.song_id = p.song_id AND h.idx = p.idx""",
   f"""
    WITH {_REGIONS} SELECT song_id, idx, (SELECT r.n FROM region r WHERE r.song_id = p.song_id AND p.at >= r.a AND p.at < r.b ORDER BY r.n LIMIT 1) AS region FROM place p""")

# Assets of a published job: owned, one destination each whatever the case, digests and sizes, the total, one description of a source; the first asset with a fault and its first fault
_ASSETS = f"""
    {_LINE}, asset AS (SELECT l_orderkey AS id, n, CASE WHEN l_quantity = 19 THEN concat('jobs/other/', n) ELSE concat('jobs/', l_orderkey, '/', l_partkey % 9) END AS source, CASE WHEN l_partkey % 3 = 0 THEN concat('Audio/', l_partkey % 5) ELSE concat('audio/', l_partkey % 30) END AS dest,
                 CASE WHEN l_tax = 0.06E0 AND l_quantity > 44 THEN 'short' ELSE repeat(CAST(l_partkey % 2 AS STRING), 64) END AS sha, CAST(l_extendedprice AS BIGINT) AS bytes FROM line)"""
#: Bytes of one asset and of all assets of a job.
_EACH, _ALL = 95000, 250000
# The SQL's engine rounds bytes to the nearest whole number, halves to even, where this one would cut them off
_WHOLE = _ASSETS.replace("CAST(l_extendedprice AS BIGINT)", "CAST(rint(l_extendedprice) AS BIGINT)")
_q("asset_checks", [], ["lineitem"], f"""
    WITH {_WHOLE}, seen AS (SELECT *, row_number() OVER (PARTITION BY id, lower(dest) ORDER BY n) AS again, sum(bytes) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total,
        first_value(concat(sha, bytes)) OVER (PARTITION BY id, source ORDER BY n) AS described FROM asset),
    fault AS (SELECT id, n, CASE WHEN NOT startswith(source, concat('jobs/', id, '/')) THEN 'not_owned' WHEN again > 1 THEN 'destination_twice' WHEN NOT sha RLIKE '^[0-9a-f]{{64}}$' OR bytes > {_EACH} THEN 'digest_or_size' WHEN total > {_ALL} THEN 'too_large' WHEN described <> concat(sha, bytes) THEN 'inconsistent' END AS fault FROM seen)
    SELECT id, coalesce(min_by(fault, CASE WHEN fault IS NOT NULL THEN n END), 'ok') AS status, min(CASE WHEN fault IS NOT NULL THEN n END) AS asset FROM fault GROUP BY id""",
   f"""
    WITH {_ASSETS.replace("AS STRING", "AS VARCHAR")}, fault AS (
      SELECT id, n, 1 AS k, 'not_owned' AS fault FROM asset WHERE split_part(source, '/', 2) <> CAST(id AS VARCHAR) UNION ALL SELECT DISTINCT b.id, b.n, 2, 'destination_twice' FROM asset a JOIN asset b ON a.id = b.id AND a.n < b.n AND lower(a.dest) = lower(b.dest)
      UNION ALL SELECT id, n, 3, 'digest_or_size' FROM asset WHERE length(sha) <> 64 OR bytes > {_EACH} UNION ALL SELECT b.id, b.n, 4, 'too_large' FROM asset a JOIN asset b ON a.id = b.id AND a.n <= b.n GROUP BY b.id, b.n HAVING sum(a.bytes) > {_ALL}
      UNION ALL SELECT b.id, b.n, 5, 'inconsistent' FROM asset b JOIN (SELECT id, source, arg_min(sha, n) AS sha, arg_min(bytes, n) AS bytes FROM asset GROUP BY id, source) a ON a.id = b.id AND a.source = b.source WHERE a.sha <> b.sha OR a.bytes <> b.bytes),
    first AS (SELECT id, arg_min(fault, (n, k)) AS fault, min(n) AS n FROM fault GROUP BY id)
    SELECT i.id, coalesce(fault, 'ok') AS status, f.n AS asset FROM (SELECT DISTINCT id FROM asset) i LEFT JOIN first f USING (id)""")
