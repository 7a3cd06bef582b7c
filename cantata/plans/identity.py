"""Fingerprints of ordered sets, plans that take up runtime facts, and the added lines of diffs."""
from pyspark.sql import DataFrame, Window, functions as F

from cantata.sources import importers

QUERIES, ORACLE = {}, {}
#: What a reference fingerprint begins with, so that it is none of anything else.
DOMAIN = "lyric-reference-v1\n"


def _query(f):
    QUERIES[f.__name__] = f
    return f


def quoted(c):
    """A string as JSON; null as null."""
    return F.coalesce(F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", "$1"), F.lit("null"))


def canonical_map(m):
    """A map of strings as JSON with its keys in order."""
    entries = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(quoted(e["key"]), F.lit(":"), quoted(e["value"])))
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))


def reference_fingerprint(rows: DataFrame, key: str, id_col: str, text: str) -> DataFrame:
    """(key, texts, sha256): a digest of the (id, text) pairs of a key in order of id and text, however the rows lie; null texts are null in it."""
    pair = F.struct(F.col(id_col).cast("string").alias("i"), F.col(text).alias("t"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(pair)).alias("p")).select(
        key, F.size("p").cast("long").alias("texts"),
        F.sha2(F.concat(F.lit(DOMAIN + "["), F.array_join(F.transform("p", lambda p: F.concat(F.lit("["), quoted(p["i"]), F.lit(","), quoted(p["t"]), F.lit("]"))), ","), F.lit("]")), 256).alias("sha256"),
    )


def stage_fingerprint(stages: DataFrame, key: str, order: str, source: str) -> DataFrame:
    """(key, fingerprint) of the stages (model, options) of a key in order: options that name artifacts of this run, and the order of their keys, do not count."""
    kept = F.map_filter("options", lambda k, _: ~k.endswith("_artifact"))
    one = F.concat(F.lit('{"model":'), quoted(F.col("model")), F.lit(',"options":'), canonical_map(kept), F.lit("}"))
    rows = stages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("j")))).alias("s"), F.max(source).alias("source"))
    text = F.concat(F.lit('{"pipeline_version":1,"source":'), quoted(F.col("source")), F.lit(',"stages":['), F.array_join(F.transform("s", lambda x: x["j"]), ","), F.lit("]}"))
    return rows.select(key, F.sha2(text, 256).alias("fingerprint"))


def merge_runtime(plan, report):
    """A plan (map of stage to map of facts) with the facts of a report: only for stages of the plan, only facts that are there, none that the plan holds already, be it as null."""
    none = F.create_map().cast("map<string,string>")
    new = lambda held, told: F.map_filter(told, lambda k, v: v.isNotNull() & ~F.array_contains(F.map_keys(held), k))
    full = F.map_zip_with(plan, F.coalesce(report, F.create_map().cast("map<string,map<string,string>>")), lambda s, held, told: F.when(held.isNotNull(), F.map_concat(held, new(held, F.coalesce(told, none)))))
    return F.map_filter(full, lambda s, e: e.isNotNull())


def added_lines(diffs: DataFrame, key: str, col: str = "diff") -> DataFrame:
    """(key, path, line), each once, of the lines that unified diffs add, as numbered in the file after the change.

    The state that a reader of the lines would carry is read off windows: the
    file is that of the last file header, the number that of the last hunk
    header and of the lines since that the new file has.
    """
    rows = diffs.select(key, F.posexplode(F.split(col, r"\r\n|[\n\r]")).alias("pos", "t"))
    kind = (
        F.when(F.col("t").startswith("diff --git "), "reset").when(F.col("t").startswith("+++ b/"), "file").when(F.col("t").startswith("+++ /dev/null"), "reset").when(F.col("t").startswith("@@ "), "hunk")
        .when(F.col("t").startswith("+"), "add").when(F.col("t").startswith(" "), "keep")
    )
    rows = rows.withColumn("kind", kind).where("kind is not null")
    so_far = Window.partitionBy(key).orderBy("pos")
    number = F.regexp_extract("t", r"\+(\d+)(?:,\d+)?\s+@@", 1)
    rows = rows.withColumns({
        "file": F.last(F.when(F.col("kind").isin("reset", "file"), F.struct(F.when(F.col("kind") == "file", F.substring("t", 7, 1 << 30)).alias("path"))), True).over(so_far),
        "hunk": F.last(F.when(F.col("kind").isin("reset", "hunk"), F.struct("pos", F.when((F.col("kind") == "hunk") & (number != ""), number.cast("long")).alias("start"))), True).over(so_far),
    })
    held = rows.where("kind in ('add', 'keep') and file.path is not null and hunk.start is not null")
    before = F.row_number().over(Window.partitionBy(key, "hunk.pos").orderBy("pos")) - 1
    return held.withColumn("line", F.col("hunk.start") + before).where("kind = 'add'").select(key, F.col("file.path").alias("path"), "line").distinct()


def bound(summary):
    """The digest of a summary (map of strings) that its detail carries; the summary's own record of the detail does not count."""
    return F.sha2(canonical_map(F.map_filter(summary, lambda k, _: k != "detail_sha256")), 256)


def binding_status(summary, detail):
    """Whether a summary and the text of its detail were written by one run: `no_hash`, `detail_differs`, `summary_differs` or `ok`. A detail of before bindings is held by its own digest alone."""
    told, binding = F.element_at(summary, "detail_sha256"), F.get_json_object(detail, "$.summary_binding_sha256")
    return (
        F.when(~F.coalesce(told.rlike("^[0-9a-f]{64}$"), F.lit(False)), "no_hash").when(~F.coalesce(F.sha2(detail, 256) == told, F.lit(False)), "detail_differs")
        .when(binding.isNotNull() & (binding != bound(summary)), "summary_differs").otherwise("ok")
    )


_LINES = """(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS stage FROM lineitem)"""


def _lines(spark, d):
    return spark.sql(f"SELECT * FROM {_LINES} l".replace("FROM lineitem", f"FROM parquet.`{d}/lineitem.parquet`"))


@_query
def reference_hash(spark, d):
    return reference_fingerprint(spark.read.parquet(f"{d}/conversations.parquet"), "conv_id", "turn", "text")


ORACLE["reference_hash"] = """
    SELECT conv_id, count(*) AS texts, sha256('lyric-reference-v1' || chr(10) || CAST(to_json(list([CAST(turn AS VARCHAR), text] ORDER BY CAST(turn AS VARCHAR), text)) AS VARCHAR)) AS sha256
    FROM conversations GROUP BY conv_id"""


@_query
def analysis_fingerprint(spark, d):
    """Orders as songs and lines as stages, their options in an order that the data give."""
    names = F.array(F.lit("speed"), F.lit("input_artifact"), F.lit("rate"), F.lit("mode"))
    values = F.array(F.col("l_quantity").cast("int").cast("string"), F.concat(F.lit("run/"), F.col("l_partkey").cast("string")), F.when(F.col("l_tax") > 0.02, F.round(F.col("l_discount") * 100).cast("int").cast("string")), F.col("l_returnflag"))
    turned = F.col("l_partkey") % 2 == 0
    options = F.map_from_arrays(F.when(turned, F.reverse(names)).otherwise(names), F.when(turned, F.reverse(values)).otherwise(values))
    stages = _lines(spark, d).select("l_orderkey", "stage", F.concat(F.lit('model "'), F.col("l_linestatus"), F.lit('"')).alias("model"), options.alias("options"), F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("source"))
    return stage_fingerprint(stages, "l_orderkey", "stage", "source")


ORACLE["analysis_fingerprint"] = f"""
    SELECT l_orderkey, sha256('{{"pipeline_version":1,"source":"order-' || l_orderkey || '","stages":[' || string_agg(CAST(json_object('model', 'model "' || l_linestatus || '"', 'options',
        json_object('mode', l_returnflag, 'rate', CASE WHEN l_tax > 0.02 THEN CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR) END, 'speed', CAST(CAST(floor(l_quantity) AS INT) AS VARCHAR))) AS VARCHAR), ',' ORDER BY stage) || ']}}') AS fingerprint
    FROM {_LINES} GROUP BY l_orderkey"""


@_query
def plan_runtime(spark, d):
    """Orders as jobs and lines as stages: what the plan holds, and what the runtime reports of some stages and of one that is not planned."""
    s = _lines(spark, d).select(
        "l_orderkey", F.concat(F.lit("s"), F.col("stage").cast("string")).alias("stage"),
        F.map_from_arrays(F.when(F.col("l_linestatus") == "F", F.array(F.lit("source"), F.lit("selected"), F.lit("device"))).otherwise(F.array(F.lit("source"), F.lit("selected"))),
                          F.when(F.col("l_linestatus") == "F", F.array("l_returnflag", F.lit(None).cast("string"), F.lit("pinned"))).otherwise(F.array(F.col("l_returnflag"), F.lit(None).cast("string")))).alias("held"),
        F.map_from_arrays(F.array(F.lit("device"), F.lit("selected"), F.lit("weights")), F.array(F.when(F.col("l_tax") > 0.02, "gpu"), F.lit("late"), F.col("l_partkey").cast("string"))).alias("told"), "l_quantity")
    g = s.groupBy("l_orderkey").agg(
        F.map_from_entries(F.collect_list(F.struct("stage", "held"))).alias("plan"),
        F.map_concat(F.map_from_entries(F.collect_list(F.when(F.col("l_quantity") > 10, F.struct("stage", "told")))), F.create_map(F.lit("other"), F.create_map(F.lit("device"), F.lit("gpu")))).alias("report"))
    rows = g.select("l_orderkey", F.explode(merge_runtime(F.col("plan"), F.col("report"))).alias("stage", "facts"))
    return rows.select("l_orderkey", "stage", F.explode("facts").alias("fact", "value"))


ORACLE["plan_runtime"] = f"""
    WITH l AS (SELECT l_orderkey, 's' || stage AS stage, l_linestatus, l_returnflag, l_tax, l_partkey, l_quantity FROM {_LINES}),
    held AS (SELECT l_orderkey, stage, 'source' AS fact, l_returnflag AS value FROM l UNION ALL SELECT l_orderkey, stage, 'selected', NULL FROM l UNION ALL SELECT l_orderkey, stage, 'device', 'pinned' FROM l WHERE l_linestatus = 'F'),
    told AS (SELECT l_orderkey, stage, 'device' AS fact, 'gpu' AS value FROM l WHERE l_quantity > 10 AND l_tax > 0.02 UNION ALL SELECT l_orderkey, stage, 'selected', 'late' FROM l WHERE l_quantity > 10
             UNION ALL SELECT l_orderkey, stage, 'weights', CAST(l_partkey AS VARCHAR) FROM l WHERE l_quantity > 10 UNION ALL SELECT DISTINCT l_orderkey, 'other', 'device', 'gpu' FROM l)
    SELECT * FROM held UNION ALL
    SELECT t.* FROM told t SEMI JOIN l ON l.l_orderkey = t.l_orderkey AND l.stage = t.stage ANTI JOIN held h ON h.l_orderkey = t.l_orderkey AND h.stage = t.stage AND h.fact = t.fact"""


@_query
def summary_binding(spark, d):
    """Orders as evaluations with a summary and a detail that name each other; some were written before bindings, some lack the digest, some were changed since."""
    g = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("q"), F.max("l_discount").alias("c"), F.min("l_tax").alias("t"), F.sum("l_partkey").alias("p"))
    plain = F.create_map(F.lit("rows"), F.col("n").cast("string"), F.lit("parts"), F.col("p").cast("string"), F.lit("note"), F.lit('é "quoted"'))
    g = g.withColumn("plain", plain)
    old = F.col("n") % 4 == 0
    detail = F.concat(F.lit('{"parts":'), F.col("p").cast("string"), F.when(old, "").otherwise(F.concat(F.lit(',"summary_binding_sha256":"'), bound(F.col("plain")), F.lit('"'))), F.lit("}"))
    g = g.withColumn("detail", detail)
    kept = F.map_concat(F.when(F.col("c") > 0.09, F.map_concat(F.map_filter("plain", lambda k, _: k != "rows"), F.create_map(F.lit("rows"), F.lit("0")))).otherwise(F.col("plain")), F.create_map(F.lit("detail_sha256"), F.when(F.col("t") > 0.04, F.lit(None).cast("string")).otherwise(F.sha2("detail", 256))))
    g = g.withColumns({"summary": kept, "detail": F.when(F.col("q") > 49, F.concat("detail", F.lit(" "))).otherwise(F.col("detail"))})
    return g.select("l_orderkey", binding_status(F.col("summary"), F.col("detail")).alias("status"))


# What was planted has to be found
ORACLE["summary_binding"] = """
    SELECT l_orderkey, CASE WHEN min(l_tax) > 0.04 THEN 'no_hash' WHEN max(l_quantity) > 49 THEN 'detail_differs' WHEN max(l_discount) > 0.09 AND count(*) % 4 > 0 THEN 'summary_differs' ELSE 'ok' END AS status FROM lineitem GROUP BY l_orderkey"""


@_query
def importer_choice(spark, d):
    """Turns as files that begin with one mark or another; users' turns ask for a format."""
    t = spark.read.parquet(f"{d}/conversations.parquet")
    first = F.lower(F.substring("text", 1, 1))
    mark = F.when(first < "c", "MThd").when(first < "e", '{"score": 1}').when(first < "g", '{"a": 1}').when(first < "l", "<?xml?>").when(first < "o", "RIFF").otherwise("")
    asked = F.when(F.col("role") == "user", F.when(F.length("text") % 3 == 0, "midi").when(F.length("text") % 3 == 1, "opus"))
    files = t.select("conv_id", "turn", F.encode(F.concat(mark, "text"), "UTF-8").alias("content"), asked.alias("asked"))
    return importers.choose(files, most=1000).drop("content")


ORACLE["importer_choice"] = """
    WITH f AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND length(text) % 3 < 2 THEN CASE length(text) % 3 WHEN 0 THEN 'midi' ELSE 'opus' END END AS asked, lower(text[1]) AS x, text,
      CASE WHEN lower(text[1]) < 'c' THEN 'MThd' WHEN lower(text[1]) < 'e' THEN '{"score": 1}' WHEN lower(text[1]) < 'g' THEN '{"a": 1}' WHEN lower(text[1]) < 'l' THEN '<?xml?>' WHEN lower(text[1]) < 'o' THEN 'RIFF' ELSE '' END || text AS content FROM conversations),
    r(name, mark) AS (VALUES ('json', '{'), ('midi', 'MThd'), ('musicxml', '<?xml'), ('score-json', '{"score"'), ('wave', 'RIFF')),
    m AS (SELECT conv_id, turn, string_agg(name, ',' ORDER BY name) AS names, count(*) AS n FROM f JOIN r ON CASE WHEN asked IS NULL THEN starts_with(content, mark) ELSE asked = name END GROUP BY conv_id, turn)
    SELECT f.conv_id, f.turn, asked, CASE WHEN content IS NULL THEN 'invalid_input' WHEN strlen(content) > 1000 THEN 'too_large' WHEN n IS NULL THEN 'unknown_format' WHEN n > 1 THEN 'ambiguous_format' ELSE 'ok' END AS status,
           CASE WHEN strlen(content) <= 1000 AND n = 1 THEN names END AS format, CASE WHEN strlen(content) <= 1000 AND n > 1 THEN names END AS matches FROM f LEFT JOIN m USING (conv_id, turn)"""

# A conversation as a diff: each turn a file, deleted where its text has no e; one hunk for each of its lines
_DIFF = """
    WITH t AS (SELECT conv_id, turn, n, line FROM (SELECT conv_id, turn, posexplode(split(coalesce(text, ''), chr(10))) AS (n, line) FROM conversations)),
    u AS (SELECT conv_id, turn, string_agg(concat('@@ -1,2 +', n * 10 + 1, CASE WHEN length(line) % 2 = 0 THEN ',3' ELSE '' END, CASE WHEN length(line) % 5 = 0 THEN ' @' ELSE ' @@ x' END, chr(10),
                 CASE WHEN length(line) % 3 = 0 THEN '-' ELSE ' ' END, line, chr(10), '+', line, chr(10), '+++ ', line, chr(10), ' kept', chr(10), '+'), chr(10)) WITHIN GROUP (ORDER BY n) AS hunks FROM t GROUP BY conv_id, turn)
    SELECT c.conv_id, string_agg(concat(CASE WHEN c.turn % 3 = 0 THEN '' ELSE concat('diff --git a/', c.turn, ' b/', c.turn, chr(10)) END, '--- a/', c.turn, chr(10), CASE WHEN coalesce(c.text, '') LIKE '%é%' THEN '+++ /dev/null' ELSE concat('+++ b/', c.turn) END, chr(10), hunks), chr(10)) WITHIN GROUP (ORDER BY c.turn) AS diff
    FROM conversations c JOIN u ON c.conv_id = u.conv_id AND c.turn = u.turn GROUP BY c.conv_id"""


@_query
def diff_added_lines(spark, d):
    diffs = spark.sql(_DIFF.replace("FROM conversations", f"FROM parquet.`{d}/conversations.parquet`"))
    return added_lines(diffs, "conv_id")


_DIFF_DUCK = _DIFF.replace("SELECT conv_id, turn, n, line FROM (SELECT conv_id, turn, posexplode(split(coalesce(text, ''), chr(10))) AS (n, line) FROM conversations)", "SELECT conv_id, turn, i - 1 AS n, l[i] AS line FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS l, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM conversations)")
ORACLE["diff_added_lines"] = rf"""
    WITH d AS ({_DIFF_DUCK.replace(") WITHIN GROUP (ORDER BY n)", " ORDER BY n)").replace(") WITHIN GROUP (ORDER BY c.turn)", " ORDER BY c.turn)")}),
    r AS (SELECT conv_id, i, l[i] AS t FROM (SELECT conv_id, string_split(diff, chr(10)) AS l, unnest(range(1, len(string_split(diff, chr(10))) + 1)) AS i FROM d)),
    k AS (SELECT *, CASE WHEN starts_with(t, 'diff --git ') OR (starts_with(t, '+++ /dev/null') AND NOT starts_with(t, '+++ b/')) THEN 'x' WHEN starts_with(t, '+++ b/') THEN 'f' WHEN starts_with(t, '@@ ') THEN 'h' WHEN starts_with(t, '+') THEN '+' WHEN starts_with(t, ' ') THEN ' ' END AS c FROM r),
    a AS (SELECT k.*, f.i AS fi, f.c AS fc, substr(f.t, 7) AS path FROM k ASOF LEFT JOIN (SELECT * FROM k WHERE c IN ('x', 'f')) f ON k.conv_id = f.conv_id AND k.i >= f.i),
    b AS (SELECT a.*, h.i AS hi, h.c AS hc, TRY_CAST(regexp_extract(h.t, '\+(\d+)(?:,\d+)?\s+@@', 1) AS BIGINT) AS start FROM a ASOF LEFT JOIN (SELECT * FROM k WHERE c IN ('x', 'h')) h ON a.conv_id = h.conv_id AND a.i >= h.i),
    g AS (SELECT * FROM b WHERE c IN ('+', ' ') AND fc = 'f' AND hc = 'h' AND start IS NOT NULL)
    SELECT DISTINCT conv_id, path, start + (SELECT count(*) FROM g p WHERE p.conv_id = g.conv_id AND p.hi = g.hi AND p.i < g.i) AS line FROM g WHERE c = '+'"""
