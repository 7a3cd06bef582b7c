"""Queries of the follower, the event log, edit commands, repeated pieces and joined chunks over the driver tables."""
from pyspark.sql import Window, functions as F

from cantata.functions import text
from cantata.operators import audio, edits
from cantata.streaming import sessions

from . import views
from .analysis import _view

QUERIES, ORACLE = {}, {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


# Snapshots that a client receives: revision and epoch rise with time, save where an old one comes late
_SEEN = """
    SELECT song_id AS client_id, idx + 1 AS seq, CASE WHEN event_id % 43 = 0 THEN 'other' ELSE 'main' END AS instance, CAST(floor(idx / 30) AS BIGINT) AS session_id, CASE WHEN event_id % 3 > 0 THEN 'playing' ELSE 'paused' END AS state,
           CAST(floor(idx / 3) AS BIGINT) - CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END AS revision, CAST(floor(idx / 10) AS BIGINT) - CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS epoch, idx * 480 - CASE WHEN event_id % 5 = 0 THEN 1000 ELSE 0 END AS position FROM pitch_frame"""


@_query
def client_follow(spark, d):
    frames = _view(spark, d, "pitch_frame", "song_id, event_id, idx")
    n = F.col("event_id")
    step = lambda k: F.floor(F.col("idx") / k).cast("long")
    rows = frames.select(
        F.col("song_id").alias("client_id"), (F.col("idx") + 1).cast("long").alias("seq"), F.when(n % 43 == 0, "other").otherwise("main").alias("instance"), step(30).alias("session_id"), F.when(n % 3 > 0, "playing").otherwise("paused").alias("state"),
        (step(3) - F.when(n % 7 == 0, 2).otherwise(0)).alias("revision"), (step(10) - F.when(n % 11 == 0, 1).otherwise(0)).alias("epoch"), (F.col("idx") * 480 - F.when(n % 5 == 0, 1000).otherwise(0)).alias("position"))
    return sessions.follow(rows)


# The state of a client carried from snapshot to snapshot by recursion
ORACLE["client_follow"] = views.with_views(["pitch_frame"], f"""
    WITH seen AS ({_SEEN})
    SELECT client_id, seq, result FROM (
      WITH RECURSIVE walk(client_id, seq, result, i, s, r, e, p) AS (
        SELECT client_id, seq, 'new_session', instance, session_id, revision, epoch, position FROM seen WHERE seq = 1 UNION ALL
        SELECT client_id, seq, result, CASE WHEN keep THEN i ELSE instance END, CASE WHEN keep THEN s ELSE session_id END, CASE WHEN keep THEN r ELSE revision END, CASE WHEN keep THEN e ELSE epoch END, CASE WHEN keep THEN p ELSE position END FROM (
          SELECT *, result IN ('wrong_instance', 'stale_revision', 'stale_epoch', 'regressed') AS keep FROM (
            SELECT n.*, w.i, w.s, w.r, w.e, w.p, CASE WHEN n.instance <> w.i THEN 'wrong_instance' WHEN n.session_id <> w.s THEN 'new_session' WHEN n.revision < w.r THEN 'stale_revision' WHEN n.epoch < w.e THEN 'stale_epoch'
              WHEN n.revision = w.r AND n.epoch = w.e AND n.state = 'playing' AND n.position < w.p THEN 'regressed' WHEN n.epoch > w.e THEN 'epoch_advanced' ELSE 'applied' END AS result
            FROM walk w JOIN seen n ON n.client_id = w.client_id AND n.seq = w.seq + 1)))
      SELECT * FROM walk)""")

# A log whose backlog and live parts overlap: numbers go back at each reconnection, and some are lost
_LOG = "SELECT song_id AS session_id, idx + 1 AS seq, idx + 1 - 4 * CAST(floor(idx / 9) AS BIGINT) + CASE WHEN idx > 20 THEN 2 ELSE 0 END AS event_seq, CASE WHEN idx > 40 AND event_id % 9 = 0 THEN 'finished' ELSE 'playing' END AS state FROM pitch_frame"


@_query
def event_delivery(spark, d):
    f = _view(spark, d, "pitch_frame", "song_id, event_id, idx")
    i = F.col("idx")
    rows = f.select(F.col("song_id").alias("session_id"), (i + 1).cast("long").alias("seq"), (i + 1 - 4 * F.floor(i / 9) + F.when(i > 20, 2).otherwise(0)).cast("long").alias("event_seq"), F.when((i > 40) & (F.col("event_id") % 9 == 0), "finished").otherwise("playing").alias("state"))
    return sessions.deliver(rows)


ORACLE["event_delivery"] = views.with_views(["pitch_frame"], f"""
    WITH log AS ({_LOG}), high AS (SELECT *, coalesce(max(event_seq) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM log),
    fresh AS (SELECT * FROM high WHERE event_seq > before), shut AS (SELECT session_id, min(seq) AS last FROM fresh WHERE state = 'finished' GROUP BY session_id)
    SELECT f.session_id, seq, event_seq, state, event_seq > before + 1 AS gap FROM fresh f LEFT JOIN shut s USING (session_id) WHERE last IS NULL OR seq <= last""")


@_query
def repeated_pieces(spark, d):
    """Turns in which a piece of 1 to 32 characters stands four times in a row, and those whose first words do when said four times."""
    t = spark.read.parquet(f"{d}/conversations.parquet")
    said = F.when(F.col("role") == "assistant", F.concat(F.repeat(F.substring("text", 1, 20), 4), "text")).otherwise(F.col("text"))
    return t.select("conv_id", "turn", text.repeats(said).alias("repeats"))


ORACLE["repeated_pieces"] = r"""
    WITH t AS (SELECT conv_id, turn, regexp_replace(coalesce(CASE WHEN role = 'assistant' THEN repeat(substr(text, 1, 20), 4) || text ELSE text END, ''), '[\s\pZ]+', '', 'g') AS s FROM conversations),
    c AS (SELECT conv_id, turn, i, l[i] AS ch FROM (SELECT conv_id, turn, string_split(s, '') AS l, unnest(range(1, length(s) + 1)) AS i FROM t)),
    same AS (SELECT a.conv_id, a.turn, n, a.i, a.i - row_number() OVER (PARTITION BY a.conv_id, a.turn, n ORDER BY a.i) AS island FROM c a CROSS JOIN range(1, 33) r(n) JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn AND b.i = a.i + n AND b.ch = a.ch),
    hit AS (SELECT DISTINCT conv_id, turn FROM (SELECT conv_id, turn, n, island FROM same GROUP BY conv_id, turn, n, island HAVING count(*) >= 3 * n))
    SELECT conv_id, turn, EXISTS (SELECT 1 FROM hit h WHERE h.conv_id = t.conv_id AND h.turn = t.turn) AS repeats FROM t"""


@_query
def edited_songs(spark, d):
    """Orders as songs with a command each: high notes move down, weak ones go, one is added; songs with a very high note name one that is not there, and keep all as it was."""
    none = lambda kind: F.lit(None).cast(kind)
    n = _view(spark, d, "note").withColumn("id", F.concat(F.lit("n"), F.lpad(F.col("seq").cast("string"), 3, "0")))
    items = n.select(
        "song_id", F.lit("note").alias("kind"), "id", "start_sample", "end_sample", none("string").alias("text"), "midi_note", none("string").alias("lyric_id"), F.col("confidence").cast("double").alias("confidence"), none("double").alias("timing_confidence"), F.lit("model").alias("source"))
    verb = F.when(F.col("confidence") < 0.91, "delete").when(F.col("midi_note") > 80, "update")
    ops = n.withColumn("verb", verb).where("verb is not null").select("song_id", F.col("seq").cast("long").alias("op"), F.lit("note").alias("kind"), "verb", F.when(F.col("midi_note") == 95, "gone").otherwise(F.col("id")).alias("id"), "start_sample", "end_sample", (F.col("midi_note") - 12).alias("midi_note"))
    more = n.where("seq = 1").select("song_id", F.lit(1000).cast("long").alias("op"), F.lit("note").alias("kind"), F.lit("add").alias("verb"), F.lit("n999").alias("id"), "start_sample", "end_sample", F.lit(60).cast("long").alias("midi_note"))
    ops = ops.unionByName(more).withColumns({"text": none("string"), "lyric_id": none("string"), "duration": F.lit(1 << 40).cast("long")})
    out = edits.apply_edits(items, ops)
    return out.select("song_id", "id", "start_sample", "end_sample", "midi_note", "confidence", "source", "op", "code")


ORACLE["edited_songs"] = views.with_views(["note"], """
    WITH n AS (SELECT *, 'n' || lpad(CAST(seq AS VARCHAR), 3, '0') AS id, CASE WHEN confidence < 0.91 THEN 'delete' WHEN midi_note > 80 THEN 'update' END AS verb FROM note),
    bad AS (SELECT song_id, seq AS op FROM n WHERE verb IS NOT NULL AND midi_note = 95), fine AS (SELECT * FROM n WHERE song_id NOT IN (SELECT song_id FROM bad))
    SELECT song_id, id, start_sample, end_sample, midi_note, CAST(confidence AS DOUBLE) AS confidence, 'model' AS source, NULL AS op, NULL AS code FROM n WHERE song_id IN (SELECT song_id FROM bad)
    UNION ALL SELECT song_id, NULL, NULL, NULL, NULL, NULL, NULL, op, 'unknown_id' FROM bad
    UNION ALL SELECT song_id, id, start_sample, end_sample, midi_note, CAST(confidence AS DOUBLE), 'model', NULL, NULL FROM fine WHERE verb IS NULL
    UNION ALL SELECT song_id, id, start_sample, end_sample, midi_note - 12, NULL, 'manual', NULL, NULL FROM fine WHERE verb = 'update'
    UNION ALL SELECT song_id, 'n999', start_sample, end_sample, 60, NULL, 'manual', NULL, NULL FROM fine WHERE seq = 1""")

#: Samples of a chunk, from one chunk to the next, and of a fade.
_LENGTH, _HOP, _FADE = 32, 24, 7


@_query
def joined_chunks(spark, d):
    """Signals cut into overlapping chunks, each a little louder than the one before, and joined again."""
    f = _view(spark, d, "pitch_frame", "song_id, idx, CAST(floor(coalesce(value, 0) * 4) AS DOUBLE) / 4 AS x")
    f = f.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("song_id")))
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - (_LENGTH - 1)) / _HOP))
    parts = f.withColumn("k", F.explode(F.sequence(first, F.floor(F.col("idx") / _HOP)))).withColumn("x", F.col("x") + F.col("k") % 3)
    chunks = parts.groupBy("song_id", "k", "total").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda p: p["x"].cast("float")).alias("samples"))
    chunks = chunks.select("song_id", (F.col("k") * _HOP).cast("long").alias("start"), F.col("total").cast("long").alias("total"), "samples")
    out = audio.overlap_add(chunks, _FADE, 16, "song_id")
    return out.select("song_id", F.posexplode("samples").alias("i", "sample"), "block").select("song_id", (F.col("block") * 16 + F.col("i")).alias("idx"), F.round("sample", 3).alias("sample"))


ORACLE["joined_chunks"] = views.with_views(["pitch_frame"], f"""
    WITH f AS (SELECT song_id, idx, floor(coalesce(value, 0) * 4) / 4.0 AS x, count(*) OVER (PARTITION BY song_id) AS total FROM pitch_frame),
    c AS (SELECT f.*, k, k * {_HOP} AS s, least({_LENGTH}, total - k * {_HOP}) AS n FROM f, range(0, 2000) r(k) WHERE k * {_HOP} <= idx AND idx < k * {_HOP} + {_LENGTH} AND k <= total / {_HOP}),
    w AS (SELECT *, CASE WHEN s > 0 THEN least(1.0, (idx - s + 1) / (least({_FADE}, n) + 1.0)) ELSE 1 END * CASE WHEN s + n < total THEN least(1.0, (n - (idx - s)) / (least({_FADE}, n) + 1.0)) ELSE 1 END AS g FROM c)
    SELECT song_id, idx, round(sum(CAST((x + k % 3) AS DOUBLE) * g) / sum(CAST(g AS DOUBLE)), 3) AS sample FROM w GROUP BY song_id, idx""")
