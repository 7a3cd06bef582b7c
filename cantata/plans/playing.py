"""Queries of the keyed state machines over the event table, read as a table; a stream gives the same rows."""
from pyspark.sql import DataFrame, Window, functions as F

from cantata.streaming import sessions

#: Kinds of what follows the opening, by event number; some end a session and the next event opens one anew.
_KINDS = ["play", "presented", "credit", "pause", "play", "seek", "presented", "interrupt", "recover", "play", "presented", "credit", "credit"]


def commands(events: DataFrame) -> DataFrame:
    """Session events of the users of the event table."""
    song = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events.where("user_id IS NOT NULL").select(F.col("user_id").alias("session_id"), "event_id", F.row_number().over(song).cast("long").alias("seq"))
    n = F.col("event_id")
    kind = F.when(F.col("seq") == 1, "open").when(F.col("seq") == 2, "prepared").when(n % 61 == 0, "stop").when(n % 59 == 0, "fail").when(n % 29 == 0, "open")
    kind = F.coalesce(kind, F.element_at(F.array(*map(F.lit, _KINDS)), ((n % len(_KINDS)) + 1).cast("int")))
    at = F.col("seq") * 480 - n % 7 * 200
    return e.withColumn("kind", kind).select(
        "session_id", "seq", "kind",
        F.when(n % 17 == 0, F.lit("again")).otherwise(n.cast("string")).alias("command_id"), F.when(n % 5 == 0, F.col("seq") % 9).alias("expected_revision"), F.when(n % 11 == 0, F.col("seq") % 9).alias("epoch"),
        F.when(F.col("kind") == "open", F.lit(48000)).otherwise(at).alias("sample"), (at + 960).alias("end_sample"), F.when(F.col("session_id") % 4 == 0, "practice").alias("mode"),
    )


def session_replay(spark, d):
    return sessions.replay(commands(spark.read.parquet(f"{d}/events.parquet")))


def job_progress(spark, d):
    """Jobs whose updates come out of order and go on after the end."""
    e = spark.read.parquet(f"{d}/events.parquet").where("user_id IS NOT NULL")
    status = F.when(F.col("event_id") % 31 == 0, "succeeded").otherwise("running")
    return sessions.jobs(e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"), ((F.col("event_id") * 37 % 100) / 100).alias("progress")))


QUERIES = {f.__name__: f for f in (session_replay, job_progress)}
# The greatest progress so far, up to and with the first end
ORACLE = {"job_progress": """
    WITH u AS (SELECT user_id AS job_id, event_id AS seq, CASE WHEN event_id % 31 = 0 THEN 'succeeded' ELSE 'running' END AS status, (event_id * 37 % 100) / 100 AS p FROM events WHERE user_id IS NOT NULL),
    k AS (SELECT *, (SELECT max(a.p) FROM u a WHERE a.job_id = u.job_id AND a.seq <= u.seq) AS progress FROM u WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.job_id = u.job_id AND b.seq < u.seq AND b.status = 'succeeded'))
    SELECT job_id, seq, status, progress FROM (SELECT *, lag(progress) OVER w AS before, lag(status) OVER w AS was FROM k WINDOW w AS (PARTITION BY job_id ORDER BY seq)) WHERE was IS NULL OR was <> status OR before <> progress"""}
