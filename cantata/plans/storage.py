"""Queries of the song store, the result cache and the manifest scan over the driver tables."""
from pyspark.sql import functions as F

from cantata.operators import alignment
from cantata.sources import cache, manifest, store
from cantata.sources.publish import work_path

from . import views
from .analysis import _view

QUERIES, ORACLE = {}, {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def song_store(spark, d):
    """Orders as songs and lines as notes: saved, edited (urgent ones an octave up; high ones by a stale command), loaded and verified."""
    root = work_path(spark, "store")
    orders = spark.read.parquet(f"{d}/orders.parquet")
    songs = orders.select(F.col("o_orderkey").alias("song_id"), F.lit(0).cast("long").alias("generation"), F.col("o_orderstatus").alias("state"))
    notes = _view(spark, d, "note", "song_id, seq, start_sample, midi_note")
    store.save(spark, root, {"song": songs, "notes": notes})
    commands = orders.where("o_orderpriority in ('1-URGENT', '2-HIGH')").select(F.col("o_orderkey").alias("song_id"), F.when(F.col("o_orderpriority") == "2-HIGH", 3).otherwise(0).cast("long").alias("base_generation"))
    outcome = store.edit(spark, root, commands, {"notes": notes.withColumn("midi_note", F.col("midi_note") + 12)})
    now = store.load(spark, root, verify=True)
    sums = now["notes"].groupBy("song_id").agg(F.count(F.lit(1)).alias("notes"), F.sum("midi_note").alias("pitch_sum"))
    out = now["song"].join(outcome.select("song_id", "outcome"), "song_id", "left").join(sums, "song_id", "left")
    return out.select("song_id", "generation", "state", F.coalesce("outcome", F.lit("untouched")).alias("outcome"), F.coalesce("notes", F.lit(0)).cast("long").alias("notes"), "pitch_sum")


ORACLE["song_store"] = views.with_views(["note"], """
    SELECT o_orderkey AS song_id, CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS BIGINT) AS generation, o_orderstatus AS state,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'saved' WHEN '2-HIGH' THEN 'conflict' ELSE 'untouched' END AS outcome, count(seq) AS notes,
           CAST(sum(midi_note + CASE WHEN o_orderpriority = '1-URGENT' THEN 12 ELSE 0 END) AS BIGINT) AS pitch_sum
    FROM orders LEFT JOIN note ON o_orderkey = song_id GROUP BY o_orderkey, o_orderpriority, o_orderstatus""")


@_query
def result_cache(spark, d):
    """Characters and letters of each turn, made once for equal texts: assistants' turns first, then all, so that what both say is a hit."""
    root = work_path(spark, "cache")
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text")

    def count(rows):
        return alignment.normalised(rows, "cache_key").select("cache_key", F.size("chars").cast("long").alias("chars"), F.size(F.array_distinct(F.transform("chars", lambda c: c["char"]))).cast("long").alias("letters"))

    first = cache.cached(turns.where("role = 'assistant'"), ["text"], {"pipeline": 1, "step": "letters"}, count, root)
    first.write.format("noop").mode("overwrite").save()
    return cache.cached(turns, ["text"], {"step": "letters", "pipeline": 1}, count, root).select("conv_id", "turn", "chars", "letters", F.col("_source").alias("source"))


ORACLE["result_cache"] = r"""
    WITH t AS (SELECT conv_id, turn, list_filter(string_split(replace(lower(coalesce(text, '')), 'ß', 'ss'), ''), lambda c: NOT regexp_matches(c, '[\s\p{P}]') AND c <> '') AS c,
               EXISTS (SELECT 1 FROM conversations a WHERE a.role = 'assistant' AND a.text IS NOT DISTINCT FROM o.text) AS held FROM conversations o)
    SELECT conv_id, turn, len(c) AS chars, len(list_distinct(c)) AS letters, CASE WHEN held THEN 'hit' ELSE 'computed' END AS source FROM t"""


@_query
def dataset_manifest(spark, d):
    """Files written from the conversations, one folder for each role and first letter, scanned under a manifest in which some digests are old and one file more is named."""
    root = work_path(spark, "dataset")
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    said = turns.select(F.coalesce("text", F.lit("")).alias("value"), F.coalesce(F.lower(F.regexp_extract("text", "([A-Za-z])", 1)), F.lit("none")).alias("letter"), F.coalesce("role", F.lit("none")).alias("role"))
    said.hint("rebalance", "role", "letter").write.partitionBy("role", "letter").text(root)
    files = manifest.scan(spark, root).where("path not like '%_SUCCESS'")
    letter = F.regexp_extract("path", "letter=([^/]*)", 1)
    listed = files.select(F.col("path").alias("id"), F.when(letter < "d", "holdout").otherwise("development").alias("split"), letter.alias("source_group"), "path", F.when(letter == "e", F.sha2("path", 256)).otherwise(F.col("sha256")).alias("sha256"))
    more = spark.range(1).select(F.lit("lost").alias("id"), F.lit("holdout").alias("split"), F.lit("lost").alias("source_group"), F.lit("role=user/lost.txt").alias("path"), F.sha2(F.lit("lost"), 256).alias("sha256"))
    checked = manifest.verify(listed.unionByName(more), root)
    return checked.groupBy("split", "source_group", "status").agg((F.count(F.lit(1)) > 0).alias("found"))
