"""Queries of the ordered and per-song operators over the views of the driver tables."""
from functools import partial

from pyspark.sql import functions as F

from cantata.functions import text
from cantata.operators import folds, matching
from cantata.sources import strict_json

from . import views


def _view(spark, d, name, columns="*"):
    """A view of views.py over the tables of one folder, read by path, so that folders do not meet in a session's names."""
    sql = views.with_views([name], f"SELECT {columns} FROM {name}", views.DEALT)
    for t in views.SOURCES[name]:
        sql = sql.replace(f"FROM {t}", f"FROM parquet.`{d}/{t}.parquet`")
    return spark.sql(sql)


def _sides(spark, d):
    """Reference notes (side 0) and predicted ones (1) of one reading: the reference notes moved, some an octave off, some left out."""
    moved = "CAST((seq * 7 % 5 - 2) * 700 AS BIGINT)"
    n = _view(spark, d, "note", f"""song_id, confidence, inline(array(
        struct(0 AS side, start_sample, end_sample, midi_note),
        struct(1 AS side, start_sample + {moved} AS start_sample, end_sample + {moved} AS end_sample, midi_note + CAST(CASE WHEN midi_note < 60 AND seq * 3 % 4 = 0 THEN 12 ELSE 0 END AS BIGINT) AS midi_note)))""")
    return n.where("side = 0 OR confidence < 0.99 AND start_sample >= 0")


def boundary_matches(spark, d):
    found = _view(spark, d, "boundary", "song_id, sample + CAST(probability * 9 AS BIGINT) % 4 * 480 AS sample, probability").where("probability < 0.9")
    return matching.match_points(_view(spark, d, "boundary"), found, 1440)


def boundary_metrics(spark, d):
    return matching.point_metrics(boundary_matches(spark, d), "song_id")


def note_matches(spark, d):
    return matching.match_sides(_sides(spark, d), 2400)


def note_metrics(spark, d):
    return matching.note_metrics(note_matches(spark, d), "song_id")


def note_fragments(spark, d):
    notes = _view(spark, d, "note", "song_id, seq * 9600 AS start_sample, seq * 9600 + 9000 - (seq * midi_note) % 3 * 3000 AS end_sample, 60 + midi_note % 4 AS midi_note, confidence, (seq * 37 % 100) / 100.0E0 AS before_probability, (midi_note * 13 % 100) / 100.0E0 AS after_probability")
    return folds.merge_fragments(notes.withColumn("end_sample", F.col("end_sample") + 600), 5000)


def note_pairing(spark, d):
    """Notes through note-on and note-off events and back, with retriggers where notes of one pitch overlap, and a pedal that goes down with some notes and up a while after."""
    event = "struct({0} AS tick, {1} AS seq, '{2}' AS kind, 0L AS channel, {3} AS note, {4}L AS velocity)".format
    e = _view(spark, d, "note", f"""song_id, inline(concat(
        array({event("start_sample", "seq * 2", "on", "60 + midi_note % 5", 90)}, {event("end_sample", "seq * 2 + 1", "off", "60 + midi_note % 5", 0)}),
        CASE WHEN midi_note % 5 = 1 THEN array({event("start_sample", "seq * 2 + 100000", "sustain", "127L", 0)}, {event("start_sample + 14400", "seq * 2 + 100001", "sustain", "0L", 0)}) ELSE array() END))""")
    return folds.pair_notes(e, extend=True)


def boundary_peaks(spark, d):
    frames = _view(spark, d, "pitch_frame", "song_id, idx * 480 + 240 AS sample, confidence AS probability")
    return matching.suppress(frames, 0.5, 2400)


def text_errors(spark, d):
    """Each reply against the turn before it, as reference and hypothesis."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    last = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    pairs = c.select("conv_id", "turn", F.col("text").alias("hypothesis")).join(last, ["conv_id", "turn"])
    return text.error_rates(text.compare(pairs, "conv_id", "turn"), "conv_id")


def event_objects(spark, d):
    return strict_json.objects(spark.read.parquet(f"{d}/events.parquet"), "event_id", "props", 1 << 16).withColumn("keys", F.array_join("keys", ","))


QUERIES = {f.__name__: partial(f) for f in (boundary_matches, boundary_metrics, note_matches, note_metrics, note_fragments, note_pairing, boundary_peaks, text_errors, event_objects)}
