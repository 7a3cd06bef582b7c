"""Edit commands against worked cases."""
import pytest
from pyspark.sql import SparkSession

from cantata.operators import edits

ITEM = "song_id string, kind string, id string, start_sample long, end_sample long, text string, midi_note long, lyric_id string, confidence double, timing_confidence double, source string"
OP = "song_id string, op long, kind string, verb string, id string, start_sample long, end_sample long, text string, midi_note long, lyric_id string, duration long"
ITEMS = [
    ("lyric", "l1", 0, 100, "la", None, None, 0.9, 0.8, "asr"), ("lyric", "l2", 100, 200, "li", None, None, 0.9, 0.8, "asr"),
    ("note", "n1", 0, 50, None, 60, "l1", 0.7, None, "model"), ("note", "n2", 100, 150, None, 62, "l2", 0.7, None, "model"),
]


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _edit(spark, *ops, items=ITEMS):
    """(items by id, faults) after operations (kind, verb, id, start, end, text, midi, lyric)."""
    got = edits.apply_edits(spark.createDataFrame([("a", *i) for i in items], ITEM), spark.createDataFrame([("a", n, *o, 1000) for n, o in enumerate(ops)], OP)).collect()
    return {r.id: r for r in got if r.code is None}, [(r.op, r.code) for r in got if r.code]


def test_changes_lose_the_confidence_of_what_changed(spark):
    got, faults = _edit(
        spark, ("lyric", "update", "l1", 0, 100, "lo", None, None), ("lyric", "update", "l2", 110, 200, "li", None, None), ("note", "update", "n1", 10, 50, None, 60, None),
        ("note", "update", "n2", 100, 150, None, 63, None), ("lyric", "add", "l3", 300, 400, "neu", None, None), ("note", "add", "n3", 300, 350, None, 64, "l3"), ("note", "add", "n4", 1, 2, None, 1, None), ("note", "delete", "n4", None, None, None, None, None),
    )
    assert not faults and set(got) == {"l1", "l2", "l3", "n1", "n2", "n3"}
    assert [(got[i].confidence, got[i].timing_confidence) for i in ("l1", "l2", "n1", "n2", "n3")] == [(None, 0.8), (0.9, None), (0.7, None), (None, None), (None, None)]
    assert got["n1"].start_sample == 10 and got["n1"].lyric_id == "l1" and got["n3"].source == got["l1"].source == "manual"


def test_one_fault_rejects_all(spark):
    got, faults = _edit(
        spark, ("note", "update", "n1", 0, 50, None, 61, None), ("note", "update", "nix", 0, 50, None, 61, None), ("note", "add", "n1", 5, 5, None, 200, "gone"), ("lyric", "add", " ", 0, 2000, " ", None, None), ("lyric", "delete", "nix", None, None, None, None, None), ("chord", "add", "c", 0, 1, None, None, None),
    )
    assert got["n1"].midi_note == 60 and got["n1"].source == "model"
    assert sorted(faults) == [(1, "unknown_id"), (2, "duplicate_id"), (2, "invalid_midi_note"), (2, "invalid_range"), (2, "missing_lyric_ref"), (3, "empty_id"), (3, "empty_text"), (3, "out_of_song"), (4, "unknown_id"), (5, "unknown_kind")]


def test_a_line_with_notes_is_not_deleted(spark):
    drop = ("lyric", "delete", "l1", None, None, None, None, None)
    got, faults = _edit(spark, drop)
    assert faults == [(None, "missing_lyric_ref")] and "l1" in got
    got, faults = _edit(spark, drop, ("note", "delete", "n1", None, None, None, None, None))
    assert not faults and set(got) == {"l2", "n2"}


def test_bounds_and_empty_sides(spark):
    assert _edit(spark, *[("note", "update", "n1", 0, 50, None, 61, None)] * 1025)[1] == [(None, "too_many_ops")]
    assert len(_edit(spark)[0]) == 4
    assert set(_edit(spark, ("lyric", "add", "x", 0, 1, "y", None, None), items=[])[0]) == {"x"}
