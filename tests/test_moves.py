"""How often rows are moved: plans of queries that work within songs."""
import re

import pytest
from pyspark.sql import SparkSession, functions as F

import __spark_entry__ as entry
from cantata.operators import melody
from cantata.plans import melody as plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def still(spark):
    """Plans as a whole, without broadcasts."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name, most", [("median_around", 3), ("boundary_decision", 3), ("equal_pitch_islands", 1), ("note_candidates", 5)])
def test_songs_move_once_for_each_table_read(still, name, most):
    plan = _plan(entry.queries()[name](still, DATA))
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) <= most
    assert "Join" not in plan and "Generate" not in plan


def test_both_sides_of_a_match_come_from_one_reading(still):
    plan = _plan(entry.queries()["note_matches"](still, DATA))
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) == 1 and plan.count("Scan parquet") == 1


def test_lines_and_segments_move_once_as_texts(still):
    plan = _plan(entry.queries()["reference_timeline"](still, DATA))
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) == 2 and plan.count("SortMergeJoin") == 1
    # No row of a single character, and no character with its places.
    assert "normalized_index" not in plan and "char_start" not in plan


def test_hypotheses_need_no_join(still):
    plan = _plan(entry.queries()["note_hypotheses"](still, DATA))
    assert "Join" not in plan
    assert len(re.findall(r"\bExchange ?hashpartitioning\(song_id#\w+, candidate", plan)) == 1


def test_a_candidate_keeps_its_nearest_note_only_where_none_explains_it(spark):
    found = spark.createDataFrame([(1, 1, 0, 480, 60.2, 0.9), (1, 2, 480, 960, 61.0, 0.001), (1, 3, 960, 1440, None, 0.9), (None, 1, 0, 480, 60.0, 0.9)], "song_id long, candidate int, start_sample long, end_sample long, base_midi double, confidence double")
    outer = spark.createDataFrame([(1, 0, 480, 64, 0.8), (None, 0, 480, 70, 0.8)], "song_id long, start_sample long, end_sample long, midi_note long, confidence double")
    got = {(r.song_id, r.candidate, r.midi_note): r.score for r in melody.hypotheses(found, outer).collect()}
    # Candidate 2 is too unsure to explain itself; those without a base are left out, and a song without a key meets no other.
    assert {k for k in got if k[:2] == (1, 2)} == {(1, 2, 61)} and (1, 1, 64) in got
    assert not [k for k in got if k[1] == 3] and (None, 1, 60) in got and (None, 1, 70) not in got
    assert got[1, 1, 64] == pytest.approx(0.85 * 0.8) and got[1, 2, 61] == 0.001


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """Events and lines of orders: song 1 has pitches and notes, 2 only notes, 3 frames without a pitch and notes, 4 pitches only; some keys are null."""
    d = str(tmp_path_factory.mktemp("mixed"))
    frames = [(song, value) for song, value in ((1, 220.0), (3, 20.0), (4, 330.0), (None, 220.0)) for _ in range(12)]
    spark.createDataFrame([(i, f"2024-01-01 00:00:{i:02}", song, "click" if i % 5 == 0 else "view", value) for i, (song, value) in enumerate(frames)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{d}/events.parquet")
    lines = [(song, n + 1, 20 + n, 1, 9.0 + n, 100.0, 0.05) for song in (1, 2, 3, None) for n in range(4)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{d}/lineitem.parquet")
    return d


def test_a_path_reads_the_notes_of_heard_songs_only(spark, mixed):
    path = entry.queries()["note_path"](spark, mixed)
    assert not [f for f in path.inputFiles() if "lineitem" in f]
    assert {r.song_id for r in path.collect()} == {1, 4}
    kept = spark.read.parquet(plans._notes_of_heard_songs(spark, mixed)).orderBy("seq").collect()
    whole = plans._external(spark, mixed).where("song_id = 1").orderBy("seq").collect()
    assert kept == whole and len(kept) == 4


def test_a_path_without_a_heard_song_is_empty(spark, mixed, tmp_path):
    for t in ("events", "lineitem"):
        spark.read.parquet(f"{mixed}/{t}.parquet").where("true" if t == "lineitem" else "value < 55").write.parquet(f"{tmp_path}/{t}.parquet")
    assert entry.queries()["recovered_notes"](spark, str(tmp_path)).collect() == []
