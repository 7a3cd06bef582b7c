"""Session events against worked cases, and streams against tables."""
import random

import pytest
from pyspark.sql import SparkSession, functions as F

from cantata.plans import playing
from cantata.streaming import sessions

DATA = "/root/testdata/sf0.001"
SCHEMA = "session_id string, seq long, kind string, command_id string, expected_revision long, epoch long, sample long, end_sample long, mode string"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _play(spark, *events):
    """Answers to (kind, fields) in order."""
    rows = [{"session_id": "a", "seq": i, "kind": k} | f for i, (k, f) in enumerate(events)]
    got = sessions.replay(spark.createDataFrame([tuple(r.get(c.split()[0]) for c in SCHEMA.split(", ")) for r in rows], SCHEMA))
    return got.orderBy("seq").collect()


OPEN = ("open", {"sample": 1000})


def test_a_song_is_played_to_its_end(spark):
    got = _play(spark, OPEN, ("play", {}), ("prepared", {}), ("play", {"expected_revision": 1}), ("play", {}), ("presented", {"sample": 400}), ("presented", {"sample": 300}), ("pause", {}), ("presented", {"sample": 500}), ("play", {}), ("presented", {"sample": 1000}), ("play", {}), ("stop", {}))
    assert [(r.disposition, r.error) for r in got] == [("applied", None), ("rejected", "not_ready"), ("applied", None), ("applied", None), ("no_op", None), ("applied", None), ("rejected", "position_regressed"), ("applied", None), ("rejected", "not_playing"), ("applied", None), ("applied", None), ("rejected", "terminal"), ("no_op", None)]
    assert (got[-1].state, got[-1].revision, got[-1].epoch, got[-1].position, got[-1].eligibility) == ("finished", 5, 5, 1000, "whole_song")


def test_stale_repeated_and_conflicting_commands(spark):
    got = _play(spark, OPEN, ("prepared", {}), ("play", {"command_id": "x", "expected_revision": 0}), ("play", {"command_id": "x", "expected_revision": 1}), ("pause", {}), ("play", {"command_id": "x", "expected_revision": 0}), ("pause", {"command_id": "x"}), ("presented", {"sample": 1, "epoch": 9}), ("stop", {"expected_revision": 77}))
    assert [(r.disposition, r.error) for r in got[2:]] == [("rejected", "stale_revision"), ("applied", None), ("applied", None), ("replayed", None), ("rejected", "command_id_conflict"), ("rejected", "stale_epoch"), ("applied", None)]
    assert got[5].state == "playing" and got[5].revision == 2 and got[6].state == "paused" and got[7].stale_rejections == 1


def test_seek_interrupt_and_the_first_downgrade(spark):
    got = _play(spark, OPEN, ("prepared", {}), ("seek", {"sample": 0}), ("seek", {"sample": 1000}), ("play", {}), ("interrupt", {}), ("play", {}), ("interrupt", {}), ("recover", {}), ("seek", {"sample": 10}), ("recover", {}), ("fail", {}), ("recover", {}), OPEN)
    assert [(r.disposition, r.error) for r in got[2:]] == [("no_op", None), ("rejected", "out_of_range"), ("applied", None), ("applied", None), ("rejected", "device_unavailable"), ("no_op", None), ("applied", None), ("applied", None), ("rejected", "not_ready"), ("applied", None), ("rejected", "terminal"), ("applied", None)]
    assert got[8].state == "paused" and got[9].eligibility == "downgraded:interrupted" and got[-1].state == "preparing" and got[-1].eligibility == "whole_song"
    assert _play(spark, ("open", {"sample": 0}))[0].error == "invalid_duration" and _play(spark, ("play", {}))[0].error == "session_not_found" and _play(spark, OPEN, OPEN)[1].error == "session_busy"


def test_credits_join(spark):
    rng = random.Random(1)
    spans = [(a, a + rng.randrange(1, 90)) for a in (rng.randrange(900) for _ in range(40))]
    got = _play(spark, OPEN, ("prepared", {}), ("play", {}), *(("credit", {"sample": a, "end_sample": b}) for a, b in spans), ("credit", {"sample": 5, "end_sample": 5}))
    seen = set()
    for (a, b), r in zip(spans, got[3:]):
        assert r.fresh_samples == len(set(range(a, b)) - seen)
        seen |= set(range(a, b))
    assert got[-1].error == "invalid_range"


def test_the_ledger_is_bounded(spark):
    got = _play(spark, ("open", {"sample": 10**9}), ("prepared", {}), ("play", {}), *(("credit", {"sample": 10 * i, "end_sample": 10 * i + 5}) for i in range(257)), ("credit", {"sample": 5, "end_sample": 10}))
    assert [r.error for r in got[-3:]] == [None, "ledger_full", None]


def test_followers_and_logs(spark):
    schema = "client_id string, seq long, instance string, session_id string, state string, revision long, epoch long, position long"
    rows = [("i", "s", "playing", 3, 2, 50), ("i", "s", "playing", 3, 2, 40), ("i", "s", "paused", 3, 2, 40), ("i", "s", "playing", 2, 5, 90), ("i", "s", "playing", 4, 1, 90), ("i", "s", "playing", 4, 3, 0), ("j", "s", "playing", 9, 9, 99), ("i", "t", "ready", 0, 1, 0)]
    got = sessions.follow(spark.createDataFrame([("c", n, *r) for n, r in enumerate(rows)], schema)).orderBy("seq").collect()
    assert [r.result for r in got] == ["new_session", "regressed", "applied", "stale_revision", "stale_epoch", "epoch_advanced", "wrong_instance", "new_session"]
    log = [("a", n, e, s) for n, (e, s) in enumerate([(1, "playing"), (2, "playing"), (2, "playing"), (1, "playing"), (5, "paused"), (6, "stopped"), (7, "playing")])]
    got = sessions.deliver(spark.createDataFrame(log, "session_id string, seq long, event_seq long, state string")).orderBy("seq").collect()
    assert [(r.event_seq, r.gap) for r in got] == [(1, False), (2, False), (5, True), (6, False)]


def test_empty(spark):
    assert sessions.replay(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_stream_gives_the_rows_of_the_table(spark, tmp_path):
    c = playing.commands(spark.read.parquet(f"{DATA}/events.parquet")).where("session_id < 12")
    # One file for each stretch of events, read one at a time in order of age.
    for lo in range(0, 200, 25):
        part = c.where((F.col("seq") > lo) & (F.col("seq") <= lo + 25))
        if part.head(1):
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sessions.replay(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got, want = spark.read.parquet(str(tmp_path / "out")), sessions.replay(c)
    assert want.count() > 50 and sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
