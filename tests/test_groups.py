"""The folds over songs: whole songs in order whatever the batches, and no call of the engine for each song."""
import pytest
from pyspark.sql import SparkSession

from cantata.operators import groups


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", 3).config("spark.ui.enabled", False).getOrCreate()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_songs_are_whole_and_many_share_a_batch(spark):
    rows = [(s if s else None, i, None if i % 5 == 0 else float(i), None if i == 3 else f"t{i}") for s in range(40) for i in range(s % 9)] + [(None, None, 1.5, "last")]
    df = spark.createDataFrame(rows[::-1], "song_id long, i long, x double, t string")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 3, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            out = groups.fold(df, "song_id", ["i"], lambda song: [(len(song), [r["i"] for r in song], song[-1]["x"], song[-1]["t"])], "n long, seen array<long>, x double, t string")
            assert "FlatMapGroups" not in _plan(out)
            got = {r.song_id: tuple(r)[1:] for r in out.collect()}
            assert got.pop(None) == (1, [None], 1.5, "last")
            want = {s: [r for r in rows if r[0] == s] for s in range(1, 40) if s % 9}
            assert got == {s: (len(r), [x[1] for x in r], r[-1][2], r[-1][3]) for s, r in want.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert groups.fold(df.where("false"), "song_id", ["i"], lambda song: [(1,)], "n long").count() == 0


def test_sides_of_a_pair_keep_their_columns_and_orders(spark):
    left = spark.createDataFrame([(1, 5, "b"), (1, 4, "c"), (2, 1, "a"), (None, 7, "n")], "song_id long, a long, v string")
    right = spark.createDataFrame([(1, 2.5, 1), (1, 0.5, 2), (3, 9.0, 3), (None, None, 4)], "song_id long, v double, w long")
    out = groups.pair(left, right, "song_id", (["a"], ["v"]), lambda x, y: [([r["v"] for r in x], [r["v"] for r in y], [sorted(r) for r in x + y][-1])], "x array<string>, y array<double>, names array<string>")
    assert "CoGroup" not in _plan(out)
    got = {r.song_id: (r.x, r.y, r.names) for r in out.collect()}
    mine, other = ["a", "song_id", "v"], ["song_id", "v", "w"]
    assert got == {1: (["c", "b"], [0.5, 2.5], other), 2: (["a"], [], mine), 3: ([], [9.0], other), None: (["n"], [None], other)}


def test_columns_become_values_without_a_step_for_each_value(monkeypatch):
    import pyarrow as pa

    struct = pa.struct([("d", pa.float64()), ("m", pa.int64()), ("s", pa.string())])
    deep = pa.array([[{"d": 1.5, "m": None, "s": "é"}, None], None, [], [{"d": None, "m": 3, "s": None}], [None, None], [{"d": 2.0, "m": 5, "s": "x"}]], pa.list_(struct))
    columns = [deep, deep.slice(1, 4), deep.slice(3), deep.slice(2, 1), deep.slice(0, 0), pa.array([None, "a", ""]).slice(1), pa.array([None, "a"]), pa.array([1, None, 3]), pa.array([None, None], pa.int64()), pa.array([True, None]), pa.array([[1, 2], [None], None]), pa.array([[["a"], None], []])]
    for c in columns:
        assert groups._values(c) == c.to_pylist()
    rows = pa.array([[{"d": 1.0, "m": 2, "s": "three"}] * 3] * 5000, pa.list_(struct))
    calls = []
    monkeypatch.setattr(groups, "_values", lambda c, of=groups._values: calls.append(c) or of(c))
    assert groups._values(rows)[4999][2] == {"d": 1.0, "m": 2, "s": "three"} and len(calls) == 5
