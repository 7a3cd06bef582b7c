"""The song store, the result cache and the manifest scan, with writers that race, die or go astray."""
import hashlib
import threading
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import SparkSession, functions as F

from cantata.sources import cache, manifest, publish, store
from cantata.sources.publish import work_path


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


SONG, NOTE = "song_id long, generation long, title string", "song_id long, pitch int, bucket string"


def _store(spark, root, n=12, buckets=4):
    songs = spark.createDataFrame([(i, 0, f"t{i}") for i in range(n)] + [(None, 0, None)], SONG)
    notes = spark.createDataFrame([(i, p, "theirs") for i in range(n) for p in range(i % 4)] + [(3, 1, None)] * 2 + [(None, 5, "x")], NOTE)
    store.save(spark, root, {"song": songs, "notes": notes, "lyrics": spark.createDataFrame([], "song_id long, text string")}, buckets=buckets)
    return {"song": songs, "notes": notes}


def _same(a, b):
    return a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()


def _commands(spark, rows):
    return spark.createDataFrame(rows, "song_id long, base_generation long")


def test_round_trip(spark):
    root = work_path(spark, "store")
    with pytest.raises(FileNotFoundError):
        store.load(spark, root)
    rows = _store(spark, root)
    back = store.load(spark, root, verify=True)
    assert _same(rows["song"], back["song"]) and _same(rows["notes"], back["notes"]) and back["lyrics"].count() == 0 and back["lyrics"].columns == ["song_id", "text"]


def test_half_written_and_changed_stores_are_refused(spark):
    root = work_path(spark, "store")
    local = Path(root.removeprefix("file://"))
    # Rows without a marker are no version.
    store._write(spark.createDataFrame([(1, 0, "t")], SONG), root, "song", "song_id", 4)
    with pytest.raises(FileNotFoundError):
        store.load(spark, root)
    _store(spark, root)
    run = store.marker(spark, root, 1)["tables"]["notes"]["buckets"]
    bucket, part = next(iter(run.items()))
    (file,) = (local / f"data/notes/{part['run']}/_bucket={bucket}").glob("part-*.parquet")
    data, extra = file.read_bytes(), file.with_name("part-more.parquet")
    extra.write_bytes(data)
    with pytest.raises(store.Damaged):
        store.load(spark, root, verify=True)
    extra.unlink()
    store.load(spark, root, verify=True)
    file.unlink()
    with pytest.raises(store.Damaged):
        store.load(spark, root, verify=True)


def test_edit_checks_generations(spark):
    root = work_path(spark, "store")
    _store(spark, root)
    new = spark.createDataFrame([(3, 100, "n"), (5, 101, "n"), (7, 102, "n")], NOTE)
    got = {r.song_id: (r.outcome, r.generation) for r in store.edit(spark, root, _commands(spark, [(3, 0), (5, 9), (99, 0), (4, 0)]), {"notes": new}).collect()}
    assert got == {3: ("saved", 1), 4: ("saved", 1), 5: ("conflict", 0), 99: ("not_found", None)}
    now, old = store.load(spark, root, verify=True), store.load(spark, root, 1, verify=True)
    pitches = lambda t, i: sorted(r.pitch for r in t["notes"].where(F.col("song_id") == i).collect())
    assert pitches(now, 3) == [100] and pitches(now, 4) == [] and pitches(now, 5) == [0] and pitches(old, 3) == [0, 1, 1, 1, 2]
    assert {r.song_id: (r.generation, r.title) for r in now["song"].collect()} == {i: (int(i in (3, 4)), None if i is None else f"t{i}") for i in [*range(12), None]}
    # Buckets without a saved song are those of the version before; a call that saves nothing makes no version.
    a, b = (store.marker(spark, root, v)["tables"]["notes"]["buckets"] for v in (1, 2))
    hit = {r[0] for r in _commands(spark, [(3, 0), (4, 0)]).select(store.bucket(F.col("song_id"), 4)).collect()}
    assert all((a[k] == b[k]) == (int(k) not in hit) for k in set(a) & set(b)) and len(hit) < 4
    store.edit(spark, root, _commands(spark, [(3, 0)]), {"notes": new})
    assert store.latest(spark, root) == 2
    with pytest.raises(ValueError):
        store.edit(spark, root, _commands(spark, [(3, 1), (3, 1)]), {})
    # New titles come with rows of the song table, whatever generation they claim.
    store.edit(spark, root, _commands(spark, [(3, 1)]), {"song": spark.createDataFrame([(3, 77, "new"), (6, 77, "new")], SONG)})
    assert [tuple(r) for r in store.load(spark, root)["song"].where("song_id in (3, 6)").orderBy("song_id").collect()] == [(3, 2, "new"), (6, 0, "t6")]


def test_writers_that_race(spark):
    root = work_path(spark, "store")
    _store(spark, root)

    def one(k):
        # Each edits a song of its own, and all of them song 0.
        return {r.song_id: r.outcome for r in store.edit(spark, root, _commands(spark, [(0, 0), (k, 0)]), {"notes": spark.createDataFrame([(0, k, "r"), (k, k, "r")], NOTE)}).collect()}

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(one, range(1, 5)))
    assert all(g[k] == "saved" for k, g in enumerate(got, 1)) and sorted(g[0] for g in got) == ["conflict"] * 3 + ["saved"]
    now = store.load(spark, root, verify=True)
    winner = next(k for k, g in enumerate(got, 1) if g[0] == "saved")
    assert store.latest(spark, root) == 5 and [r.pitch for r in now["notes"].where("song_id = 0").collect()] == [winner]
    assert {r.song_id for r in now["song"].where("generation = 1").collect()} == {0, 1, 2, 3, 4}


def test_readers_never_see_half_a_save(spark, monkeypatch):
    root = work_path(spark, "store")
    _store(spark, root)
    before = {t: df.collect() for t, df in store.load(spark, root).items()}
    real, dead = store._write, threading.Event()

    def dies(rows, at, table, *more):
        if table == "notes":
            dead.set()
            raise OSError("gone")
        return real(rows, at, table, *more)

    def unpublished(*_):
        raise OSError("gone")

    new = {"notes": spark.createDataFrame([(3, 100, "n")], NOTE)}
    for name, f in (("_write", dies), ("publish", unpublished)):
        with monkeypatch.context() as m:
            m.setattr(store, name, f)
            with pytest.raises(OSError):
                store.edit(spark, root, _commands(spark, [(3, 0)]), new)
        after = store.load(spark, root, verify=True)
        assert store.latest(spark, root) == 1 and all(sorted(map(str, df.collect())) == sorted(map(str, before[t])) for t, df in after.items())
    assert dead.is_set() and store.edit(spark, root, _commands(spark, [(3, 0)]), new).first().outcome == "saved"


def test_publish_is_whole_and_first(spark):
    root = work_path(spark, "files")
    publish.publish(spark, f"{root}/x/a.json", {"b": 1, "a": ["é", None]})
    assert Path(root.removeprefix("file://"), "x/a.json").read_text() == '{"a":["é",null],"b":1}' and publish.read_json(spark, f"{root}/x/a.json") == {"a": ["é", None], "b": 1}
    with pytest.raises(publish.Taken):
        publish.publish(spark, f"{root}/x/a.json", {})
    with pytest.raises(ValueError):
        publish.publish(spark, f"{root}/x/b.json", float("nan"))
    with pytest.raises(ValueError):
        publish.read_json(spark, f"{root}/x/a.json", most=3)
    assert publish.names(spark, f"{root}/x") == ["a.json"] and publish.names(spark, f"{root}/none") == [] and not list(Path(root.removeprefix("file://"), "drafts").glob("[!.]*"))


def test_cache_computes_once(spark):
    root, asked = work_path(spark, "cache"), []

    def double(rows):
        asked.append(rows.count())
        return rows.select("cache_key", (F.coalesce("v", F.lit(-1)) * 2).alias("w"))

    rows = lambda vs: spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "i int, v int")
    call = lambda vs, **identity: sorted((r.i, r.w, r["_source"]) for r in cache.cached(rows(vs), ["v"], {"model": "m", **identity}, double, root).collect())
    assert call([1, 2, 2, None]) == [(0, 2, "computed"), (1, 4, "computed"), (2, 4, "computed"), (3, -2, "computed")] and asked == [3]
    assert call([2, None]) == [(0, 4, "hit"), (1, -2, "hit")] and asked == [3]
    assert call([2, 7]) == [(0, 4, "hit"), (1, 14, "computed")] and asked == [3, 1]
    assert call([2], options={"x": 1}) == [(0, 4, "computed")] and asked == [3, 1, 1]
    assert call([]) == [] and asked == [3, 1, 1]
    # Rows whose run was never published, and rows that were changed, are made again.
    home = next(Path(root.removeprefix("file://")).glob("*"))
    for run in Path(root.removeprefix("file://")).glob("*/runs/*"):
        run.unlink()
    assert call([2]) == [(0, 4, "computed")] and home.exists()
    bad = spark.createDataFrame([(0, 5)], "i int, v int").withColumn("cache_key", cache.cache_key({"model": "m"}, "v")).select("cache_key", F.lit(99).alias("w"), F.lit("no seal").alias("_seal"))
    at = next(p for p in Path(root.removeprefix("file://")).glob("*") if list(p.glob("runs/*")))
    bad.write.parquet(f"file://{at}/data/false")
    publish.publish(spark, f"file://{at}/runs/false", {"identity": 0})
    assert call([5]) == [(0, 10, "computed")] and call([5]) == [(0, 10, "hit")]


def test_manifest_finds_what_is_wrong(spark, tmp_path):
    files = {"a.txt": b"one", "b c.txt": b"two", "sub/c.txt": b"three", "sub/same.txt": b"three", "big.bin": b"x" * 5000, "empty": b"e", "nothing": b""}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    sha = {n: hashlib.sha256(d).hexdigest() for n, d in files.items()}
    root = f"file://{tmp_path}"
    assert {(r.path, r.bytes, r.sha256) for r in manifest.scan(spark, root, 1000).collect()} == {(n, len(d), sha[n] if len(d) < 1000 else None) for n, d in files.items() if d}
    zero = "0" * 64
    rows = [
        ("ok", "development", "g1", "a.txt", sha["a.txt"], "ok"), ("blank", "development", "g1", "b c.txt", sha["b c.txt"], "ok"), ("changed", "development", "g6", "b c.txt", zero, "altered"), ("missing", "holdout", "g2", "no.txt", zero, "missing"),
        ("large", "holdout", "g2", "big.bin", sha["big.bin"], "too_large"), ("twice", "holdout", "g2", "empty", sha["empty"], "duplicate_id"), ("twice", "holdout", "g2", "empty", sha["empty"], "duplicate_id"),
        ("up", "holdout", "g2", "../x/a.txt", zero, "unsafe_path"), ("root", "holdout", "g2", "/a.txt", zero, "unsafe_path"), ("nothing", "holdout", "g2", "nothing", sha["nothing"], "missing"), ("drive", "holdout", "g2", "C:a.txt", zero, "unsafe_path"), ("none", "holdout", "g2", None, zero, "unsafe_path"),
        ("split", "train", None, "gone", zero, "invalid"), (None, "holdout", "g2", "gone", zero, "invalid"), ("digest", "holdout", "g2", "gone", "ABC", "invalid"), ("nodigest", "holdout", "g2", "gone", None, "invalid"),
        ("left", "development", "g3", "empty", sha["empty"], "group_in_both_splits"), ("right", "holdout", "g3", "empty", sha["empty"], "group_in_both_splits"),
        ("here", "development", "g4", "sub/c.txt", sha["sub/c.txt"], "content_in_both_splits"), ("there", "holdout", "g5", "sub/same.txt", sha["sub/same.txt"], "content_in_both_splits"),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "id string, split string, source_group string, path string, sha256 string")
    got = manifest.verify(df, root, 1000)
    assert sorted((str(r.id), str(r.path), r.status) for r in got.collect()) == sorted((str(r[0]), str(r[3]), r[5]) for r in rows)
    total = {r.split: (r.samples, r.faults) for r in manifest.summary(got).collect()}
    assert total[None] == (len(rows), sum(r[5] != "ok" for r in rows)) and total["development"] == (5, 3)
