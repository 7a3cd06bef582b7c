"""Text alignment against another reading of the same rules, and worked cases."""
import random
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import SparkSession, functions as F

from cantata.operators import alignment
from cantata.plans import texts


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def test_places_of_normalised_characters():
    assert alignment.places("Ａ Ｂ!") == [("a", 0, 1), ("b", 2, 3)]
    assert alignment.places("ｶﾞX") == [("ガ", 0, 2), ("x", 2, 3)]
    assert alignment.places("ẹ́é") == [(unicodedata.normalize("NFKC", "ẹ́"), 0, 3)] * 0 + [(c, 0, 3) for c in unicodedata.normalize("NFKC", "ẹ́")] + [("é", 3, 4)]
    assert alignment.places("ß㍿") == [("s", 0, 1), ("s", 0, 1), *[(c, 1, 2) for c in "株式会社"]]
    assert alignment.places("́a") == [("́", 0, 1), ("a", 1, 2)] and alignment.places("") == alignment.places(" .\n、") == []


def test_operations_equal_another_reading():
    rng = random.Random(1)
    for size, letters in ((8, "ab"), (30, "ab"), (60, "abcdef"), (300, "abcdefghijkl "), (40, "x")):
        for _ in range(60):
            a = "".join(rng.choices(letters, k=rng.randrange(size)))
            b = a
            if rng.random() < 0.7:
                for _ in range(rng.randrange(6)):
                    p, q = sorted(rng.choices(range(len(b) + 1), k=2))
                    b = b[:p] + "".join(rng.choices(letters, k=rng.randrange(5))) + b[min(q, p + 6):]
            else:
                b = "".join(rng.choices(letters, k=rng.randrange(size)))
            assert list(alignment.operations(a, b)) == SequenceMatcher(None, a, b, autojunk=False).get_opcodes(), (a, b)


def _table(spark, rows):
    t = spark.createDataFrame(rows, "id int, a string, b string")
    return alignment.normalised(t, "id", col="a", to="a").join(alignment.normalised(t, "id", col="b", to="b"), "id", "full")


def test_missing_extra_and_other_versions(spark):
    cases = [("青い空", "青い海", "replace"), ("青い空", "青い空へ", "insert"), ("青い空へ", "青い空", "delete"), ("Ａ Ｂ", "ab", "equal"), ("", "新しい歌", "insert"), (None, "新しい歌", "insert"), ("歌", "", "delete"), ("", None, None), ("あ" * 5000, "あ" * 5000, "too_large"), ("a", "b" * 16001, "too_large")]
    ops = alignment.align(_table(spark, [(i, a, b) for i, (a, b, _) in enumerate(cases)]), "id")
    got = {}
    for r in ops.collect():
        got.setdefault(r.id, []).append(r)
    for i, (a, b, tag) in enumerate(cases):
        assert (tag in [r.operation for r in got[i]]) if tag else i not in got
    assert [(r.operation, r.a_end, r.b_end, r.a_text) for r in got[8]] == [("too_large", 5000, 5000, None)]
    assert [(r.operation, r.a_text, r.b_text) for r in sorted(got[0], key=lambda r: r.step)] == [("equal", "青い", "青い"), ("replace", "空", "海")]
    m = alignment.matches(ops, "id").where("id = 1").collect()
    assert sorted((r.a_index, r.b_index) for r in m) == [(0, 0), (1, 1), (2, 2)] and alignment.matches(ops, "id").where("id = 8").count() == 0
    assert alignment.align(_table(spark, []), "id").count() == 0


def _plain_timeline(lines, segments, times):
    """The rules read again: lines and segments as lists of texts, times by (segment, index)."""
    ref = [(n, c) for n, t in lines for c, *_ in alignment.places(t)]
    asr = [(s, k, c) for s, t in segments for k, (c, *_) in enumerate(alignment.places(t))]
    match = {}
    for tag, a0, a1, b0, _ in SequenceMatcher(None, "".join(c for *_, c in asr), "".join(c for _, c in ref), autojunk=False).get_opcodes():
        if tag == "equal":
            match.update({b0 + k: a0 + k for k in range(a1 - a0)})
    same = Counter(tuple(c for c, *_ in alignment.places(t)) for _, t in lines)
    out = []
    for n, t in lines:
        idx = [i for i, (line, _) in enumerate(ref) if line == n]
        src = [match[i] for i in idx if i in match]
        seen = [times.get(asr[match[i]][:2]) if i in match else None for i in idx]
        complete = bool(idx) and None not in seen
        ordered = complete and all(x[1] <= y[0] for x, y in zip(seen, seen[1:]))
        ok = ordered and src == list(range(src[0], src[-1] + 1))
        flags = ["nonmonotonic_reference_timing_review"] * (complete and not ordered) + ["repeated_reference_review"] * (same[tuple(c for c, *_ in alignment.places(t))] > 1) + ["reference_mismatch_or_unaligned"] * (not ok)
        out.append((n, "matched" if ok else "unaligned", seen[0][0] if ok else None, seen[-1][1] if ok else None, len(idx), ",".join(flags)))
    return out


def _timeline(spark, songs):
    lines = alignment.normalised(spark.createDataFrame([(s, n, t) for s, (ls, _, _) in songs.items() for n, t in ls], "song_id int, line_id int, text string"), "song_id", "line_id")
    heard = alignment.normalised(spark.createDataFrame([(s, n, t) for s, (_, ss, _) in songs.items() for n, t in ss], "song_id int, segment_id int, text string"), "song_id", "segment_id")
    observed = spark.createDataFrame([(s, seg, k, "aligned", *v) for s, (_, _, times) in songs.items() for (seg, k), v in times.items()], "song_id int, segment_id int, normalized_index int, status string, start_sample long, end_sample long")
    both = alignment.whole(heard, "song_id", "segment_id", to="a").join(alignment.whole(lines, "song_id", "line_id", to="b"), "song_id", "full")
    m = alignment.matches(alignment.align(both, "song_id"), "song_id")
    out = alignment.timeline(lines, alignment.characters(lines, "song_id", "line_id", "line_id"), alignment.characters(heard, "song_id", "segment_id", "segment_id"), m, observed)
    got = {}
    for r in out.collect():
        got.setdefault(r.song_id, []).append(tuple(r)[1:])
    return {s: sorted(v) for s, v in got.items()}


def test_timeline_cases(spark):
    got = _timeline(spark, {
        1: ([(1, "あい"), (2, "あい")], [(1, "あい"), (2, "あい")], {}),
        2: ([(1, "あい")], [(1, "あ"), (2, "い")], {(1, 0): (1000, 2000), (2, 0): (500, 900)}),
        3: ([(1, "A, b!"), (3, "...")], [(1, "ab")], {(1, 0): (10, 20), (1, 1): (20, 30)}),
        4: ([(1, "ab")], [(1, "axb")], {(1, 0): (1, 2), (1, 1): (2, 3), (1, 2): (3, 4)}),
    })
    assert [(r[1], r[2]) for r in got[1]] == [("unaligned", None)] * 2 and all("repeated_reference_review" in r[5] for r in got[1])
    assert got[2] == [(1, "unaligned", None, None, 2, "nonmonotonic_reference_timing_review,reference_mismatch_or_unaligned")]
    assert got[3] == [(1, "matched", 10, 30, 2, ""), (3, "unaligned", None, None, 0, "reference_mismatch_or_unaligned")]
    assert got[4] == [(1, "unaligned", None, None, 2, "reference_mismatch_or_unaligned")]


def test_timeline_equals_a_plain_reading(spark):
    rng, songs = random.Random(7), {}
    for s in range(60):
        lines = [(n, "".join(rng.choices("abc, é", k=rng.randrange(8)))) for n in range(1, rng.randrange(2, 7))]
        said = "".join(t if rng.random() < 0.7 else t[1:] + "z" for _, t in lines)
        cuts = sorted({0, len(said), *rng.choices(range(len(said) + 1), k=2)})
        segments = [(n, said[a:b]) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        times = {(n, k): (1000 * n + 100 * k, 1000 * n + 100 * k + rng.choice([100, 100, 100, 150])) for n, t in segments for k in range(len(alignment.places(t))) if rng.random() < 0.97}
        songs[s] = (lines, segments, times)
    got = _timeline(spark, songs)
    assert got == {s: sorted(_plain_timeline(*v)) for s, v in songs.items()}
    assert {r[1] for v in got.values() for r in v} == {"matched", "unaligned"}


def test_queries_say_something(spark):
    d = "/root/testdata/sf0.001"
    ops = texts.text_alignment(spark, d)
    assert {r[0] for r in ops.select("operation").distinct().collect()} >= {"equal", "replace", "delete", "insert"}
    assert len({r[0] for r in texts.reference_timeline(spark, d).groupBy(F.concat_ws("|", "status", "flags")).count().collect()}) >= 3
    # What was heard and the reference are put together again from the operations.
    for c, part in (("a", texts._heard), ("b", texts._lines)):
        back = ops.groupBy("song_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", f"{c}_text"))), lambda x: x[f"{c}_text"]), "").alias("t")).where("t <> ''")
        whole = alignment.whole(part(texts._turns(spark, d)), "song_id", "segment_id" if c == "a" else "line_id").select("song_id", F.array_join(F.transform("a", lambda x: x["char"]), "").alias("t")).where("t <> ''")
        assert back.exceptAll(whole).count() == whole.exceptAll(back).count() == 0


def _long_turns(spark, folder):
    """A turn of 1,100 words in 100 lines, beyond the budget of a pair, and one of a single letter."""
    rng = random.Random(5)
    said = ["".join(rng.choices("abcdelnoprstx", k=rng.randrange(2, 8))) for _ in range(1100)]
    text = "\n".join(" ".join(said[i:i + 11]) + "." for i in range(0, 1100, 11))
    spark.createDataFrame([(1, 0, "user", text), (2, 0, "user", "あ" * 5000)], "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


def test_pairs_beyond_the_budget_are_mapped(spark, tmp_path):
    d, got = _long_turns(spark, tmp_path), {}
    for r in texts.text_alignment(spark, d).orderBy("step").collect():
        got.setdefault(r.song_id, []).append((r.operation, r.a_start, r.a_end, r.b_start, r.b_end))
    a, b = ("".join(c["char"] for r in part(texts._turns(spark, d)).where("song_id = '1:0'").orderBy(n).collect() for c in r.chars) for part, n in ((texts._heard, "segment_id"), (texts._lines, "line_id")))
    assert len(a) * len(b) > alignment.MOST_CELLS and got["1:0"] == SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    assert got["2:0"] == [("equal", 0, 5000, 0, 5000)]


def test_blocks_of_texts_whose_equal_cells_are_not_held(monkeypatch):
    rng = random.Random(2)
    for most in (0, 5, 60):
        monkeypatch.setattr(alignment, "MOST_EQUAL", most)
        for size, letters in ((8, "ab"), (40, "x"), (60, "abcdef"), (200, "aé日\U0001f600")):
            for _ in range(40):
                a = "".join(rng.choices(letters, k=rng.randrange(size)))
                p = rng.randrange(len(a) + 1)
                b = a[p:] + "".join(rng.choices(letters, k=rng.randrange(size // 2))) + a[:p]
                assert list(alignment.operations(a, b)) == SequenceMatcher(None, a, b, autojunk=False).get_opcodes(), (a, b)


def test_timeline_of_pairs_beyond_the_budget(spark, tmp_path):
    d = _long_turns(spark, tmp_path)
    got = {}
    for r in texts.reference_timeline(spark, d).orderBy("line_id").collect():
        got.setdefault(r.song_id, []).append(tuple(r)[1:])
    for song in ("1:0", "2:0"):
        lines, segments = ([(r[1], "".join(c["char"] for c in r.chars)) for r in part(texts._turns(spark, d)).where(F.col("song_id") == song).orderBy(n).collect()] for part, n in ((texts._lines, "line_id"), (texts._heard, "segment_id")))
        assert got[song] == _plain_timeline(lines, segments, {(n, k): (n * 20000 + k * 240, n * 20000 + k * 240 + 240) for n, t in segments for k, c in enumerate(t) if c != "z"})
    assert {r[1] for r in got["1:0"]} == {"matched", "unaligned"} and got["2:0"][0][1] == "matched"


def test_plain_characters_are_those_with_places(spark):
    rng = random.Random(4)
    letters = "aZ.ß \t\n、ée\u0301Ａｶﾞﾟ㍿\U0001d400İ\u0345한\u1100\u1161"
    said = ["", "\u0301a", *("".join(rng.choices(letters, k=rng.randrange(12))) for _ in range(3000))]
    assert [alignment.plain(t) for t in said] == ["".join(c for c, *_ in alignment.places(t)) for t in said]
    t = spark.createDataFrame([(1, "A b!"), (2, None), (3, "")], "id int, text string")
    assert {tuple(r) for r in alignment.normalised_text(t, "id").collect()} == {(1, "ab"), (2, ""), (3, "")}


def test_timeline_in_rows_equals_a_plain_reading(spark):
    rng, songs = random.Random(11), {}
    for s in range(150):
        lines = [(n, "".join(rng.choices("abc, é", k=rng.randrange(8)))) for n in range(1, rng.randrange(2, 7))]
        said = "".join(t if rng.random() < 0.7 else t[1:] + "z" for _, t in lines)
        cuts = sorted({0, len(said), *rng.choices(range(len(said) + 1), k=2)})
        segments = [(n, said[a:b]) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        times = {(n, k): (1000 * n + 100 * k, 1000 * n + 100 * k + rng.choice([100, 100, 100, 150])) for n, t in segments for k in range(len(alignment.places(t))) if rng.random() < 0.97}
        songs[s] = (lines, segments, times)
    sides = [alignment.normalised_text(spark.createDataFrame([(s, n, t) for s, v in songs.items() for n, t in v[i]], f"song_id int, {n} int, text string"), "song_id", n) for i, n in enumerate(("line_id", "segment_id"))]
    spans = [(s, *([ts.get((n, k), (None, None))[i] for n, t in seg for k in range(len(alignment.places(t)))] for i in (0, 1))) for s, (_, seg, ts) in songs.items()]
    held = alignment.songs(*sides).join(spark.createDataFrame(spans, "song_id int, starts array<long>, ends array<long>"), "song_id")
    got = {}
    for r in alignment.timeline_of(held, F.col("starts"), F.col("ends")).collect():
        got.setdefault(r.song_id, []).append(tuple(r)[1:])
    assert {s: sorted(v) for s, v in got.items()} == {s: sorted(_plain_timeline(*v)) for s, v in songs.items()}
    assert {f for v in got.values() for r in v for f in r[5].split(",")} == {"", "nonmonotonic_reference_timing_review", "repeated_reference_review", "reference_mismatch_or_unaligned"}
