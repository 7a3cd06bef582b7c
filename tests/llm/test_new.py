"""Whitening, phrases and WARC archives against plain readings."""
import gzip
import hashlib
import random
import re
import tempfile
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession, functions as F

import brute
from cantata.llm import phrases, warc, whitening
from cantata.llm.common import work_path


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


# Whitening

EMB = "vec_id long, embedding array<float>, n int"


def _plain_whitening(rows, width, k=8):
    kept = [(i, np.floor(1024 * np.array([float(np.float32(c)) for c in v])).astype(np.int64) + 100000) for i, v in rows if v is not None and len(v) == width and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    x = np.array([v for _, v in kept])
    n, s = len(x), x.sum(axis=0)
    y = n * x - s
    d = y / n
    values, vectors = np.linalg.eigh(d.T @ d / n)
    values, vectors = values[::-1][:k], vectors.T[::-1][:k]
    return [i for i, _ in kept], n, (y.astype(object) ** 2).sum(axis=1), d @ vectors.T / np.sqrt(values), values / np.trace(d.T @ d / n)


def test_whitening_equals_a_plain_reading(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 12)) @ np.diag(np.linspace(2, 0.2, 12)) + rng.standard_normal(12)
    rows = [(i, v[i].tolist()) for i in range(300)] + [(5, v[5].tolist()), (None, v[6].tolist()), (400, None), (401, []), (402, [1.0] * 11), (403, [float("nan")] + [0.0] * 11), (404, [float("inf")] + [0.0] * 11), (405, [None] + [0.0] * 11)]
    df = spark.createDataFrame([(i, x, 7) for i, x in rows], EMB).repartition(5)
    got = whitening.whitened(df).toPandas().sort_values(["vec_id", "component"])
    ids, n, deviation, z, explained = _plain_whitening(rows, 12)
    assert n == 302 and len(got) == 302 * 8 and set(got.n) == {302} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    assert got.vec_id.isna().sum() == 8 and (got.vec_id == 5).sum() == 16 and not set(got.vec_id) & {400, 401, 402, 403, 404, 405}
    dev = {i: d for i, d in zip(ids, deviation)}
    assert all(dev[None if np.isnan(i) else int(i)] == d for i, d in zip(got.vec_id, got.deviation))
    for c in range(1, 9):
        mine = got[(got.component == c) & got.vec_id.notna()].drop_duplicates("vec_id")
        want = {i: z[k, c - 1] for k, i in enumerate(ids)}
        w = np.array([want[int(i)] for i in mine.vec_id])
        sign = np.sign((w * mine.whitened).sum())
        assert np.abs(w - sign * mine.whitened).max() < 1e-9 and abs(mine.explained.iloc[0] / explained[c - 1] - 1) < 1e-12


def test_whitening_of_odd_tables(spark):
    one = whitening.whitened(spark.createDataFrame([(1, [0.5, 0.25], 0)], EMB)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)]
    assert whitening.whitened(spark.createDataFrame([], EMB)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None, 0), (2, [], 0)], EMB)).count() == 0
    # Two distinct vectors: one component has variance.
    two = whitening.whitened(spark.createDataFrame([(i, [float(i % 2), 1.0, 0.0], 0) for i in range(10)], EMB)).toPandas()
    assert set(np.abs(two[two.component == 1].whitened).round(9)) == {1.0} and (two[two.component > 1].whitened == 0).all() and two.identity_error.max() < 1e-12
    wide = whitening.whitened(spark.createDataFrame([(i, [float((i * 7 + j * j) % 11) for j in range(300)], 0) for i in range(60)], EMB)).toPandas()
    assert wide.identity_error.max() < 1e-9 and len(wide) == 480
    with pytest.raises(Exception, match="entry passes"):
        whitening.whitened(spark.createDataFrame([(1, [1e30], 0)], EMB)).collect()


def test_eigensolver_equals_another_one():
    rng = np.random.default_rng(2)
    for d in (1, 2, 3, 5, 20, 64, 150):
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for values in (rng.random(d), np.ones(d), np.repeat(rng.random(-(-d // 4)), 4)[:d], 10.0 ** -np.arange(d), np.concatenate((np.ones(min(3, d)), 1 - 1e-9 * np.arange(d - min(3, d)))), np.zeros(d)):
            a = q * values @ q.T
            a, k = (a + a.T) / 2, min(8, d)
            e, v = whitening.eigen(a, k)
            assert np.allclose(e, np.linalg.eigvalsh(a)[::-1][:k], rtol=0, atol=1e-13 * max(1, d)) and np.abs(v @ v.T - np.eye(k)).max() < 1e-12
            assert np.abs(a @ v.T - v.T * e).max() < 1e-12
    diag, off = np.array([2.0, 2.0, 2.0]), np.array([0.0, 0.0])
    assert whitening.above(diag, off, np.array([1.9, 2.0, 2.1])).tolist()[::2] == [3, 0]


# Phrases

def _plain_phrases(rows, threshold=100, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cand = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= threshold}
    out = {}
    for (lang, w), a in cand.items():
        if any(v >= a and len(x) > len(w) and lang == o and any(x[i:i + len(w)] == w for i in range(len(x) - len(w) + 1)) for (o, x), v in cand.items()):
            continue
        s, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1))


def _phrases(spark, rows, **more):
    df = spark.createDataFrame([(i, t, lang, "x", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int").repartition(3)
    return sorted(tuple(r) for r in phrases.phrases(df, **more).collect())


def _texts(seed, n=1500):
    rng = random.Random(seed)
    words = ["The", "of", "É", "new", "york", "city", "a-b", "x", " ", "日本"]
    gaps = [" "] * 12 + ["  ", "\t", ". ", ", ", "\n", "\r\n", "!?"]
    out = []
    for i in range(n):
        t = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(60)))
        out.append((rng.choice(["en", "en", "en", "de", None, "und"]), rng.choice([t, t + " New York City", "New\tYork  city of x", "", None])))
    return out


def test_phrases_equal_a_plain_reading(spark):
    rows = _texts(1) + [("en", "very long " * 30000), ("fr", "w" * 200000), ("", "a b. " * 150)]
    want = _plain_phrases(rows)
    assert len(want) > 15 and _phrases(spark, rows) == want
    assert _phrases(spark, rows, top=3) == _plain_phrases(rows, top=3)
    assert _phrases(spark, rows, threshold=7) == _plain_phrases(rows, 7)
    assert _phrases(spark, []) == [] and _phrases(spark, [(None, None), ("en", ""), ("en", ". \n")]) == []


def test_phrases_across_slices_and_chunks(monkeypatch):
    """The same n-grams whatever the slices, with pieces that go on behind a cut."""
    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join(rng.choices(["aa", "b", "cc.", "d", "eeee"], k=rng.randrange(400))) for _ in range(20)] + ["x " * 500, "y" * 900 + " z z z"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])

    def grams():
        out = Counter()
        for _, w in phrases.buffers(batch):
            g = w.grams("en")
            for n in range(1, 6):
                for i in phrases.possible(w, g, {}, n):
                    out[n, w.phrase(i, n), int(g[n - 1][i])] += 1
        return out

    want = grams()
    assert len({(n, p) for n, p, _ in want}) == len(want) == len({h for *_, h in want})
    for size in (1, 10, 100, 1000):
        monkeypatch.setattr(phrases, "SLICE", size)
        assert grams() == want


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(3)
    for mass, capacity in ((20000, 200), (20000, 401), (20000, 5)):
        keys = np.where(rng.random(mass) < 0.3, rng.integers(0, 20, mass), rng.integers(0, 10**9, mass)).astype(np.uint64)
        s = phrases.Summary(capacity, 100)
        for part in np.array_split(keys, 37):
            s.add(*[x.astype(t) for x, t in zip(np.unique(part, return_counts=True), (np.uint64, np.int64))])
            s.merge()
        k, c = np.unique(keys, return_counts=True)
        assert set(k[c >= 100].tolist()) <= set(s.survivors().tolist()) and s.taken < 100
        if capacity > mass / 100:  # never more counters than the capacity, and few others survive
            assert len(s.keys) <= capacity and s.taken > 0


def test_keys_are_cut_to_what_the_mass_needs():
    h = np.random.default_rng(6).integers(0, 1 << 64, 1000, dtype=np.uint64)
    assert [phrases.key_bytes(m) for m in (0, 10**6, 4 * 10**8, 10**12, 10**15, 10**18)] == [5, 5, 5, 6, 8, 8]
    for width in (5, 6, 8):
        back = phrases.unpacked(phrases.packed(h, width), width)
        assert (back >> np.uint64(64 - 8 * width) == h >> np.uint64(64 - 8 * width)).all() and (width == 8) == (back == h).all()


def test_phrase_map_passes_every_survivor(spark):
    h = np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, 5000)
    m = phrases.bitmap(spark.createDataFrame([(int(x),) for x in h], "h long"))
    assert phrases.passes(m, h.view(np.uint64)).all() and phrases.passes(m, np.arange(10000, dtype=np.uint64) * np.uint64(7919)).mean() < 0.1
    assert not phrases.passes(phrases.bitmap(spark.createDataFrame([], "h long")), h.view(np.uint64)).any()


# WARC

PAGES = "page_id long, url string, html string, payload_digest string, top string"


def _plain_warc(rows):
    top = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            top[b] = max(top.get(b, i), i)
    out = []
    for i, u, h in rows:
        b = (h or "").encode()
        t = top.get(b)
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), *(("revisit", t) if t is not None and t != i else ("response", None))))
    return sorted(out, key=str)


def _pages():
    long, other = "<p>é" + "x" * 1200, "y" * 999
    rows = [(i, f"http://a.com/{i}", long) for i in range(40)] + [(100 + i, "u", other) for i in range(5)] + [(200, None, None), (201, "", ""), (None, "http://b", long), (None, None, "n" * 2000), (None, None, "n" * 2000), (7, "x", long), (39, "again", long), (300, "z", "z" * 1000), (301, "z", "z" * 1000)]
    rows += [(400 + k, f"http://c/\r\nWARC-Type: x\n%0A%250D 日本 {chr(k)}", "\r\n\r\nWARC/1.1\r\n\r\n" + chr(k)) for k in range(1, 33)]
    return rows + [(500, " lead", "é" * 3_000_000), (501, "%", "é" * 3_000_000)]


@pytest.mark.parametrize("more", [{}, {"few": 0, "roll": 1}])
def test_warc_round_trip(spark, more):
    rows = _pages()
    df = spark.createDataFrame([(i, u, h, "theirs", "t") for i, u, h in rows], PAGES).repartition(3)
    root = work_path(spark, "warc")
    index = warc.write(df, root, **more)
    got = warc.read(index, root, payloads=True).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == _plain_warc(rows)
    assert sorted(map(str, [(r.page_id, r.url) for r in got])) == sorted(map(str, [(i, u) for i, u, _ in rows]))
    text = {i: (h or "").encode() for i, _, h in rows}
    assert all((r.payload is None) == (r.record_type == "revisit") and (r.payload is None or r.page_id is None or r.payload == text[r.page_id]) for r in got)
    # The index and the records say the same, and a selection reads no other records.
    same = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(str, index.select(same).collect())) == sorted(map(str, warc.read(index, root).select(same).collect()))
    some = index.where("page_id % 7 = 3")
    assert sorted(r.page_id for r in warc.read(some, root).collect()) == sorted(r.page_id for r in some.collect())
    assert warc.read(index.where("false"), root).count() == 0


def test_warc_of_no_pages(spark):
    assert warc.archive(spark.createDataFrame([], PAGES), work_path(spark, "warc")).count() == 0


def test_warc_files_are_archives_and_damage_is_seen(spark):
    root = work_path(spark, "warc")
    index = warc.write(spark.createDataFrame([(i, "u", f"page {i} " * 50, "", "") for i in range(50)], PAGES).coalesce(1), root)
    (path,) = Path(root.removeprefix("file://"), "archive").glob("*.warc.gz")
    with gzip.open(path) as f:
        whole = f.read()
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and whole.count(b"WARC-Type: response") == 50
    r = index.where("page_id = 9").first()
    data = bytearray(path.read_bytes())
    bad = warc.record(9, "u", b"page X " * 50, r.payload_digest)
    z = gzip.compress(bad, 5, mtime=0)
    path.write_bytes(data[:r.offset] + z + data[r.offset + r.length:])
    with pytest.raises(Exception, match="not what its digest says"):
        warc.read(index.where("page_id = 9").withColumn("length", F.lit(len(z)).cast("long")), root).collect()


def test_ranges_join_neighbours():
    got = list(warc.ranges([(0, 10), (10, 5), (30, 5), (2000, 5), (2005, 9000), (11005, 1)], gap=100, most=1000))
    assert [(a, b, len(p)) for a, b, p in got] == [(0, 35, 3), (2000, 2005, 1), (2005, 11005, 1), (11005, 11006, 1)]
    assert list(warc.ranges([])) == []
