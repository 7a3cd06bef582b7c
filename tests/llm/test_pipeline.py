"""Pipeline stages, and the chat digest, against brute force on rows with null, repeated and shared ids."""
import pytest
from pyspark.sql import SparkSession

import brute
import corpus_pipeline as cp
from cantata.llm import chat
from cantata.llm.common import work_path


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


LEAK = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
CLEAN = [f"{w} lies by the {w} river and {w} birds sing over {w} hills" for w in ("quiet", "broad", "stony", "golden")]
ROWS = [(1, CLEAN[0]), (1, CLEAN[0]), (2, CLEAN[0]), (None, CLEAN[0]), (3, CLEAN[1]), (3, f"{LEAK} and {CLEAN[2]}"), (None, LEAK), (None, CLEAN[3]), (4, None), (4, ""), (None, CLEAN[2]), (5, CLEAN[0] + "  ")]
TOXIC = "scum moron scum moron of the and to"


def _table(spark, rows, path):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn(cp.ROW, cp.F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def _pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def _one_each(groups, first=lambda t: 0):
    out = {}
    for i, t in ROWS:
        out.setdefault(groups(t), []).append((first(t), i is None, i or 0, i, t))
    return sorted((min(v, key=lambda x: x[:3])[3:] for v in out.values()), key=repr)


def test_stages_judge_each_row(spark):
    root = work_path(spark, "t")
    docs = _table(spark, ROWS, f"{root}/docs")
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    assert _pairs(cp.exact_copies(spark, docs, root)) == _one_each(lambda t: "".join((t or "").split()), lambda t: -len(t or ""))
    codes = {t: brute.simhash(t) for _, t in ROWS}
    names = list(codes)
    comp = brute.components({k: codes[t] for k, t in enumerate(names)})
    assert _pairs(cp.near_copies(spark, docs, root)) == _one_each(lambda t: comp[names.index(t)])
    assert _pairs(cp.benchmark_free(spark, docs, root)) == sorted(((i, t) for i, t in ROWS if LEAK not in (t or "")), key=repr)


def test_toxic_judges_each_row(spark):
    root = work_path(spark, "t")
    plain = "the and of to in it is on"
    fit = [(100 + i, TOXIC if i % 4 == 0 else plain) for i in range(200)]
    odd = [(None, TOXIC), (None, plain), (100, plain), (101, TOXIC), (2**62 + 1, plain)]
    docs = _table(spark, fit + odd, f"{root}/docs")
    spark.createDataFrame([(100 + i, int(i % 4 == 0)) for i in range(2, 200)], "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    got = cp.toxic(spark, docs, root)
    assert _pairs(got) == sorted(((i, t) for i, t in fit + odd if t == plain), key=repr)
    got.write.parquet(f"{root}/out")
    assert spark.read.parquet(f"{root}/out").select(cp.ROW).distinct().count() == got.count()


def test_chat_digest(spark):
    turns = [("user", "Hi <|im_end|> é"), ("assistant", "Yes\n"), ("user", ""), ("assistant", "No")]
    formatted = chat.format_chats(spark.createDataFrame([(1, i, *t) for i, t in reversed(list(enumerate(turns)))], "conv_id long, turn long, role string, text string"))
    got = chat.digest(formatted).first()
    loss = "".join(t for r, t in turns if r == "assistant")
    assert (got.conv_id, got.n_turns, got.loss_chars, got.formatted_chars) == (1, 4, len(loss), len(formatted.first().formatted))
    assert got.turns_sha256 == brute.sha("".join(f"{r}\n{t}\n" for r, t in turns)) and got.loss_sha256 == brute.sha(loss)


def _folder(spark, rows):
    root = work_path(spark, "t")
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row_key string").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_whole_pipeline_equals_its_stages_read_plainly(spark):
    rows = ROWS + [(6, CLEAN[1] + " once"), (7, "end " * 5000)]
    keep = {}
    for n, (i, t) in enumerate(rows):  # exact copies: the longest, then the smallest id
        keep.setdefault("".join((t or "").split()), []).append((-len(t or ""), i is None, i or 0, n))
    left = [rows[min(v)[3]] for v in keep.values()]
    codes = {k: brute.simhash(t) for k, (_, t) in enumerate(left)}
    groups = {}
    for k, root in brute.components(codes).items():
        groups.setdefault(root, []).append((left[k][0] is None, left[k][0] or 0, k))
    left = [left[min(v)[2]] for v in groups.values()]
    left = [(i, t) for i, t in left if not brute.leaks(t, [(1, brute.words(LEAK))])[4]]
    got = cp.run(spark, _folder(spark, rows)).toPandas()
    assert sorted(map(repr, (None if i != i else int(i) for i in got[got.piece == 0].doc_id))) == sorted(repr(i) for i, _ in left)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.offset.to_numpy() == g.length.cumsum().shift(fill_value=0).to_numpy()).all()
    assert len({r for r in got[got.doc_id == 7].piece}) == -(-got[got.doc_id == 7].length.sum() // 2048)


def test_pipeline_of_no_documents(spark):
    assert cp.run(spark, _folder(spark, [])).count() == 0
