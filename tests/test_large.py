"""What larger tables showed: rows that the small tables do not hold, against the SQL."""
import duckdb
import pytest
from pyspark.sql import SparkSession

from cantata import registry


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", 3).config("spark.ui.enabled", False).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _both(spark, folder, name, tables):
    c = duckdb.connect()
    for t, sql in tables.items():
        c.sql(f"copy ({sql}) to '{folder}/{t}.parquet'")
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = registry.queries()[name](spark, str(folder))
    want = c.sql(f"select {', '.join(got.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


_LINE = "select {order} as l_orderkey, {part} as l_partkey, 1 as l_suppkey, {number}::int as l_linenumber, {quantity}::double as l_quantity, {price}::double as l_extendedprice, {discount}::double as l_discount, 0.02::double as l_tax from {rows}"


def test_bytes_of_assets_are_rounded(spark, tmp_path):
    rows = "(values (1, 95000.4), (2, 95000.5), (3, 95000.51), (4, 95001.5), (5, 94999.5)) t(o, p)"
    got, want = _both(spark, tmp_path, "asset_checks", {"lineitem": _LINE.format(order="o", part="1", number="1", quantity="10", price="p", discount="0.05", rows=rows)})
    assert got == want and {r[0]: r[1] for r in got} == {1: "ok", 2: "ok", 3: "digest_or_size", 4: "digest_or_size", 5: "ok"}


def test_sources_as_near_to_six_places_are_ties(spark, tmp_path):
    # The last note's middle is mapped to 16200 + 2e-12, half-way between two notes.
    held = [29, 49, 6, 37, 4, 1, 40, 27, 26, 24]
    rows = f"(values {', '.join(f'({i}, {q})' for i, q in enumerate(held))}) t(i, q)"
    got, want = _both(spark, tmp_path, "repetition_priors", {"lineitem": _LINE.format(order="1", part="i", number="i", quantity="q", price="i", discount="0.05", rows=rows)})
    assert got == want and len(got) > 1


def test_characters_are_never_broadcast(spark):
    from cantata.plans import texts

    plan = texts.reference_timeline(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_characters_leave_a_task_in_small_batches(spark):
    import resource

    import pyarrow as pa
    from pyspark.sql import functions as F

    from cantata.operators import alignment

    said = "ab c" * 700
    texts = spark.range(0, 1500, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit(said), F.col("id").cast("string"))).alias("text"))
    out = alignment.normalised(texts, "id").select("id", F.size("chars").alias("n"), F.array_join(F.transform(F.slice("chars", 2101, 9), lambda c: c["char"]), "").alias("last"))
    got = {r.id: (r.n, r.last) for r in out.collect()}
    assert got == {i: (2100 + len(str(i)), str(i)) if i % 7 else (0, "") for i in range(1500)}
    # The worker that made them is taken up again.
    seen = spark.range(0, 1, 1, 1).mapInArrow(lambda batches: [pa.RecordBatch.from_pydict({"kb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss for _ in list(batches)[:1]]})], "kb long").collect()
    assert seen[0].kb < 400_000
