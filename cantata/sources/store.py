"""A versioned store of songs: several tables under one commit marker, saved by copy on write.

A store is a folder. data/<table>/<run>/_bucket=<b>/ holds the rows of one bucket as one
run wrote them; versions/<n> is the commit marker of version n: for each table its
schema, and for each bucket its run, rows and digest. Only what a marker names is read,
so a version is there as a whole or not at all, and writers that die leave nothing behind
that a reader sees. The marker's size hangs on tables and buckets, not on songs.
"""
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .publish import Taken, file_system, names, publish, read_json

#: The table that holds one row for each song, with its generation.
SONGS = "song"


class Damaged(RuntimeError):
    """Rows are not those that the marker names."""


def bucket(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def digests(rows: DataFrame) -> dict:
    """{bucket: (rows, digest)} of rows with a column `_bucket`; order does not count, repeated rows do."""
    cols = [F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in sorted(rows.columns) if c != "_bucket"]
    found = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).cast("string").alias("d"))
    return {r["_bucket"]: (r.n, r.d) for r in found.collect()}  # one row for each bucket


def latest(spark: SparkSession, root: str) -> int:
    return max((int(n) for n in names(spark, f"{root}/versions") if n.isdigit()), default=0)


def marker(spark: SparkSession, root: str, version: int) -> dict:
    if not version:
        raise FileNotFoundError(f"{root} has no version")
    return read_json(spark, f"{root}/versions/{version:08d}")


def _write(rows: DataFrame, root: str, table: str, key: str, buckets: int) -> dict:
    """Write rows as one run and prove that they read back: {bucket: part of the marker}."""
    run = uuid.uuid4().hex
    dealt = rows.withColumn("_bucket", bucket(F.col(key), buckets))
    dealt.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{root}/data/{table}/{run}")
    spark = rows.sparkSession
    fs, p = file_system(spark, f"{root}/data/{table}/{run}")
    full = any(s.isDirectory() for s in fs.listStatus(p))
    back = digests(spark.read.schema(dealt.schema).parquet(f"{root}/data/{table}/{run}")) if full else {}
    if back != digests(dealt):
        raise Damaged(f"{table} does not read back as it was written")
    return {str(b): {"run": run, "rows": n, "digest": d} for b, (n, d) in back.items()}


def save(spark: SparkSession, root: str, tables: dict, key: str = "song_id", buckets: int = 64) -> int:
    """Write whole tables (name to DataFrame, each with `key`) as the next version and return it.

    Rows are kept as they are, nulls and repeats included; a table may be empty.
    Raises Taken if another writer was first. A null key is a key like others.
    """
    v = latest(spark, root) + 1
    parts = {t: {"schema": df.schema.json(), "buckets": _write(df, root, t, key, buckets)} for t, df in tables.items()}
    publish(spark, f"{root}/versions/{v:08d}", {"version": v, "key": key, "buckets": buckets, "tables": parts})
    return v


def _rows(spark, root, mark, table, only=None) -> DataFrame:
    t = mark["tables"][table]
    schema = StructType.fromJson(json.loads(t["schema"]))
    paths = [f"{root}/data/{table}/{x['run']}/_bucket={b}" for b, x in sorted(t["buckets"].items()) if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def load(spark: SparkSession, root: str, version: int | None = None, verify: bool = False) -> dict:
    """The tables of a version (the newest by default), a snapshot that later saves do not change.

    With `verify` every row is read and held against the marker first; Damaged
    where rows are missing, changed or too many. A store without a marker is
    refused, however much of it has been written.
    """
    mark = marker(spark, root, version or latest(spark, root))
    out = {t: _rows(spark, root, mark, t) for t in mark["tables"]}
    if verify:
        for t, df in out.items():
            want = {int(b): (x["rows"], x["digest"]) for b, x in mark["tables"][t]["buckets"].items()}
            try:
                found = digests(df.withColumn("_bucket", bucket(F.col(mark["key"]), mark["buckets"])))
            except Exception as e:
                raise Damaged(f"{t} cannot be read") from e
            if found != want:
                raise Damaged(f"{t} differs from its marker")
    return out


def edit(spark: SparkSession, root: str, commands: DataFrame, changed: dict, tries: int = 20) -> DataFrame:
    """Replace songs where their generation is still what the command was made for: (key, outcome, generation).

    commands: key, base_generation, one row for each song. changed: table name
    to the rows that take the place of the song's rows there. Outcomes are
    `saved` (the generation is one more), `conflict` (with the generation that
    the song has) and `not_found`; a song is changed in all its tables or in
    none. Only buckets with saved songs are written. Songs of other writers that
    publish meanwhile are kept, and generations are judged again on top of them.
    """
    first = marker(spark, root, latest(spark, root))
    key, buckets = first["key"], first["buckets"]
    if commands.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("a song has several commands")
    for _ in range(tries):
        v = latest(spark, root)
        mark = marker(spark, root, v)
        touched = {r[0] for r in commands.select(bucket(F.col(key), buckets)).distinct().collect()}  # as many as buckets at most
        now = _rows(spark, root, mark, SONGS, touched).select(key, F.col("generation").alias("_now"))
        judged = commands.join(now, key, "left").withColumn("outcome", F.when(F.col("_now").isNull(), "not_found").when(F.col("_now") == F.col("base_generation"), "saved").otherwise("conflict"))
        path = f"{root}/outcomes/{uuid.uuid4().hex}"
        judged.select(key, "outcome", (F.col("_now") + F.when(F.col("outcome") == "saved", 1).otherwise(0)).alias("generation")).write.parquet(path)
        outcome = spark.read.parquet(path)
        saved = outcome.where("outcome = 'saved'").select(key)
        touched = {r[0] for r in saved.select(bucket(F.col(key), buckets)).distinct().collect()}
        if not touched:
            return outcome
        tables = {t: dict(x) for t, x in mark["tables"].items()}
        for t in tables:
            if t not in changed and t != SONGS:
                continue
            old = _rows(spark, root, mark, t, touched)
            kept = old.join(saved, key, "left_anti")
            new = (changed[t] if t in changed else old).join(saved, key, "left_semi")
            if t == SONGS:  # a song that is saved stays, with its own row where none is given
                new = new.drop("generation").unionByName(old.drop("generation").join(saved, key, "left_semi").join(new.select(key), key, "left_anti"))
                new = new.join(outcome.select(key, "generation"), key)
            run = _write(kept.unionByName(new.select(old.columns)).select(old.columns), root, t, key, buckets)
            rest = {b: x for b, x in tables[t]["buckets"].items() if int(b) not in touched}
            tables[t]["buckets"] = rest | run
        try:
            publish(spark, f"{root}/versions/{v + 1:08d}", {**mark, "version": v + 1, "tables": tables})
            return outcome
        except Taken:
            continue
    raise RuntimeError(f"{tries} other writers were first")
