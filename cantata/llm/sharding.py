"""Sharding: size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder: data/<run>/part-* are shards, manifest/<name> are tables of
(shard, bytes), and versions/<n> is a file with the name of version n's table. It is
written as a draft and gets its name in one step, so of racing writers one publishes n.
"""
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Bytes of a compacted shard, the ratio between size tiers, and shards merged by one job.
TARGET, RATIO, PER_JOB = 32 << 20, 4, 10000
_SHARDS = "shard string, bytes long"


class Taken(RuntimeError):
    """Another writer has published the version."""


def _fs(spark, path):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _versions(spark, root):
    """(number, whether it names a manifest) of the files of versions/. A file is published whole, so an empty one is nobody's work in progress."""
    fs, p = _fs(spark, f"{root}/versions")
    found = [(s.getPath().getName(), s.getLen() > 0) for s in fs.listStatus(p)] if fs.exists(p) else []
    return [(int(n), full) for n, full in found if n.isdigit()]


def latest(spark: SparkSession, root: str) -> int:
    """The newest published version; 0 for a new store."""
    return max((n for n, full in _versions(spark, root) if full), default=0)


def manifest(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The shards of a version (shard, bytes); none for version 0."""
    if not version:
        return spark.createDataFrame([], _SHARDS)
    name = spark.read.text(f"{root}/versions/{version:08d}").first().value
    return spark.read.schema(_SHARDS).parquet(f"{root}/manifest/{name}")


def _publish(spark, source: str, target: str) -> None:
    """Give the file `source` the name `target` in one step, or raise Taken where that name exists: a hard link on a local or mounted folder, a rename that does not overwrite elsewhere."""
    jvm = spark.sparkContext._jvm
    fs, p = _fs(spark, target)
    src = jvm.org.apache.hadoop.fs.Path(source)
    try:
        if fs.getScheme() == "file":
            path = lambda x: jvm.java.io.File(x.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(path(p), path(src))
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            context.rename(src, p, none)
    except Exception as e:
        if fs.exists(p):
            raise Taken(f"{target} is already published") from e
        raise


def commit(spark: SparkSession, root: str, version: int, shards: DataFrame) -> int:
    """Publish `version`; raises Taken if another writer has published it.

    The file is written under a name of its own first, so a writer that dies at
    any point leaves no version. Tables of losers stay unreferenced.
    """
    name = f"m-{uuid.uuid4().hex}"
    shards.coalesce(1).write.parquet(f"{root}/manifest/{name}")
    fs, draft = _fs(spark, f"{root}/drafts/{name}")
    fs.mkdirs(_fs(spark, f"{root}/versions")[1])
    out = fs.create(draft, False)
    out.write(bytearray(f"{name}\n".encode()))
    out.close()
    _publish(spark, f"{root}/drafts/{name}", f"{root}/versions/{version:08d}")
    return version


def _published(spark, root, change, tries: int = 100):
    """Publish change(newest shards) behind all numbers in use, again on top of the winner where another writer was first."""
    for _ in range(tries):
        used = _versions(spark, root)
        v = max((n for n, full in used if full), default=0)
        try:
            return commit(spark, root, max((n for n, _ in used), default=0) + 1, change(v))
        except Taken:
            continue
    raise RuntimeError(f"{tries} other writers were first")


def _write(rows: DataFrame, root: str, kind: str) -> DataFrame:
    """Write rows as one run of shards and list them: one row per file, its size from the scan's own metadata."""
    run = f"{kind}-{uuid.uuid4().hex}"
    rows.write.mode("errorifexists").parquet(f"{root}/data/{run}")
    fs, p = _fs(rows.sparkSession, f"{root}/data/{run}")
    found = [(f"data/{run}/{s.getPath().getName()}", s.getLen()) for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")]
    return rows.sparkSession.createDataFrame(found, _SHARDS)


def append(rows: DataFrame, root: str) -> int:
    """Write arrivals as a run of small immutable shards beside those of the newest version; returns the version that holds them."""
    spark = rows.sparkSession
    new = _write(rows, root, "arrivals")
    return _published(spark, root, lambda v: manifest(spark, root, v).unionByName(new))


def runs(shards: DataFrame, target: int = TARGET, ratio: int = RATIO) -> DataFrame:
    """Shards below the target with their tier and their run within it: neighbours by size whose bytes fill about one target.

    Tier t holds sizes over target / ratio^(t+1). A run of one shard has nothing to be merged with.
    """
    tier = F.floor(F.log(F.lit(float(target)) / F.greatest(F.col("bytes"), F.lit(1))) / F.log(F.lit(float(ratio)))).cast("int")
    order = Window.partitionBy("tier").orderBy(F.col("bytes").desc(), "shard")
    before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = shards.where(F.col("bytes") < target).withColumn("tier", tier).withColumn("run", F.floor(before / F.lit(target)))
    return dealt.withColumn("many", F.count("*").over(Window.partitionBy("tier", "run"))).where("many > 1").select("shard", "bytes", "tier", "run")


def compact(spark: SparkSession, root: str, target: int = TARGET, ratio: int = RATIO) -> int:
    """Merge runs of similar size into files of about the target and publish; returns the version, the same one where nothing is to be merged.

    Whole shards move, without a shuffle; sources stay for readers of older
    versions. If another writer published meanwhile, its arrivals stay beside
    the merged shards; if it took a source away, the merge is given up.
    """
    v = latest(spark, root)
    groups = runs(manifest(spark, root, v), target, ratio).groupBy("tier", "run").agg(F.collect_list("shard").alias("shards"), F.count("*").alias("n")).orderBy("tier", "run")
    gone, made, job = [], [], []

    def merge():
        paths = [f"{root}/{s}" for g in job for s in g]
        made.append(_write(spark.read.parquet(*paths).coalesce(len(job)), root, "merged"))
        gone.extend(s for g in job for s in g)
        job.clear()

    for r in groups.toLocalIterator():
        job.append(r.shards)
        if sum(map(len, job)) >= PER_JOB:
            merge()
    if job:
        merge()
    if not made:
        return v
    old = spark.createDataFrame([(s,) for s in gone], "shard string")

    def change(now):
        shards = manifest(spark, root, now)
        if now != v and shards.join(old, "shard", "left_semi").count() < len(gone):
            raise RuntimeError("another compaction has merged these shards")
        out = shards.join(old, "shard", "left_anti")
        for m in made:
            out = out.unionByName(m)
        return out

    return _published(spark, root, change)


def read(spark: SparkSession, root: str, version: int | None = None, name: str = "shard") -> DataFrame:
    """Rows of a version (the newest by default) with the name of their shard in column `name`, to which "_" is added where the rows have such a column."""
    shards = manifest(spark, root, version or latest(spark, root))
    paths = [f"{root}/{r.shard}" for r in shards.select("shard").toLocalIterator()]
    rows = spark.read.parquet(*paths)
    while name in rows.columns:
        name += "_"
    return rows.withColumn(name, F.regexp_extract(F.input_file_name(), r"(data/[^/]+/[^/]+)$", 1))


def shard(docs: DataFrame, root: str, target: int = TARGET) -> DataFrame:
    """Append docs to the store at root, compact, and return the rows of the newest version with their shard.

    Every row lands in one shard as it is: nulls, empty and very long texts,
    repeats and extra columns included. No rows make one empty shard.
    """
    append(docs, root)
    return read(docs.sparkSession, root, compact(docs.sparkSession, root, target))
