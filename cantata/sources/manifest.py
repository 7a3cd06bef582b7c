"""Data sets of files under a manifest: each file is read once and held against its digest."""
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .publish import file_system

#: Bytes of a file beyond which it is not read (a row holds a file, and a row ends at 2 GB).
MOST = 1 << 30


def scan(spark: SparkSession, root: str, most: int = MOST) -> DataFrame:
    """(path, bytes, sha256) of all files under root, paths relative to it; no digest beyond `most` bytes, and no byte of such a file is read. Spark's scan passes over empty files, and so does this."""
    fs, p = file_system(spark, root)
    top = fs.makeQualified(p).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.expr(f"substring(path, {len(top) + 2})"), "%20", " ")
    read = files.where(F.col("length") <= most).select(path.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return read.unionByName(files.where(F.col("length") > most).select(path.alias("path"), F.col("length").alias("bytes"), F.lit(None).cast("string").alias("sha256")))


def verify(samples: DataFrame, root: str, most: int = MOST) -> DataFrame:
    """The samples (id, split, source_group, path, sha256) with bytes and status.

    The first fault of a sample counts: `invalid` (no id, split other than
    development and holdout, digest of no such form), `duplicate_id`, `unsafe_path`
    (absolute, a drive, or with a part `..`), `missing` (or empty), `too_large`, `altered`,
    `group_in_both_splits`, `content_in_both_splits`; else `ok`. Files that no
    sample names are not judged. Digests are made where the files are read.
    """
    spark = samples.sparkSession
    files = scan(spark, root, most).withColumnRenamed("sha256", "_found")
    both = lambda c: F.min("split").over(Window.partitionBy(c)) != F.max("split").over(Window.partitionBy(c))
    s = samples.join(files, "path", "left").withColumns({
        "_many": F.count(F.lit(1)).over(Window.partitionBy("id")), "_group": F.col("source_group").isNotNull() & both("source_group"), "_content": F.col("_found").isNotNull() & both("_found"),
    })
    form = F.col("id").isNotNull() & (F.trim("id") != "") & F.col("split").isin("development", "holdout") & F.col("sha256").rlike("^[0-9a-f]{64}$")
    unsafe = F.col("path").isNull() | F.col("path").rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")
    status = (
        F.when(~F.coalesce(form, F.lit(False)), "invalid").when(F.col("_many") > 1, "duplicate_id").when(unsafe, "unsafe_path").when(F.col("bytes").isNull(), "missing")
        .when(F.col("_found").isNull(), "too_large").when(F.col("_found") != F.col("sha256"), "altered").when(F.col("_group"), "group_in_both_splits").when(F.col("_content"), "content_in_both_splits").otherwise("ok")
    )
    return s.select(*samples.columns, "bytes", status.alias("status"))


def summary(verified: DataFrame) -> DataFrame:
    """(split, samples, faults, bytes) and under a null split the whole."""
    return verified.rollup("split").agg(F.count(F.lit(1)).alias("samples"), F.count(F.when(F.col("status") != "ok", 1)).alias("faults"), F.sum("bytes").alias("bytes"))
