"""The corpus pipeline: each stage's rows are written and read again as the next one's documents."""
from pyspark.sql import functions as F

from cantata.llm import decontam, exact, packing, simhash, toxicity
from cantata.llm.common import work_path
from cantata.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Names each row: written by the first stage, carried by the others, so that each row is judged by its own text.
ROW = "row_key"


def toxic(spark, docs, sf_dir):
    """Documents that the classifier accepts; the labels are those of sf_dir."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs.select(COLUMNS), model).withColumn(ROW, F.monotonically_increasing_id())


def exact_copies(spark, docs, sf_dir):
    """One document of each group of equal texts: the longest as written, then the smallest id."""
    return _one_each(docs, exact.exact_dedup(docs, ROW).select(F.col("doc_id").alias(ROW), F.col("keep_id").alias("group")), -F.length("text"))


def near_copies(spark, docs, sf_dir):
    """The document with the smallest id of each SimHash component."""
    return _one_each(docs, simhash.near_duplicates(docs, ROW).select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group")), F.lit(0))


def benchmark_free(spark, docs, sf_dir):
    """Documents that hold no benchmark window."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = decontam.decontaminate(docs, bench, ROW).where("not contaminated").select(F.col("doc_id").alias(ROW))
    return docs.join(clean, ROW, "left_semi").select(*COLUMNS, ROW)


def packed(spark, docs, sf_dir):
    """The pieces of the documents with their places in sequences. Null and empty texts are one piece of the end id alone, rows that repeat are packed as often as they stand, and no documents give no pieces."""
    return packing.pack(docs, vocabulary())


def _one_each(docs, groups, first):
    """The first row of each group by `first`, then by id, null ids last; of equal rows one."""
    order = F.struct(F.coalesce(first, F.lit(0)).alias("a"), F.col("doc_id").isNull().alias("b"), "doc_id", ROW)
    best = docs.select(ROW, order.alias("o")).join(groups, ROW).groupBy("group").agg(F.min("o").alias("o"))
    return docs.join(best.select(f"o.{ROW}"), ROW, "left_semi").select(*COLUMNS, ROW)


STAGES = [("toxicity", toxic), ("exact_dedup", exact_copies), ("simhash", near_copies), ("decontamination", benchmark_free), ("packing", packed)]
#: Scores, fingerprints and packing are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The pieces of the documents that the stages keep, each stage written and read again.

    Each row is judged by its own text under a key of its own, so null and
    repeated ids are no hindrance; a null text is empty. Columns beside those of
    documents are dropped by the first stage. An empty table gives an empty
    result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = work_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
