"""Exact dedup: group by 128-bit content hash, keep one row, compare bytes inside groups."""
from pyspark.sql import DataFrame, functions as F

from .common import bits_to_salts, checkpoint, salt_bits, salt_of, text_col

#: Space and the five ASCII control blanks.
BLANKS = r"[\x20\x09-\x0D]+"
_TOP = "9223372036854775807"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", col: str = "text") -> DataFrame:
    """Return doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Null text counts as empty. A null id ranks after all others and is kept
    only where the whole group has no id. Rows that repeat an id and its text
    are each returned, each counted, and share one verdict. An empty table
    gives an empty result; extra columns are not read.

    Groups form on (md5, text), so two texts with one hash stay apart and the
    bytes are compared by the aggregation itself; copies combine before the
    shuffle. The way back is a join on (md5, salt): a group of any size is
    spread over its salts, and has at most as many salts as rows.
    """
    n = F.regexp_replace(text_col(col), BLANKS, "")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), n.alias("_t"), F.length(text_col(col)).alias("_n")
    ).select(
        "doc_id", "_t", F.md5("_t").alias("_h"), salt_of(F.col("doc_id")).alias("_s"),
        F.expr(f"_n * 100000000000000000000BD + (coalesce({_TOP} - cast(doc_id as decimal(20,0)), -1))").cast("decimal(38,0)").alias("_rank"),
    )
    groups = rows.groupBy("_h", "_t").agg(
        F.count("*").alias("group_size"), F.max("_rank").alias("_best"), salt_bits("_s").alias("_bits")
    )
    # No text past this point: its 256-bit digest and length stand for it.
    best = F.expr("_best - floor((_best + 1) / 100000000000000000000BD) * 100000000000000000000BD").cast("decimal(38,0)")
    groups = groups.select(
        "_h", F.sha2("_t", 256).alias("text_sha256"), "group_size", "_bits",
        F.when(best >= 0, F.expr(_TOP) .cast("decimal(38,0)") - best).cast("long").alias("keep_id"),
    )
    groups = checkpoint(groups)
    clash = groups.groupBy("_h").count().where("count > 1").limit(1).count() > 0
    groups = groups.withColumn("_s", bits_to_salts("_bits")).drop("_bits")
    keys = ["_h", "_s"]
    rows = rows.select("doc_id", *keys, *([F.sha2("_t", 256).alias("text_sha256")] if clash else []))
    if clash:
        keys.append("text_sha256")
    out = rows.join(groups, keys)
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
