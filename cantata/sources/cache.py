"""Results kept by the digest of what they were made from."""
import hashlib
import uuid

from pyspark.sql import DataFrame, functions as F

from .publish import canonical, names, publish


def cache_key(identity: dict, *columns):
    """The key of a row: a digest of the identity (pipeline, model, options) and of the row's inputs."""
    mine = hashlib.sha256(canonical(identity).encode()).hexdigest()
    return F.sha2(F.concat(F.lit(mine), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})), 256)


def _seal(df: DataFrame):
    """A digest over all columns of a row in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)


def cached(inputs: DataFrame, columns: list, identity: dict, compute, root: str) -> DataFrame:
    """compute(rows) for each distinct row of `columns` of inputs, kept under root; returns inputs with the results and `_source` (hit, computed).

    compute takes a DataFrame of cache_key and `columns` and returns cache_key
    and results, one row for each key. What an earlier call has kept for the same identity
    is not made again, and where nothing is missing compute is not called. A
    kept row whose seal does not fit counts as missing. Runs become visible by
    one file each, after all their rows are there.
    """
    spark = inputs.sparkSession
    home = f"{root}/{hashlib.sha256(canonical(identity).encode()).hexdigest()}"
    keyed = inputs.withColumn("cache_key", cache_key(identity, *columns))
    runs = sorted(n for n in names(spark, f"{home}/runs"))
    kept = None
    if runs:
        kept = spark.read.parquet(*[f"{home}/data/{n}" for n in runs])
        kept = kept.where(F.col("_seal") == _seal(kept.drop("_seal"))).drop("_seal").dropDuplicates(["cache_key"])
    wanted = keyed.select("cache_key", *columns).dropDuplicates(["cache_key"])
    missing = wanted.join(kept.select("cache_key"), "cache_key", "left_anti") if kept is not None else wanted
    fresh = None
    if not missing.isEmpty():
        run = uuid.uuid4().hex
        made = compute(missing)
        made.withColumn("_seal", _seal(made)).write.parquet(f"{home}/data/{run}")
        publish(spark, f"{home}/runs/{run}", {"identity": identity})
        fresh = spark.read.parquet(f"{home}/data/{run}").drop("_seal")
    parts = [x.withColumn("_source", F.lit(s)) for x, s in ((kept, "hit"), (fresh, "computed")) if x is not None]
    if not parts:
        return keyed.drop("cache_key").withColumn("_source", F.lit("hit")).where("false")
    results = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if len(parts) == 2:  # a kept row with a broken seal is not among the kept, so keys do not meet
        results = results.dropDuplicates(["cache_key"])
    return keyed.join(results, "cache_key", "left").drop("cache_key")
