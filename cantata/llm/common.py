"""Helpers shared by the training-data operators."""
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset, a temporary one in local mode and an error on a cluster."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="cantata-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(d)
    return d


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def work_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def text_col(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c):
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def salt_of(c):
    """A salt of 0..SALTS-1 per row; null hashes like any other value."""
    return F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")


def salt_bits(salt):
    """Aggregate: the set of salts seen in a group, as a bitmap of fixed size."""
    return F.bit_or(F.expr(f"shiftleft(1L, {salt})"))


def bits_to_salts(bits):
    """One row per salt in a bitmap; never more rows than the group has members."""
    return F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), i -> getbit({bits}, i) = 1)"))


#: Elements in a block of a fold: aggregate() copies its whole state at each step, so a state must stay small.
STEP = 128


def _once(column, body):
    """body(column), with the column computed once for all its uses."""
    return F.element_at(F.transform(F.array(column), body), 1)


def _blocks(values):
    """An array cut into arrays of STEP elements."""

    def cut_up(v):
        # Not by slice(), which copies the whole array for each block.
        last = F.greatest(F.lit(0), F.size(v) - 1).cast("int")
        block = lambda i: F.transform(F.sequence(i, F.least(last, i + (STEP - 1))), lambda k: F.get(v, k))
        return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), last, F.lit(STEP)), block)).otherwise(F.array())

    return _once(values, cut_up)


def _total(values):
    return F.aggregate(values, F.lit(0), lambda x, y: x + y)


def fold(values, start, step):
    """The int state of a fold before each block of an array, as array of (b, p): block and state."""
    first = F.struct(start.alias("p"), F.array().cast("array<int>").alias("o"))

    def each(v):
        carry = F.aggregate(v, first, lambda a, b: F.struct(step(a["p"], b).alias("p"), F.concat(a["o"], F.array(a["p"])).alias("o")), lambda a: a["o"])
        return F.zip_with(v, carry, lambda b, p: F.struct(b.alias("b"), p.alias("p")))

    return _once(_blocks(values), each)


def running(lengths):
    """The total of the elements before each element of an array<int>."""

    def inside(x):
        first = F.struct(x["p"].alias("p"), F.array().cast("array<int>").alias("o"))
        return F.aggregate(x["b"], first, lambda a, n: F.struct((a["p"] + n).alias("p"), F.concat(a["o"], F.array(a["p"])).alias("o")), lambda a: a["o"])

    return F.flatten(F.transform(fold(lengths, F.lit(0), lambda p, b: p + _total(b)), inside))


def cut(text, lengths):
    """A text cut into consecutive pieces of the given lengths (array<int>): into blocks of pieces first, so that no piece is looked for from the start of a long text."""

    def pieces(t, v):
        return F.transform(F.arrays_zip(running(v).alias("s"), v.alias("n")), lambda x: F.substring(t, x["s"] + 1, x["n"]))

    def both(x):
        blocks = _blocks(x["v"])
        parts = F.arrays_zip(blocks.alias("v"), pieces(x["t"], F.transform(blocks, _total)).alias("t"))
        return _once(parts, lambda z: F.flatten(F.transform(z, lambda y: pieces(y["t"], y["v"]))))

    return _once(F.struct(text.alias("t"), lengths.alias("v")), both)
