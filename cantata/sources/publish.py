"""Files that appear whole under their name or not at all, on any file system that Spark reaches."""
import json
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


class Taken(RuntimeError):
    """The name is already in use."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset, a temporary one in local mode and an error on a cluster."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="cantata-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def work_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list:
    """Names of the files of a folder that are not empty; none for no folder."""
    fs, p = file_system(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.getLen()] if fs.exists(p) else []


def canonical(value) -> str:
    """One text for one value: keys sorted, no blanks, no numbers that JSON lacks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def publish(spark: SparkSession, path: str, value) -> None:
    """Write `value` as JSON to `path` in one step; raises Taken where the path exists.

    The text is written under a name of its own first. It gets its own name by a
    hard link on a local or mounted folder, by a rename that does not overwrite
    elsewhere; a writer that dies before that leaves nothing under the name.
    """
    text = canonical(value).encode()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, target = file_system(spark, path)
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent().getParent(), f"drafts/{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text))
    out.hsync()
    out.close()
    try:
        if fs.getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(target), local(draft))
        else:
            options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, options)
    except Exception as e:
        if fs.exists(target):
            raise Taken(path) from e
        raise
    finally:
        fs.delete(draft, False)


def read_json(spark: SparkSession, path: str, most: int = 64 << 20):
    """The value of a published file; an error beyond `most` bytes, before it is read."""
    fs, p = file_system(spark, path)
    if fs.getFileStatus(p).getLen() > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    return json.loads("\n".join(r.value for r in spark.read.text(path, lineSep="\n").collect()))
