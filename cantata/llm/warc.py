"""WARC archives: pages become records with an index, and reads go through the index by byte ranges.

An archive is a file of gzip members, one for each record, so a record can be read
by its range alone. The index (one row per record: file, offset, length, url, digest)
is what Spark commits: files of failed tasks are in no index and are never read.
"""
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import bits_to_salts, checkpoint, salt_bits, salt_of

#: Smaller payloads are always written in full.
LEAST = 1000
#: Bytes from which an archive is closed and the next one begun.
ROLL = 1 << 30
#: Ranges no further apart than GAP are read in one go, of RANGE bytes at most unless one record is longer.
GAP, RANGE = 64 << 10, 8 << 20
#: Up to so many groups of copies go along with the plan (two digests and an id each, some 40 MB in all); more are joined by a shuffle.
FEW = 200_000
#: Bytes of records that one reading task takes.
TASK = 64 << 20

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _files(root: str):
    """The file system of a URI and the path within it, on whatever machine this runs."""
    uri = re.sub(r"^s3[an]://", "s3://", root if "://" in root else f"file://{root}")
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _line(value: str) -> str:
    """A header value on one line: control characters are percent-encoded, and so is the sign itself where it would read as one."""
    return re.sub(r"[\x00-\x1f\x7f]|%(?=[01][0-9A-F]|7F|25)", lambda m: f"%{ord(m.group()):02X}", value)


def record(page_id, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One record. A revisit keeps the HTTP head, with the length of the payload, and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict:
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}


def _id(name: str):
    digits = name[len("<urn:page:"):-1]
    return int(digits) if digits else None


def parse(raw: bytes):
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload or None) of one record; an error where its parts disagree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    f = _fields(head)
    size = int(f["content-length"])
    block = rest[:size]
    if not head.startswith(b"WARC/1.") or len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    http, _, body = block.partition(b"\r\n\r\n")
    digest, n = f["warc-payload-digest"].removeprefix("sha1:"), int(_fields(http)["content-length"])
    revisit = f["warc-type"] == "revisit"
    if not revisit and (len(body) != n or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"the payload of {f['warc-record-id']} is not what its digest says")
    url = f.get("warc-target-uri")
    url = None if url is None else re.sub(r"%([01][0-9A-F]|7F|25(?=[01][0-9A-F]|7F|25))", lambda m: chr(int(m.group(1), 16)), url)
    return _id(f["warc-record-id"]), url, n, digest, f["warc-type"], _id(f["warc-refers-to"]) if revisit else None, None if revisit else body


class _Archive:
    """The archive that a task is writing."""

    def __init__(self, root: str):
        self.fs, path = _files(root)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        # The name is the attempt's own, so that a task that runs twice does not write into its other run's file.
        self.name = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
        self.out, self.at = self.fs.open_output_stream(f"{path}/{self.name}", compression=None), 0
        info = b"software: cantata\r\nformat: WARC file version 1.1\r\n"
        self.add(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (str(uuid.uuid4()).encode(), len(info), info))

    def add(self, raw: bytes):
        """Append a record; returns its offset and length."""
        z = gzip.compress(raw, 5, mtime=0)
        self.out.write(z)
        at, self.at = self.at, self.at + len(z)
        return at, len(z)


def _writing(root: str, roll: int):
    names = [x.split()[0] for x in INDEX.split(", ")]
    schema = pa.schema([(n, pa.string() if n in ("url", "file", "payload_digest", "record_type") else pa.int64()) for n in names])

    def run(batches):
        a = None
        try:
            for b in batches:
                rows = []
                for page_id, url, html, digest, top in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "top"))):
                    payload = html or b""
                    revisit = top is not None and top != page_id
                    refers_to = top if revisit else None
                    if a is None or a.at >= roll:
                        if a:
                            a.out.close()
                        a = _Archive(root)
                    at, n = a.add(record(page_id, url, payload, digest, refers_to, revisit))
                    rows.append((page_id, url, a.name, at, n, digest, len(payload), "revisit" if revisit else "response", refers_to))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(names), schema)], schema=schema)
        finally:
            if a:
                a.out.close()

    return run


def copies(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(payload_digest, sha, top, bits): payloads of `least` bytes or more that stand under several ids, the largest id, and the salts of their rows.

    Copies combine before the shuffle, so a payload of any number of copies is one row of each task.
    """
    long = rows.where(F.octet_length("html") >= least)
    g = long.groupBy("payload_digest", "sha").agg(F.max("page_id").alias("top"), F.min("page_id").alias("low"), F.count("*").alias("n"), F.count("page_id").alias("known"), salt_bits("salt").alias("bits"))
    return g.where("top <> low or (known > 0 and known < n)").drop("low", "n", "known")


def write(pages: DataFrame, root: str, least: int = LEAST, roll: int = ROLL, few: int = FEW) -> DataFrame:
    """Write the archives and the index of pages (page_id, url, html) under root; returns the index.

    Null html is an empty payload. Of equal payloads of `least` bytes or more
    the largest page_id is written as response, rows under other ids revisit
    it; a null id is smaller than any other. Rows that repeat the id of the
    response are responses too. An empty table gives archives and an index of
    no records; columns beside the three are not read. Payloads are told apart
    by SHA-1 and SHA-256 together.

    Pages do not move: each task archives what it reads. The groups of copies go
    along with the plan while they are few; beyond that they meet the pages by a
    shuffle on digest and salt, in which a hot payload is spread over its salts.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"payload_digest": F.sha1("html"), "sha": F.sha2("html", 256), "salt": salt_of(F.concat_ws(" ", "page_id", "url"))})
    same = checkpoint(copies(rows, least))
    if same.count() <= few:
        out = rows.join(F.broadcast(same.drop("bits")), ["payload_digest", "sha"], "left")
    else:
        out = rows.join(same.withColumn("salt", bits_to_salts("bits")).drop("bits"), ["payload_digest", "sha", "salt"], "left")
    fs, path = _files(f"{root}/archive")
    fs.create_dir(path, recursive=True)
    out.select("page_id", "url", "html", "payload_digest", "top").mapInArrow(_writing(f"{root}/archive", roll), INDEX).write.parquet(f"{root}/index")
    return index(pages.sparkSession, root)


def index(spark, root: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{root}/index")


def ranges(places, gap: int = GAP, most: int = RANGE):
    """Sorted (offset, length) places as reads: (start, end, places), neighbours together where the gap and the whole stay small."""
    run, start, end = [], 0, 0
    for at, n in places:
        if run and (at - end > gap or max(end, at + n) - start > most):
            yield start, end, run
            run = []
        if not run:
            start, end = at, at
        run.append((at, n))
        end = max(end, at + n)
    if run:
        yield start, end, run


def _reading(root: str, keep: bool):
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * keep
    kinds = {"url": pa.string(), "payload_digest": pa.string(), "record_type": pa.string(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])

    def of_file(fs, path, name, places):
        with fs.open_input_file(f"{path}/{name}") as f:
            for start, end, run in ranges(places):
                data = f.read_at(end - start, start)
                rows = [parse(zlib.decompress(data[at - start:at - start + n], 31)) for at, n in run]
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*[r[:len(names)] for r in rows]), schema)], schema=schema)

    def run(batches):
        fs, path = _files(root)
        name, places = None, []
        for b in batches:
            for file, at, n in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name or len(places) >= 100_000:
                    if places:
                        yield from of_file(fs, path, name, places)
                    name, places = file, []
                places.append((at, n))
        if places:
            yield from of_file(fs, path, name, places)

    return run


def read(selected: DataFrame, root: str, payloads: bool = False, task: int = TASK) -> DataFrame:
    """The records that rows of the index name, as their archives hold them, each checked against its digest; with `payload` (null for revisits) if asked for.

    The places are dealt in order of file and offset, so each task goes through
    a file once, forwards, and reads neighbours together. No places give no rows.
    """
    spark = selected.sparkSession
    total = selected.agg(F.sum("length")).first()[0] or 0
    places = selected.select("file", "offset", "length").repartitionByRange(max(spark.sparkContext.defaultParallelism, -(-total // task)), "file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(_reading(f"{root}/archive", payloads), RECORDS + ", payload binary" * payloads)


def archive(pages: DataFrame, root: str) -> DataFrame:
    """Write pages as archives under root and read every record back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read(write(pages, root), root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
