"""Standard MIDI files: one row per channel event, tempo change and track end."""
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Data bytes of the channel messages by their upper four bits.
_DATA = {0x8: 2, 0x9: 2, 0xA: 2, 0xB: 2, 0xC: 1, 0xD: 1, 0xE: 2}
_SCHEMA = "division int, track int, tick long, seq long, kind string, channel long, note long, velocity long"


class BadFile(ValueError):
    pass


def _length(data, at):
    """A variable-length quantity of four bytes at most, and the place behind it."""
    value = 0
    for i in range(4):
        if at + i >= len(data):
            break
        value = value << 7 | data[at + i] & 0x7F
        if data[at + i] < 0x80:
            return value, at + i + 1
    raise BadFile("bad length")


def _track(data):
    at = tick = seq = 0
    status = None
    while at < len(data):
        delta, at = _length(data, at)
        tick += delta
        if at >= len(data):
            raise BadFile("truncated event")
        if data[at] >= 0x80:
            status, at = data[at], at + 1
        if status is None:
            raise BadFile("no status")
        if status == 0xFF:
            kind, (size, at) = data[at], _length(data, at + 1)
            body, at, status = data[at:at + size], at + size, None
            if at > len(data):
                raise BadFile("truncated meta event")
            if kind == 0x51 and size == 3:
                yield tick, seq, "tempo", None, None, int.from_bytes(body, "big")
            if kind == 0x2F:
                yield tick, seq, "end", None, None, None
                return
        elif status in (0xF0, 0xF7):
            size, at = _length(data, at)
            at, status = at + size, None
        else:
            n = _DATA.get(status >> 4)
            args = data[at:at + (n or 0)]
            at += n or 0
            if not n or len(args) < n or max(args) > 0x7F:
                raise BadFile("bad event")
            top, channel = status >> 4, status & 15
            if top == 0x9 and args[1]:
                yield tick, seq, "on", channel, args[0], args[1]
            elif top in (0x8, 0x9):
                yield tick, seq, "off", channel, args[0], args[1]
            elif top == 0xB and args[0] == 64:
                yield tick, seq, "sustain", channel, args[1], None
        seq += 1
    raise BadFile("no end of track")


def parse(data: bytes) -> list:
    """Events of a file as tuples of _SCHEMA; raises BadFile."""
    if data[:4] != b"MThd" or len(data) < 14 or int.from_bytes(data[4:8], "big") < 6:
        raise BadFile("no header")
    tracks, division = int.from_bytes(data[10:12], "big"), int.from_bytes(data[12:14], "big")
    if not division or division & 0x8000:
        raise BadFile("no ticks per quarter")
    at, out, found = 8 + int.from_bytes(data[4:8], "big"), [], 0
    while at + 8 <= len(data) and found < tracks:
        size = int.from_bytes(data[at + 4:at + 8], "big")
        if at + 8 + size > len(data):
            raise BadFile("truncated chunk")
        if data[at:at + 4] == b"MTrk":
            out += [(division, found, *e) for e in _track(data[at + 8:at + 8 + size])]
            found += 1
        at += 8 + size
    if found < tracks:
        raise BadFile("missing tracks")
    return out


def events(files: DataFrame, key: str = "path", col: str = "content") -> DataFrame:
    """(key, division, track, tick, seq, kind, channel, note, velocity) per event of each file of a binary column, as spark.read.format("binaryFile") gives it.

    A tempo event has its microseconds a quarter in velocity; a file that is no
    valid MIDI file gives one row of kind "error".
    """
    full = StructType([files.schema[key], *StructType.fromDDL(_SCHEMA).fields])
    arrow = to_arrow_schema(full)

    def one(r):
        try:
            return [(r[key], *e) for e in parse(bytes(r[col] or b""))]
        except BadFile:
            return [(r[key], None, None, None, None, "error", None, None, None)]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, e)) for r in b.to_pylist() for e in one(r)], arrow)

    return files.select(key, col).mapInArrow(run, full)
