"""Strict JSON objects: one verdict per text, the object's keys and canonical digest where it is accepted."""
import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class _Refused(ValueError):
    pass


def _object(pairs):
    if len({k for k, _ in pairs}) < len(pairs):
        raise _Refused("duplicate_key")
    return dict(pairs)


def _number(text):
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise _Refused("overflow")
    return value


def _constant(name):
    raise _Refused("not_finite")


def read(text, limit: int):
    """(status, keys, digest): ok, missing, too_large, invalid, not_an_object, duplicate_key, not_finite or overflow."""
    if text is None:
        return "missing", None, None
    if len(text.encode("utf-8", "surrogatepass")) > limit:
        return "too_large", None, None
    try:
        value = json.loads(text, object_pairs_hook=_object, parse_float=_number, parse_constant=_constant)
    except _Refused as e:
        return str(e), None, None
    except (ValueError, RecursionError):
        return "invalid", None, None
    if not isinstance(value, dict):
        return "not_an_object", None, None
    flat = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return "ok", sorted(value), hashlib.sha256(flat.encode("utf-8", "surrogatepass")).hexdigest()


def objects(rows: DataFrame, key: str, col: str, limit: int = 16 << 20) -> DataFrame:
    """(key, status, keys, digest) per row of a text column."""
    full = StructType([rows.schema[key], *StructType.fromDDL("status string, keys array<string>, digest string").fields])
    arrow = to_arrow_schema(full)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, (r[key], *read(r[col], limit)))) for r in b.to_pylist()], arrow)

    return rows.select(key, col).mapInArrow(run, full)
