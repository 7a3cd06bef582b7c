"""Joining overlapping chunks of a signal."""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def overlap_add(chunks: DataFrame, fade: int, block: int = 65536, key: str = "path") -> DataFrame:
    """(key, block, samples) of chunks (key, start, total, samples): weighted means where chunks overlap.

    A chunk fades in over its first `fade` samples unless it starts at 0, and out over its last unless it ends at `total`; where weights sum to nothing a sample is null. Each chunk is cut at blocks first, so a task holds one block's pieces and never a whole signal. Null or empty chunks add nothing.
    """
    piece = StructType([chunks.schema[key], *StructType.fromDDL("block long, offset long, total long, sum array<float>, weight array<float>").fields])
    done = StructType([chunks.schema[key], *StructType.fromDDL("block long, samples array<double>").fields])
    cut, out = to_arrow_schema(piece), to_arrow_schema(done)

    def weigh(batches):
        for b in batches:
            for name, start, total, samples in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3)):
                x = samples.values.to_numpy(zero_copy_only=False) if samples.is_valid else np.empty(0)
                w, edge = np.ones(len(x)), min(fade, len(x))
                ramp = np.arange(1, edge + 1) / (edge + 1)
                if edge and start > 0:
                    w[:edge] *= ramp
                if edge and start + len(x) < total:
                    w[-edge:] *= ramp[::-1]
                rows = []
                for n in range(start // block, -(-(start + len(x)) // block)):
                    lo, hi = max(0, n * block - start), min(len(x), (n + 1) * block - start)
                    rows.append(dict(zip(cut.names, (name, n, start + lo - n * block, total, x[lo:hi] * w[lo:hi], w[lo:hi]))))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, cut)

    def join(k, t):
        n, total = k[1].as_py(), max(t.column("total").to_pylist())
        size = max(0, min(block, total - n * block))
        held = np.zeros((2, block))
        for at, *parts in zip(t.column("offset").to_pylist(), t.column("sum").to_pylist(), t.column("weight").to_pylist()):
            held[:, at:at + len(parts[0])] += parts
        mean = np.divide(held[0], held[1], out=np.full(block, np.nan), where=held[1] > 0)[:size]
        return pa.table([pa.array([k[0].as_py()], out.field(0).type), pa.array([n]), pa.array([[None if np.isnan(v) else v for v in mean]], out.field(2).type)], schema=out)

    return chunks.select(key, "start", "total", "samples").mapInArrow(weigh, piece).groupBy(key, "block").applyInArrow(join, done)
