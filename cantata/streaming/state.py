"""Keyed state machines: one step function for streams and for tables."""
import json

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import LongType, StructType

from cantata.operators.groups import fold


def run(events: DataFrame, key: str, order: str, step, schema: str) -> DataFrame:
    """Rows of step(state, event) -> (state, tuple or None) for each key's events.

    A table is read in order. A stream keeps the state between batches and
    sorts within a batch, so that it gives the table's rows where batches come
    in order; an event that comes late is judged by the state it meets. State is
    kept as JSON: it must stay small, whatever the number of events.
    """
    full = StructType([events.schema[key], *StructType.fromDDL(schema).fields])
    if not events.isStreaming:

        def whole(rows):
            state = None
            for r in rows:
                state, out = step(state, r)
                if out is not None:
                    yield out

        return fold(events, key, [order], whole, schema)

    names = events.columns
    longs = [f.name for f in full.fields if isinstance(f.dataType, LongType)]

    def part(k, frames, held):
        state = json.loads(held.get[0]) if held.exists else None
        rows = sorted((json.loads(e) for f in frames for e in f["event"]), key=lambda r: r[order])
        found = []
        for r in rows:
            state, out = step(state, dict.fromkeys(names) | r)
            if out is not None:
                found.append((k[0], *out))
        held.update((json.dumps(state),))
        yield pd.DataFrame(found, columns=full.names, dtype=object).astype(dict.fromkeys(longs, "Int64"))

    packed = events.select(key, F.to_json(F.struct(*names)).alias("event"))
    return packed.groupBy(key).applyInPandasWithState(part, full, "state string", "append", GroupStateTimeout.NoTimeout)
