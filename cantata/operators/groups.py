"""Per-song folds over sorted partitions: rows in order in, rows out."""
from bisect import bisect_left
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a batch that leaves a fold.
ROWS = 10000


def _values(column) -> list:
    """A column as Python values, by way of numpy and column by column within lists and structs, as value by value is slow."""
    kind = column.type
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_string(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_struct(kind):
        names = [f.name for f in kind]
        out = [dict(zip(names, v)) for v in zip(*map(_values, column.flatten()))]
    elif pa.types.is_list(kind):
        ends = np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy()).tolist()
        held = _values(column.flatten())
        out = [held[i:j] for i, j in zip([0, *ends], ends)]
    elif not (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return column.to_pylist()
    else:
        out = (column.fill_null(0) if column.null_count else column).to_numpy().tolist()
    if column.null_count:
        for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
            out[i] = None
    return out


def _songs(batches):
    """The rows of each song as tuples; the last column numbers them from 1, and a song may go on in the next batch."""
    held = []
    for b in batches:
        rows = list(zip(*map(_values, b.columns)))
        starts = [i for i, r in enumerate(rows) if r[-1] == 1]
        at = 0
        for s in starts:
            held += rows[at:s]
            if held:
                yield held
            held, at = [], s
        held += rows[at:]
    if held:
        yield held


def whole_songs(batches):
    """Record batches of whole songs, many to a batch, of batches whose last column numbers the rows of a song from 1."""
    held = []
    for b in batches:
        first = np.flatnonzero(b.column(b.num_columns - 1).to_numpy() == 1)
        if len(first):
            held.append(b.slice(0, first[-1]))
            if any(h.num_rows for h in held):
                yield pa.concat_batches(held)
            held = []
            b = b.slice(first[-1])
        held.append(b)
    if any(h.num_rows for h in held):
        yield pa.concat_batches(held)


def _packed(found, arrow):
    found = iter(found)
    while rows := list(islice(found, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def in_order(rows: DataFrame, key: str, *order) -> DataFrame:
    """The rows numbered within each song: a song is whole in one partition, and its rows follow on each other there."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def fold(rows: DataFrame, key: str, order: list, step, schema: str) -> DataFrame:
    """Apply step(list of row dicts in order) -> iterable of tuples to each song; `schema` names the output after the key.

    A song is bounded by its length (an hour of frames), so it fits a task; songs are spread by key. Many small songs share a batch.
    """
    names = rows.columns
    full = StructType([rows.schema[key], *StructType.fromDDL(schema).fields])
    arrow, at = to_arrow_schema(full), names.index(key)

    def run(batches):
        yield from _packed(((s[0][at], *r) for s in _songs(batches) for r in step([dict(zip(names, x)) for x in s])), arrow)

    return in_order(rows, key, *(F.col(c).asc_nulls_last() for c in order)).mapInArrow(run, full)


def _picked(places):
    """The values of a row at some places, as a tuple."""
    return itemgetter(*places) if len(places) > 1 else lambda row: (row[places[0]],)


def pair(left: DataFrame, right: DataFrame, key: str, orders: tuple, step, schema: str) -> DataFrame:
    """Like fold(), with step(left rows, right rows) over the songs of either side."""
    full = StructType([left.schema[key], *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(full)
    # Columns of one name and type are shared by the sides, the others stand beside each other.
    kinds = dict(left.dtypes)
    own = {c: c if kinds.get(c, k) == k else f"_{c}" for c, k in right.dtypes}
    both = left.withColumn("_side", F.lit(0)).unionByName(right.select(F.lit(1).alias("_side"), *(F.col(c).alias(n) for c, n in own.items())), allowMissingColumns=True)
    names = both.columns
    at, side = names.index(key), names.index("_side")
    columns = [(tuple(s), _picked([names.index(n) for n in s.values()])) for s in ({c: c for c in kinds}, own)]
    if orders[0] == orders[1] and all(own[c] == c for c in orders[1]):
        order = [F.col(c) for c in orders[0]]
    else:
        order = [F.when(F.col("_side") == i, F.col(s.get(c, c))) for i, s in enumerate(({}, own)) for c in orders[i]]

    def run(batches):
        def songs():
            for s in _songs(batches):
                cut = bisect_left(s, 1, key=itemgetter(side))
                sides = [[dict(zip(cs, pick(r))) for r in part] for part, (cs, pick) in zip((s[:cut], s[cut:]), columns)]
                for r in step(*sides):
                    yield s[0][at], *r

        yield from _packed(songs(), arrow)

    return in_order(both, key, "_side", *(c.asc_nulls_last() for c in order)).mapInArrow(run, full)
