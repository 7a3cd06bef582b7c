"""Text alignment: normalised characters with their places, equal stretches of two texts, and times carried over to reference lines."""
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Characters of a reference, and cells of characters, beyond which a pair is too large for align(), where that is asked for.
MOST_CHARS, MOST_CELLS = 16_000, 16_000_000
#: Equal cells of a pair of texts that are held at once; beyond, blocks are sought in memory of the texts' own length.
MOST_EQUAL = 1 << 21
#: The half-width voicing marks, which belong to the character before them.
MARKS = "ﾞﾟ"
CHARS = "array<struct<char:string,char_start:int,char_end:int>>"
OPERATIONS = "step int, operation string, a_start int, a_end int, b_start int, b_end int, a_text string, b_text string"


@lru_cache(maxsize=1 << 16)
def _kept(letter: str) -> str:
    """A character with its marks after NFKC and case folding, without white space and punctuation."""
    return "".join(c for c in unicodedata.normalize("NFKC", letter).casefold() if not (c.isspace() or unicodedata.category(c)[0] == "P"))


@lru_cache(maxsize=1 << 16)
def _mark(c: str) -> bool:
    return bool(unicodedata.combining(c)) or c in MARKS


def places(text: str) -> list:
    """(char, start, end): characters after NFKC and case folding, without white space and punctuation, each with the code points it came from.

    A combining or half-width voicing mark is taken together with the character
    before it; a character that becomes several gives them all its place.
    """
    if text.isascii():
        return [(c, s, s + 1) for s, x in enumerate(text) for c in _kept(x)]
    starts = [i for i, c in enumerate(text) if not i or not _mark(c)]
    out = []
    for s, e in zip(starts, [*starts[1:], len(text)]):
        # A pile of marks is seldom met again, and of any length.
        out += [(c, s, e) for c in (_kept if e - s < 4 else _kept.__wrapped__)(text[s:e])]
    return out


class _Kept(dict):
    """What _kept() makes of a code point, for str.translate(); as many are remembered as there."""

    def __missing__(self, point):
        kept = _kept(chr(point))
        if len(self) < 1 << 16:
            self[point] = kept
        return kept


_KEPT = _Kept()


def plain(text: str) -> str:
    """The characters of places() as one string."""
    if text.isascii() or not any(map(_mark, set(text))):
        return text.translate(_KEPT)
    return "".join(c for c, _, _ in places(text))


#: Characters, and rows of operations, of a batch that leaves a task, about: a batch of rows may hold far more.
BATCH_CHARS, BATCH_ROWS = 200_000, 10_000


def normalised(texts: DataFrame, *keys: str, col: str = "text", to: str = "chars") -> DataFrame:
    """(keys, `to`): the normalised characters of each row's text with their places; none for null. A character's index is its place in the array."""
    schema = StructType([*(texts.schema[k] for k in keys), *StructType.fromDDL(f"`{to}` {CHARS}").fields])
    kind = to_arrow_schema(schema).field(to).type

    def packed(b, first, ends, found):
        one = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else ((),) * 3, kind.value_type)], fields=list(kind.value_type))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), one, type=kind)
        return pa.RecordBatch.from_arrays([*(b.column(i).slice(first, len(lists)) for i in range(len(keys))), lists], [*keys, to])

    def run(batches):
        for b in batches:
            first, ends, found = 0, [0], []
            for t in b.column(len(keys)):
                found += places(t.as_py() or "")
                ends.append(len(found))
                if len(found) >= BATCH_CHARS:
                    yield packed(b, first, ends, found)
                    first, ends, found = first + len(ends) - 1, [0], []
            yield packed(b, first, ends, found)

    return texts.select(*keys, F.col(col).cast("string").alias("_said")).mapInArrow(run, schema)


def normalised_text(texts: DataFrame, *keys: str, col: str = "text", to: str = "text") -> DataFrame:
    """(keys, `to`): the characters of normalised() as one string, without their places; empty for null."""
    schema = StructType([*(texts.schema[k] for k in keys), *StructType.fromDDL(f"`{to}` string").fields])

    def run(batches):
        for b in batches:
            said = pa.array([plain(t or "") for t in b.column(len(keys)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keys)], said], [*keys, to])

    return texts.select(*keys, F.col(col).cast("string").alias("_said")).mapInArrow(run, schema)


def _points(text: str):
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _equal_cells(x, y) -> int:
    """How many pairs of equal characters two texts have."""
    (a, m), (b, n) = (np.unique(t, return_counts=True) for t in (x, y))
    return int(m[np.isin(a, b, assume_unique=True)] @ n[np.isin(b, a, assume_unique=True)])


def _stretches(x, y):
    """Maximal equal stretches of two texts as arrays (start in x, start in y, length), from an index of y's characters."""
    index = np.argsort(y, kind="stable").astype(np.int32)
    low, high = (np.searchsorted(y[index], x, side) for side in ("left", "right"))
    many = high - low
    i = np.repeat(np.arange(len(x), dtype=np.int32), many)
    nth = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
    lag = index[np.repeat(low, many) + nth] - i
    # By diagonal, then by place: one number holds both, and the next place on a diagonal is the next number.
    at = np.sort((lag.astype(np.int64) + len(x)) * (len(x) + 1) + i)
    first = np.flatnonzero(np.diff(at, prepend=at[:1] - 2) != 1)
    lag, i = np.divmod(at[first], len(x) + 1)
    return i, i + lag - len(x), np.diff(np.append(first, len(at)))


def _shared(x, y):
    """Of named places of two texts (place, name), those whose name both have, with names counted from 0."""
    both = np.intersect1d(x[1], y[1])
    out = []
    for place, name in (x, y):
        k = np.searchsorted(both, name)
        held = np.flatnonzero(np.append(both, -1)[k] == name)
        out.append((place[held], k[held]))
    return out


def _longest(x, y):
    """(start in x, start in y, length) of the longest equal stretch, the earliest in x and then in y of several; length 0 if there is none.

    Places are named by the stretch of some length that begins there; two such
    names make one of a longer stretch, doubled while both texts share one and
    then by halves. Only shared places go on, so memory is that of the texts.
    """
    length, found, step = 1, _shared(*((np.arange(len(t)), t.astype(np.int64)) for t in (x, y))), 1
    if not len(found[0][0]):
        return 0, 0, 0
    doubling = True
    while step:
        longer, names = [], 1 + int(found[0][1].max())
        for size, (place, name) in zip((len(x), len(y)), found):
            at = np.full(size + step, -1)
            at[place] = name
            behind = at[place + step]
            k = np.flatnonzero(behind >= 0)
            longer.append((place[k], name[k] * names + behind[k]))
        longer = _shared(*longer)
        if len(longer[0][0]):
            found, length = longer, length + step
        else:
            doubling = False
        step = length if doubling else step // 2
    (i, a), (j, b) = found
    return int(i[0]), int(j[np.flatnonzero(b == a[0])[0]]), length


def _of_stretches(i, j, n):
    """The blocks of texts whose equal stretches these are."""
    found, todo = [], [(i, j, n)]
    while todo:
        i, j, n = todo.pop()
        if not len(n):
            continue
        m = int(n.max())
        top = np.flatnonzero(n == m)
        p, q = min(zip(i[top].tolist(), j[top].tolist()))
        found.append((p, q, m))
        # Of the others, what lies before the block in both texts, and what lies behind it in both.
        k = (i < p) & (j < q)
        x, y = i[k], j[k]
        todo.append((x, y, np.minimum(n[k], np.minimum(p - x, q - y))))
        k = (i + n > p + m) & (j + n > q + m)
        x, y = i[k], j[k]
        late = np.maximum(0, np.maximum(p + m - x, q + m - y))
        todo.append((x + late, y + late, n[k] - late))
    return found


def blocks(a: str, b: str) -> list:
    """(start in a, start in b, length) of the blocks two texts share, in order: the longest stretch, the earliest in a and then in b of several, and so on before and behind it.

    A part of the texts with too many equal cells to be held gives its longest
    stretch by itself, until the parts before and behind it are small enough.
    """
    x, y = _points(a), _points(b)
    found, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        p, e, q, f = todo.pop()
        u, v = x[p:e], y[q:f]
        if len(u) * len(v) <= MOST_EQUAL or _equal_cells(u, v) <= MOST_EQUAL:
            found += [(p + i, q + j, n) for i, j, n in _of_stretches(*_stretches(u, v))]
            continue
        i, j, n = _longest(u, v)
        found.append((p + i, q + j, n))
        todo += [(p, p + i, q, q + j), (p + i + n, e, q + j + n, f)]
    return sorted(found)


def operations(a: str, b: str):
    """(operation, a_start, a_end, b_start, b_end) that lead from a to b: equal, replace, delete, insert."""
    p = q = 0
    held = None
    for i, j, n in [*blocks(a, b), (len(a), len(b), 0)]:
        if held and (i, j) != (p, q):
            yield held
            held = None
        if i > p or j > q:
            yield "replace" if i > p and j > q else "delete" if i > p else "insert", p, i, q, j
        if n:  # blocks that touch in both texts are one
            held = ("equal", held[1] if held else i, i + n, held[3] if held else j, j + n)
        p, q = i + n, j + n
    if held:
        yield held


def align(pairs: DataFrame, *keys: str, a: str = "a", b: str = "b", budget: bool = True) -> DataFrame:
    """(keys, step, operation, a_start .. b_text): how the characters `a` of each row become its characters `b` (arrays of normalised(), or texts of normalised_text()).

    Under the `budget` a pair beyond it is one row `too_large` with the bounds
    of both texts, never a part of a mapping; without it every pair is mapped,
    whatever its length. Two empty texts give no rows. Each pair is a row, so
    pairs are dealt as the table is and nothing is shuffled.
    """
    schema = StructType([*(pairs.schema[k] for k in keys), *StructType.fromDDL(OPERATIONS).fields])
    arrow = to_arrow_schema(schema)

    def packed(batch, rows):
        at = pa.array([r[0] for r in rows], pa.int64())
        values = [pa.array([r[k] for r in rows], arrow.field(len(keys) + k - 1).type) for k in range(1, 9)]
        return pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keys))), *values], schema=arrow)

    def mapped(x, y):
        if budget and (len(y) > MOST_CHARS or len(x) * len(y) > MOST_CELLS):
            yield 0, "too_large", 0, len(x), 0, len(y), None, None
        else:
            for s, (o, p, e, q, f) in enumerate(operations(x, y)):
                yield s, o, p, e, q, f, x[p:e], y[q:f]

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for r, (x, y) in enumerate(zip(batch.column(len(keys)), batch.column(len(keys) + 1))):
                for one in mapped(x.as_py() or "", y.as_py() or ""):
                    rows.append((r, *one))
                    held += one[3] - one[2] + one[5] - one[4]
                    if len(rows) >= BATCH_ROWS or held >= BATCH_CHARS:
                        yield packed(batch, rows)
                        rows, held = [], 0
            yield packed(batch, rows)

    kinds = dict(pairs.dtypes)
    joined = lambda c: F.col(c) if kinds[c] == "string" else F.array_join(F.transform(c, lambda x: x["char"]), "").alias(c)
    return pairs.select(*keys, joined(a), joined(b)).mapInArrow(run, schema)


def matches(ops: DataFrame, *keys: str) -> DataFrame:
    """(keys, a_index, b_index): characters that align() found equal."""
    return ops.where("operation = 'equal'").select(*keys, F.col("a_start").alias("_a"), F.posexplode(F.sequence("b_start", F.col("b_end") - 1)).alias("_n", "b_index")).select(*keys, (F.col("_a") + F.col("_n")).alias("a_index"), "b_index")


def characters(texts: DataFrame, song: str, line: str, order: str, chars: str = "chars") -> DataFrame:
    """(song, index, line, normalized_index, char, char_start, char_end): the characters of the lines of a song, numbered through in `order` and within each line."""
    before = F.coalesce(F.sum(F.size(chars)).over(Window.partitionBy(song).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = texts.withColumn("_before", before).select(song, line, "_before", F.posexplode(chars).alias("normalized_index", "x"))
    return rows.select(song, (F.col("_before") + F.col("normalized_index")).cast("int").alias("index"), line, "normalized_index", "x.char", "x.char_start", "x.char_end")


def whole(texts: DataFrame, song: str, order: str, chars: str = "chars", to: str = "a") -> DataFrame:
    """(song, `to`): the characters of a song's lines, arrays or texts, one after the other. A song is a row."""
    rows = texts.groupBy(song).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(chars).alias("c")))).alias("x"))
    parts = F.transform("x", lambda x: x["c"])
    return rows.select(song, (F.array_join(parts, "") if dict(texts.dtypes)[chars] == "string" else F.flatten(parts)).alias(to))


def songs(lines: DataFrame, segments: DataFrame, song: str = "song_id") -> DataFrame:
    """(song, lines array<struct<line_id, text, again>>, segments array<struct<segment_id, text>>): of each song with lines, in order, all that timeline_of() needs in one row.

    Both sides are texts of normalised_text(), so a character moves as itself and
    without its places. A line is there `again` if another of the song has its characters.
    """
    w = Window.partitionBy(song).orderBy("text").rangeBetween(Window.currentRow, Window.currentRow)
    held = lambda rows, to, *cols: rows.groupBy(song).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(to))
    lines = held(lines.withColumn("again", F.count(F.lit(1)).over(w) > 1), "lines", "line_id", "text", "again")
    return lines.join(held(segments, "segments", "segment_id", "text").hint("merge"), song, "left")


def units(songs: DataFrame, start, end, song: str = "song_id") -> DataFrame:
    """(song, line_id, again, units array<struct<a_index, start_sample, end_sample>>) of each line of songs(): the place of the equal character in what was heard and its times, null where there is none.

    start, end: array columns with the times of the characters of all segments,
    one after the other, null where one was not aligned. Songs are mapped as by
    align() without its budget, each where it lies.
    """
    text = lambda c: F.coalesce(F.array_join(F.col(f"{c}.text"), ""), F.lit("")).alias(c)
    lengths = F.transform("lines", lambda x: F.length(x["text"])).alias("lengths")
    rows = songs.select(song, F.col("lines.line_id").alias("line_id"), F.col("lines.again").alias("again"), lengths, text("segments"), text("lines"), start.alias("start_sample"), end.alias("end_sample"))
    of = lambda c: rows.schema[c].dataType.elementType
    unit = StructType([StructField("a_index", IntegerType()), *(StructField(c, of(c)) for c in ("start_sample", "end_sample"))])
    schema = StructType([rows.schema[song], *(StructField(c, of(c)) for c in ("line_id", "again")), StructField("units", ArrayType(unit))])
    arrow = to_arrow_schema(schema)

    def placed(x, y):
        place = np.full(len(y), -1, np.int32)
        for i, j, n in blocks(x, y):
            place[j:j + n] = np.arange(i, i + n)
        return place

    def timed(times, place):
        """The times of the characters that were met."""
        return times.values.take(pa.array(place, mask=place < 0)) if times.is_valid else pa.nulls(len(place), times.type.value_type)

    def packed(batch, held):
        at, lines, again, many, *values = zip(*held) if held else ((),) * 7
        joined = lambda parts, kind: pa.concat_arrays([pa.array([], kind), *(p.cast(kind) for p in parts)])
        kind = arrow.field("units").type
        one = pa.StructArray.from_arrays([joined(v, f.type) for v, f in zip(values, kind.value_type)], fields=list(kind.value_type))
        many = np.concatenate([[0], *many]).astype(np.int32)
        of_song = np.repeat(np.array(at, np.int64), [len(x) for x in lines])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of_song)), joined(lines, arrow.field(1).type), joined(again, arrow.field(2).type), pa.ListArray.from_arrays(pa.array(np.cumsum(many, dtype=np.int32)), one, type=kind)], schema=arrow)

    def run(batches):
        for batch in batches:
            held, n = [], 0
            for r in range(batch.num_rows):
                line, again, lengths, x, y, start, end = (c[r] for c in batch.columns[1:])
                place = placed(x.as_py(), y.as_py())
                held.append((r, line.values, again.values, lengths.values.to_numpy(), pa.array(place, mask=place < 0), timed(start, place), timed(end, place)))
                n += len(place)
                if n >= BATCH_CHARS:
                    yield packed(batch, held)
                    held, n = [], 0
            yield packed(batch, held)

    return rows.mapInArrow(run, schema)


def _judged(out: DataFrame, song: str) -> DataFrame:
    """The rows of timeline() from what was found out about each line."""
    complete = F.coalesce(F.col("complete"), F.lit(False))
    out = out.withColumns({"complete": complete, "publish": complete & F.coalesce(F.col("contiguous"), F.lit(False)) & ~F.coalesce(F.col("back"), F.lit(False))})
    flags = [F.when(F.col("complete") & F.col("back"), "nonmonotonic_reference_timing_review"), F.when(F.col("again"), "repeated_reference_review"), F.when(~F.col("publish"), "reference_mismatch_or_unaligned")]
    shown = lambda c: F.when(F.col("publish"), F.col(c)).alias(c)
    return out.select(song, "line_id", F.when(F.col("publish"), "matched").otherwise("unaligned").alias("status"), shown("start_sample"), shown("end_sample"), F.coalesce("units", F.lit(0)).cast("long").alias("units"), F.array_join(F.array_compact(F.array(*flags)), ",").alias("flags"))


def timeline(lines: DataFrame, reference: DataFrame, heard: DataFrame, matched: DataFrame, observed: DataFrame, song: str = "song_id") -> DataFrame:
    """(song, line_id, status, start_sample, end_sample, units, flags) of each reference line: times of its characters as heard, never interpolated.

    lines (song, line_id, chars); reference and heard are characters(), heard
    by segment_id; matched (song, a_index, b_index); observed (song,
    segment_id, normalized_index, status, start_sample, end_sample). A line is
    matched if all its characters were aligned, the heard ones it matches
    follow on each other, and no time runs backwards. Lines of equal characters
    in a song are marked for review. Lines without characters are unaligned.
    Sides are rows of single characters, whose number no estimate from the texts
    tells, so they are merged and never gathered on the driver for a broadcast.
    """
    h = heard.join(observed.where("status = 'aligned'").drop("status").hint("merge"), [song, "segment_id", "normalized_index"], "left")
    h = h.select(song, F.col("index").alias("a_index"), "start_sample", "end_sample")
    units = reference.select(song, "line_id", F.col("index").alias("b_index")).join(matched.join(h.hint("merge"), [song, "a_index"], "left").hint("merge"), [song, "b_index"], "left")
    w = Window.partitionBy(song, "line_id").orderBy("b_index")
    units = units.withColumn("_back", F.lag("end_sample").over(w) > F.col("start_sample"))
    timed = F.count("start_sample") == F.count(F.lit(1))
    line = units.groupBy(song, "line_id").agg(
        F.count(F.lit(1)).alias("units"), timed.alias("complete"), (F.max("a_index") - F.min("a_index") + 1 == F.count("a_index")).alias("contiguous"), F.coalesce(F.bool_or("_back"), F.lit(False)).alias("back"),
        F.min_by("start_sample", "b_index").alias("start_sample"), F.max_by("end_sample", "b_index").alias("end_sample"),
    )
    same = lines.select(song, "line_id", F.xxhash64(F.transform("chars", lambda c: c["char"])).alias("_h"), F.transform("chars", lambda c: c["char"]).alias("_c"))
    same = same.withColumn("again", F.count(F.lit(1)).over(Window.partitionBy(song, "_h", "_c")) > 1).drop("_h", "_c")
    return _judged(same.join(line.hint("merge"), [song, "line_id"], "left"), song)


def timeline_of(songs: DataFrame, start, end, song: str = "song_id") -> DataFrame:
    """timeline() of songs(), with the times of units(): a line's characters stay in its row, so nothing is moved but the texts, once."""
    rows, size = units(songs, start, end, song), F.size("units")
    met = F.filter(F.transform("units", lambda x: x["a_index"]), lambda x: x.isNotNull())
    rest = F.greatest(size - 1, F.lit(0))
    back = F.exists(F.zip_with(F.slice("units", F.lit(1), rest), F.slice("units", F.lit(2), rest), lambda x, y: x["end_sample"] > y["start_sample"]), lambda x: x)
    line = rows.select(
        song, "line_id", "again", size.alias("units"), ((size > 0) & ~F.exists("units", lambda x: x["start_sample"].isNull())).alias("complete"), (F.array_max(met) - F.array_min(met) + 1 == F.size(met)).alias("contiguous"), F.coalesce(back, F.lit(False)).alias("back"),
        F.get("units", F.lit(0))["start_sample"].alias("start_sample"), F.get("units", size - 1)["end_sample"].alias("end_sample"),
    )
    return _judged(line, song)
