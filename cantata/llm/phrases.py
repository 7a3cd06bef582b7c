"""Phrase collocations: Misra-Gries summaries find the frequent n-grams, a second pass counts them exactly."""
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpoint, salt_of

#: Words of the longest phrase.
LONGEST = 5
#: N-grams that a task sums up, and that it counts exactly, before it hands them on, bytes and rows of text that it parts at a time, and counts that it adds up at a time.
CHUNK, COUNTED, SLICE, ROWS, ADDED = 2_000_000, 1_000_000, 1 << 20, 1000, 400_000
#: Counters of a hash partition that a task should hold at most, where the number of partitions can see to it.
COUNTERS, MOST_PARTS = 1_000_000, 1 << 16
#: Bits of the map of surviving n-grams: 16 for each survivor within these bounds. Beyond 2^30 / 16 survivors the map passes more of the others, which the exact count then drops.
LEAST_BITS, MOST_BITS = 20, 30

_WORDS = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c in b" \t" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = re.compile(rb"[^ \n]+")
_ODD = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_BYTES = [np.random.default_rng(k).integers(0, 1 << 64, 256, dtype=np.uint64) for k in (1, 2)]


class _Powers:
    """Powers of an odd number modulo 2^64, and of its inverse."""

    def __init__(self, base):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n):
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(self.base, m, 1 << 64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(self.inverse, m, 1 << 64))))
        return self.up, self.down


_POWERS = [_Powers(b) for b in _ODD]


def _mix(h):
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _seed(lang: str, which: int):
    h = 0
    for c in lang.encode():
        h = (h * 257 + c + 1) % (1 << 64)
    return np.uint64(h * _ODD[which] % (1 << 64))


class Words:
    """The words of a buffer of lower-case text in which 10 parts pieces and 32 parts words; n-grams are those that begin before byte `own`, the first `begin` ones."""

    def __init__(self, buf: bytes, own: int):
        self.buf, self.b = buf, np.frombuffer(buf, np.uint8)
        gap = np.concatenate(([True], (self.b == 10) | (self.b == 32), [True]))
        self.starts, self.ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        self.piece = np.searchsorted(np.flatnonzero(self.b == 10), self.starts)
        self.begin = int(np.searchsorted(self.starts, own))

    def hashes(self, which: int = 0):
        """A polynomial of each word's bytes, from prefix sums over the buffer."""
        up, down = _POWERS[which].reach(len(self.b) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[which][self.b] * up[:len(self.b)], dtype=np.uint64)))
        return _mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def grams(self, lang: str, which: int = 0):
        """Hashes of the n-grams at each word for n = 1.. LONGEST, each array as long as there are words for it."""
        word = self.hashes(which)
        out = [_mix(word ^ _seed(lang, which))]
        for n in range(2, LONGEST + 1):
            before = out[-1]
            m = max(0, len(word) - n + 1)
            out.append(_mix(before[:m] * np.uint64(_ODD[1 - which]) + word[n - 1:n - 1 + m] + np.uint64(n)))
        return out

    def inside(self, n: int):
        """Whether the n words from each on stand in one piece."""
        m = max(0, len(self.piece) - n + 1)
        return self.piece[:m] == self.piece[n - 1:n - 1 + m]

    def phrase(self, i: int, n: int) -> str:
        s, e = self.starts[i:i + n], self.ends[i:i + n]
        if n == 1 or (s[1:] == e[:-1] + 1).all():
            return self.buf[s[0]:e[-1]].decode()
        return b" ".join(self.buf[a:b] for a, b in zip(s, e)).decode()


def buffers(batch):
    """(lang, Words) of an Arrow batch of (lang, text), in slices that end with a piece; a text ends a piece too.

    A piece that goes on for long is cut between words, and the words behind
    the cut that n-grams may reach into are in both slices.
    """
    by = {}
    for at in range(ROWS, batch.num_rows, ROWS):
        yield from buffers(batch.slice(at - ROWS, ROWS))
    rest = batch.slice((batch.num_rows - 1) // ROWS * ROWS) if batch.num_rows else batch
    for lang, text in zip(rest.column(0).to_pylist(), rest.column(1).cast(pa.binary()).to_pylist()):
        by.setdefault(lang, []).append(text)
    for lang, texts in by.items():
        buf = b"\n".join(texts).translate(_WORDS)
        at = 0
        while at < len(buf):
            end = len(buf) if len(buf) - at <= 2 * SLICE else buf.find(b"\n", at + SLICE, at + 2 * SLICE)
            if end < 0:
                end = reach = buf.find(b" ", at + SLICE)
                for _ in range(LONGEST - 1):
                    more = _WORD.search(buf, reach) if reach >= 0 else None
                    reach = more.end() if more else -1
            else:
                reach = end
            end, reach = (x if x >= 0 else len(buf) for x in (end, reach))
            yield lang, Words(buf[at:reach], end - at)
            at = end


def passes(bitmap, h):
    """Whether the map has the bit of each hash; no map passes all."""
    if bitmap is None:
        return np.ones(len(h), bool)
    bit = h >> np.uint64(64 - (len(bitmap) * 64 - 1).bit_length())
    return (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)) != 0


def possible(words: Words, grams, maps, n: int):
    """Positions of the n-grams whose parts of known lengths are all on the maps: none else can be frequent."""
    ok = words.inside(n)
    k = max((k for k in maps if k < n), default=None)
    if k:
        part = passes(maps[k], grams[k - 1])
        for i in range(n - k + 1):
            ok = ok & part[i:i + len(ok)]
    if n in maps:
        ok = ok & passes(maps[n], grams[n - 1])
    return np.flatnonzero(ok[:words.begin])


def summed(keys, counts):
    """Equal keys as one, with the sum of their counts; keys rising."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Summary:
    """Misra-Gries counters over a stream of summaries.

    With a capacity over mass / threshold the counts taken away never reach the
    threshold. The summary holds to that where a frequent n-gram makes its hash
    partition heavier than the capacity was made for: it keeps more counters
    then, and never takes away so much that a frequent n-gram could be lost.
    """

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.taken = capacity, threshold, 0
        self.keys, self.counts, self.new, self.waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys, counts):
        self.new.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > max(len(self.keys), self.capacity, 1 << 16):
            self.merge()

    def merge(self):
        keys, counts = zip((self.keys, self.counts), *self.new)
        self.keys, self.counts = summed(np.concatenate(keys), np.concatenate(counts))
        self.new, self.waiting = [], 0
        over = len(self.keys) - self.capacity
        if over > 0:
            cut = int(np.partition(self.counts, over - 1)[over - 1])
            if self.taken + cut < self.threshold:
                self.taken += cut
                left = self.counts > cut
                self.keys, self.counts = self.keys[left], self.counts[left] - cut

    def survivors(self):
        """The keys that may have reached the threshold; every key that has is among them."""
        self.merge()
        return self.keys[self.counts + self.taken >= self.threshold]


def _dealt(keys, parts: int):
    """(part, from, to) of rising keys: the hash partitions that have some."""
    part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    edge = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    return [(int(p), int(edge[p]), int(edge[p + 1])) for p in np.flatnonzero(edge[1:] > edge[:-1])]


def key_bytes(mass: int) -> int:
    """The leading bytes of a hash that go into summaries: 8 bits more than n-grams need. Where two have the same ones they are counted together, which can only add survivors."""
    return min(8, max(5, -(-(mass.bit_length() + 8) // 8)))


def packed(keys, width: int) -> bytes:
    return np.ascontiguousarray((keys >> np.uint64(64 - 8 * width)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(data: bytes, width: int):
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64) << np.uint64(64 - 8 * width)


def _chunks(lengths, maps, parts: int, width: int):
    """Arrow batches of text to rows (part, keys, counts): the n-grams of a chunk summed up, for each hash partition."""

    def rows(kept):
        keys, counts = np.unique(np.concatenate(kept), return_counts=True)
        full, counts = _dealt(keys, parts), counts.astype(np.uint32)
        ours = [packed(keys[s:e], width) for _, s, e in full], [counts[s:e].tobytes() for _, s, e in full]
        return pa.RecordBatch.from_arrays([pa.array([p for p, *_ in full], pa.int32()), *(pa.array(x, pa.binary()) for x in ours)], ["part", "keys", "counts"])

    def run(batches):
        on, kept, held = {n: m.value for n, m in maps.items()}, [], 0
        for b in batches:
            for lang, words in buffers(b):
                grams = words.grams(lang)
                for n in lengths:
                    kept.append(grams[n - 1][possible(words, grams, on, n)])
                    held += len(kept[-1])
                if held >= CHUNK:
                    yield rows(kept)
                    kept, held = [], 0
        if held:
            yield rows(kept)

    return run


def _merging(capacity: int, threshold: int, width: int):
    def run(batches):
        s = Summary(capacity, threshold)
        for b in batches:
            for keys, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s.add(unpacked(keys, width), np.frombuffer(counts, np.uint32).astype(np.int64))
        left = s.survivors()
        for at in range(0, len(left), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(left[at:at + (1 << 16)].view(np.int64))], ["h"])

    return run


def partitions(spark, mass: int, threshold: int) -> int:
    """Hash partitions: so many that the counters of each, over mass / threshold of its share, fit a task."""
    return min(MOST_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-mass // (threshold * COUNTERS))))


def survivors(texts: DataFrame, lengths, maps: dict, mass: int, threshold: int) -> DataFrame:
    """(h): hashes of n-grams of the given lengths that may occur `threshold` times; each one that does is among them.

    `mass` bounds the number of n-grams.
    """
    parts = partitions(texts.sparkSession, mass, threshold)
    # Hashing deals n-grams evenly; twice the share is over what chance gives.
    capacity = 2 * (-(-mass // (parts * threshold))) + 1
    width = key_bytes(mass)
    rows = texts.mapInArrow(_chunks(lengths, maps, parts, width), "part int, keys binary, counts binary")
    return rows.repartitionById(parts, "part").select("keys", "counts").mapInArrow(_merging(capacity, threshold, width), "h long")


def bitmap(hashes: DataFrame):
    """A map of hashes as array of 64-bit words, of a size with a fixed bound; the words are made by Spark."""
    hashes = checkpoint(hashes)
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * max(1, hashes.count()) - 1).bit_length()))
    at = F.shiftrightunsigned("h", 64 - bits)
    words = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63L as int))")).alias("v")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[words["w"].to_numpy()] = words["v"].to_numpy().view(np.uint64)
    return out


_COUNTS = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


class _Chunk:
    """The n-grams of some slices of text: their hashes, and where each of them stands."""

    def __init__(self):
        self.slices, self.parts, self.held = [], [], 0

    def add(self, lang, words, on):
        first, second = words.grams(lang), words.grams(lang, 1)
        for n in range(1, LONGEST + 1):
            at = possible(words, first, on, n)
            self.parts.append((first[n - 1][at], second[n - 1][at], np.full(len(at), len(self.slices), np.int32), at.astype(np.int32), np.full(len(at), n, np.int8)))
            self.held += len(at)
        self.slices.append((lang, words))

    def counts(self):
        """Rising keys, and (lang, words, phrase, f) for each: n-grams are told apart by 128 bits, and their words are read once."""
        a, c, which, at, n = map(np.concatenate, zip(*self.parts))
        order = np.lexsort((c, a))
        a, c = a[order], c[order]
        edge = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])))) if len(a) else np.zeros(0, int)
        one, f = order[edge], np.diff(np.append(edge, len(a)))
        names = [(self.slices[w][0], k, self.slices[w][1].phrase(i, k)) for w, i, k in zip(which[one].tolist(), at[one].tolist(), n[one].tolist())]
        said = {}
        for lang, words in self.slices:
            said[lang] = said.get(lang, 0) + words.begin
        keys = np.concatenate((a[edge], np.array([_seed(x, 0) for x in said], np.uint64)))
        names, f = names + [(x, 0, "") for x in said], np.concatenate((f, np.fromiter(said.values(), np.int64, len(said))))
        order = np.argsort(keys, kind="stable")
        columns = list(zip(*(names[i] for i in order.tolist())))
        return keys[order], pa.RecordBatch.from_arrays([*(pa.array(x, k.type) for x, k in zip(columns, _COUNTS)), pa.array(f[order])], schema=_COUNTS)


def _total(tables):
    """Tables of counts as one, with one row for each n-gram, in order."""
    t = pa.concat_tables(tables).group_by(_COUNTS.names[:3]).aggregate([("f", "sum")])
    return t.rename_columns({"f_sum": "f"}).select(_COUNTS.names).cast(_COUNTS)


def _ipc(table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _COUNTS) as w:
        w.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _counting(maps, parts: int):
    """Arrow batches of text to rows (part, counts): the n-grams on the maps, and under words 0 all words, counted, added up within the task and packed for each hash partition."""

    def rows(held):
        for part in sorted(held):
            # Names in order share their beginnings, which the shuffle's compression takes out.
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_ipc(_total(held[part]).sort_by([(n, "ascending") for n in _COUNTS.names[:3]]))], pa.binary())], ["part", "counts"])

    def run(batches):
        on, chunk, held, size, fresh = {n: m.value for n, m in maps.items()}, _Chunk(), {}, 0, 0

        def put():
            nonlocal size, fresh
            keys, batch = chunk.counts()
            table = pa.Table.from_batches([batch])
            for p, s, e in _dealt(keys, parts):
                held.setdefault(p, []).append(table.slice(s, e - s))
            fresh += len(keys)
            if fresh > ADDED:
                for p, tables in held.items():
                    held[p] = [_total(tables)]
                size, fresh = sum(t.num_rows for x in held.values() for t in x), 0

        for b in batches:
            for lang, words in buffers(b):
                chunk.add(lang, words, on)
                if chunk.held >= COUNTED or len(chunk.slices) >= 64:
                    put()
                    chunk = _Chunk()
                    if size > ADDED:  # even with each n-gram in one row
                        yield from rows(held)
                        held, size = {}, 0
        if chunk.slices:
            put()
        yield from rows(held)

    return run


def _adding(threshold: int):
    """Packed counts of hash partitions to rows (lang, words, phrase, f), with those below the threshold left out; a partition holds every count of its n-grams."""

    def run(batches):
        tables, rows, last = [_COUNTS.empty_table()], 0, 0
        for b in batches:
            for packed in b.column(0):
                tables.append(pa.ipc.open_stream(packed.as_buffer()).read_all())
                rows += tables[-1].num_rows
                if rows > max(ADDED, 2 * last):
                    tables = [_total(tables)]
                    rows = last = tables[0].num_rows
        t = _total(tables)
        yield from t.filter((pa.compute.field("f") >= threshold) | (pa.compute.field("words") == 0)).to_batches(1 << 14)

    return run


def counts(docs: DataFrame, threshold: int = 100, col: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, words, phrase, f): the exact count of every n-gram of 1 to LONGEST words that occurs `threshold` times or more, and under words 0 the count of all words of each lang."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(col), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text") + 1).cast("long")).first()[0] or 0
    most = size // 2 + 1  # a word takes two bytes with what parts it
    spark, maps = docs.sparkSession, {}
    # Of longer n-grams only those count whose words, and pairs of words, may be frequent themselves.
    for lengths in ((1,), (2,), tuple(range(3, LONGEST + 1))):
        found = spark.sparkContext.broadcast(bitmap(survivors(texts, lengths, maps, most * len(lengths), threshold)))
        maps = maps | dict.fromkeys(lengths, found)
    parts = partitions(spark, most * LONGEST, threshold)
    rows = texts.mapInArrow(_counting(maps, parts), "part int, counts binary")
    return rows.repartitionById(parts, "part").select("counts").mapInArrow(_adding(threshold), "lang string, words int, phrase string, f long")


def score(a, n, l, r):
    """floor(1000 a n / (l r)), exact."""
    wide = lambda c, p: c.cast(f"decimal({p},0)")
    return F.call_function("div", wide(a, 17) * wide(n, 17) * F.lit(1000).cast("decimal(4,0)"), wide(l, 19) * wide(r, 19))


def collocations(found: DataFrame, threshold: int = 100) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of the candidates that no longer one stands for, from rows of counts()."""
    total = found.where("words = 0").select("lang", F.col("f").alias("n"))
    part = found.where("words > 0").select("lang", "phrase", "f")
    cand = found.where((F.col("words") > 1) & (F.col("f") >= threshold)).select("lang", "phrase", "words", F.col("f").alias("a"))
    w = F.split("phrase", " ")
    # A longer candidate as frequent has a part one word longer than this one that is a candidate as frequent, so one step is enough.
    shorter = cand.where("words > 2").select("lang", F.explode(F.array(F.array_join(F.slice(w, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("words") - 1), " "))).alias("phrase"), "a")
    shorter = shorter.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = cand.join(shorter, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")
    halves = alone.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    halves = halves.withColumns({"left": F.array_join(F.slice(w, F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice(w, F.col("k") + 1, F.col("words")), " ")})
    side = lambda name, to: part.select("lang", F.col("phrase").alias(name), F.col("f").alias(to))
    cut = halves.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(total, "lang")
    cut = cut.withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    low = cut.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return low.select("lang", "phrase", "words", "a", "c.l", "c.r", "n", "c.score")


def phrases(docs: DataFrame, threshold: int = 100, top: int = 2000, col: str = "text", lang: str = "lang") -> DataFrame:
    """The first `top` phrases of each lang: lang, rank, phrase, a, l, r, n, score.

    Null text is empty, null lang is `und`; ids are not read, so rows that
    repeat count as often as they stand. A text without words adds nothing, an
    empty table and a lang without candidates give no rows. Texts and words of
    any length are read whole.
    """
    found = checkpoint(counts(docs, threshold, col, lang))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # Ranked by salt first, so that what is ranked in one place is bounded: `top` rows of each salt.
    few = collocations(found, threshold).withColumn("_s", salt_of(F.col("phrase")))
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("_r") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return few.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
