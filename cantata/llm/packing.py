"""Best-fit packing: a grouping genetic algorithm on islands."""
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpoint

LENGTH = 2048
#: Pieces per block: bounds a task's memory and time whatever the input.
BLOCK = 20000
_PART = b"\x01"
#: A stretch that ends in a Latin letter and then ASCII punctuation, where the vocabulary parts it in any case: so a word is encoded once whatever marks follow it.
_END = re.compile(rb"([^\x00-\x20]*(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf]))([!-/:-@\[-`{-~]+)", re.S).fullmatch


#: A stretch of lower-case Latin letters only: one word to the vocabulary, which leaves it as it is, so its bytes go straight to the merges.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+").fullmatch
#: The characters by which byte-level vocabularies name those bytes, read as Latin-1, where they are others.
_NAMES = {0xA0: 0x142, 0xAD: 0x143}
_TRIAL = "a", "e", "strasse", "hello", "ÿöà", "ñandú", "internationalisation"


def _encode(tok, words, seen):
    """Ids of each stretch into `seen`: many go in one call, parted by a control character that is one token."""
    plain = [w for w in words if not (b"<|" in w or _PART in w)]
    alone = [[w] for w in set(words).difference(plain)]
    groups = [plain[i:i + 256] for i in range(0, len(plain), 256)] + alone
    found = tok.encode_batch_fast([f" {_PART.decode()} ".join(w.decode() for w in g) for g in groups], add_special_tokens=False)
    mark = tok.encode(_PART.decode(), add_special_tokens=False).ids
    assert len(mark) == 1, "the vocabulary has no single token for the mark"
    for g, e in zip(groups, found):
        ids = np.array(e.ids, "<u4")
        cut = np.flatnonzero(ids == mark[0]).tolist() if len(g) > 1 else []
        assert len(cut) == len(g) - 1
        buf = ids.tobytes()
        for w, i, j in zip(g, [-1, *cut], [*cut, len(ids)]):
            seen[w] = buf[4 * i + 4:4 * j]


#: Stretches remembered in one generation of a worker's cache; a full generation stays readable until the next is full. Idle workers keep theirs.
REMEMBERED = 200000


class _Ids:
    """A vocabulary and the ids of stretches met before; one per worker process and path, so that tasks of one worker share it."""

    of = {}

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok, self.seen, self.before = Tokenizer.from_file(path), {}, {}
        self.merge, self.four = self.tok.model.tokenize, [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]
        # Only where the vocabulary is known to leave letters as they are.
        self.direct = all(self._merged(w) == np.array(self.tok.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for w in map(str.encode, _TRIAL))

    def _merged(self, word):
        four = self.four
        return b"".join([four[t.id] for t in self.merge(word.decode() if word.isascii() else word.decode("latin-1").translate(_NAMES))])

    @staticmethod
    def get(path):
        if path not in _Ids.of:
            _Ids.of[path] = _Ids(path)
        return _Ids.of[path]

    def __call__(self, text):
        # Tokens never cross ASCII white space, so each stretch is encoded once and its ids are remembered as
        # bytes. The vocabulary ignores case, but not that of a control string.
        raw = (text or "").encode()
        words = (raw if b"<|" in raw else raw.lower()).split()
        if len(self.seen) > REMEMBERED:
            self.seen, self.before = {}, self.seen
        parts = list(map(self.seen.get, words))
        # Each stretch is looked up once; only those not found are looked at again.
        gaps, at = [], -1
        for _ in range(parts.count(None)):
            at = parts.index(None, at + 1)
            gaps.append(at)
        if gaps:
            self._learn({words[i] for i in gaps})
            for i in gaps:
                parts[i] = self.seen[words[i]]
        parts.append(bytes(4))
        return b"".join(parts)

    def _learn(self, new):
        seen, before, ends, ask = self.seen, self.before, {}, set()
        for w in new:
            if (ids := before.get(w)) is not None:
                seen[w] = ids
            elif self.direct and _LETTERS(w):
                seen[w] = self._merged(w)
            elif m := _END(w):
                ends[w] = m.groups()
                ask.update(m.groups())
            else:
                ask.add(w)
        need = []
        for w in ask.difference(seen):
            if (ids := before.get(w)) is not None:
                seen[w] = ids
            elif self.direct and _LETTERS(w):
                seen[w] = self._merged(w)
            else:
                need.append(w)
        if need:
            _encode(self.tok, need, seen)
        for w, (head, tail) in ends.items():
            seen[w] = seen[head] + seen[tail]


def _token_pieces(path, length):
    def run(batches):
        ids_of = _Ids.get(path)
        for b in batches:
            rows, at = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = ids_of(text)
                for k in range(0, len(ids), 4 * length):
                    part = ids[k:k + 4 * length]
                    rows.append((k // (4 * length), k // 4, len(part) // 4, zlib.crc32(part)))
                    at.append(i)
            doc = b.column("doc_id").take(pa.array(at, pa.int64()))
            cols = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([doc, *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64())))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class Bins:
    """Open bins by free space; best fit takes the fullest that still has room."""

    def __init__(self, size):
        self.size, self.by_free, self.mask = size, {}, 0
        self.bins = []

    def open(self, members, used):
        self.bins.append(members)
        self._put(len(self.bins) - 1, self.size - used)

    def _put(self, i, free):
        if free:
            self.by_free.setdefault(free, []).append(i)
            self.mask |= 1 << free

    def add(self, item, n):
        m = self.mask >> n
        if not m:
            return self.open([item], n)
        free = n + (m & -m).bit_length() - 1
        here = self.by_free[free]
        i = here.pop()
        if not here:
            self.mask ^= 1 << free
        self.bins[i].append(item)
        self._put(i, free - n)


def fill(b, n):
    return sum(n[i] for i in b)


def worth(bins, n, size):
    """Fewer bins first, then fuller ones: space in few bins is of more use than a little in each."""
    return -len(bins), sum((fill(b, n) / size) ** 2 for b in bins)


def best_fit(order, n, size):
    b = Bins(size)
    for i in order:
        b.add(i, n[i])
    return b.bins


def least_bins(n, size):
    return -(-sum(n) // size)


def first_population(n: list, size: int, population: int, seed: int) -> list:
    """Best-fit decreasing, and best fit over shaken orders; only the first where it is proven best."""
    rng, a = np.random.default_rng(seed), np.array(n, float)
    pool = [best_fit(np.argsort(-a, kind="stable").tolist(), n, size)]
    while len(pool) < population and len(pool[0]) > least_bins(n, size):
        pool.append(best_fit(np.argsort(-a * rng.uniform(0.8, 1.0, len(a)), kind="stable").tolist(), n, size))
    return sorted(pool, key=lambda p: worth(p, n, size), reverse=True)


def crossover(into: list, giver: list, n: list, size: int, rng) -> list:
    """Inject whole well-filled bins of one parent into the other, drop the bins that repeat one of their items, and best-fit the displaced items, longest first."""
    whole = sorted((b for b in giver if fill(b, n) >= size * 0.995), key=lambda b: fill(b, n), reverse=True)
    given = [b for b in whole if rng.random() < 0.5]
    taken = {x for b in given for x in b}
    child, loose = Bins(size), []
    for b in given:
        child.open(list(b), fill(b, n))
    for b in into:
        if taken.isdisjoint(b):
            child.open(list(b), fill(b, n))
        else:
            loose += [x for x in b if x not in taken]
    for x in sorted(loose, key=lambda x: -n[x]):
        child.add(x, n[x])
    return child.bins


def generations(pool: list, n: list, size: int, times: int, seed: int) -> list:
    """Crossovers within one island's population; stops where the best is proven best."""
    rng, most = np.random.default_rng(seed), len(pool)
    for _ in range(times):
        if most < 2 or len(pool[0]) <= least_bins(n, size):
            break
        i, j = rng.choice(len(pool), 2, replace=False)
        pool = sorted(pool + [crossover(pool[i], pool[j], n, size, rng)], key=lambda p: worth(p, n, size), reverse=True)[:most]
    return pool


def _flat(bins, n):
    """A packing as the bin number of each item."""
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out.tolist()


def _bins(flat):
    out = [[] for _ in range(max(flat, default=-1) + 1)]
    for i, k in enumerate(flat):
        out[k].append(i)
    return out


_POOL = "block long, island int, n array<int>, pool array<array<int>>, best int, open boolean"


_ARROW = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("n", pa.list_(pa.int32())), ("pool", pa.list_(pa.list_(pa.int32()))), ("best", pa.int32()), ("open", pa.bool_())])


def _batch(rows):
    return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r)) for r in rows], _ARROW)


def _row(block, island, n, pool, size):
    return block, island, n, [_flat(p, len(n)) for p in pool], len(pool[0]), len(pool[0]) > least_bins(n, size)


def _settle(size, population, islands):
    """The islands of a block: all hold the block's lengths, each has a population of its own; one island where best-fit decreasing is proven best."""

    def run(key, t):
        block = key[0].as_py()
        n = sorted(t.column("length").to_pylist(), reverse=True)
        rows = []
        for k in range(islands):
            rows.append(_row(block, k, n, first_population(n, size, population, block * islands + k), size))
            if not rows[0][-1]:
                break
        return pa.Table.from_batches([_batch(rows)])

    return run


def _live(size, times, turn):
    """A stretch of generations on each island, after the guest has taken the place of the worst."""

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                n, pool = r["n"], [_bins(p) for p in r["pool"]]
                if r["guest"] is not None:
                    pool = sorted(pool[:-1] + [_bins(r["guest"])], key=lambda p: worth(p, n, size), reverse=True)
                rows.append(_row(r["block"], r["island"], n, generations(pool, n, size, times, hash((r["block"], r["island"], turn)) & 0xFFFFFFFF), size))
            yield _batch(rows)

    return run


def evolve(cells: DataFrame, size: int, rounds: int, times: int) -> DataFrame:
    """Rounds of generations on islands (_POOL rows), with the best packing of each island handed to the next one between rounds; returns block and the best packing found on any island."""
    done = cells.where("not open")
    live = cells.where("open").withColumn("guest", F.lit(None).cast("array<int>"))
    for turn in range(rounds):
        if live.isEmpty():
            break
        out = checkpoint(live.mapInArrow(_live(size, times, turn), _POOL))
        ring = F.max("island").over(Window.partitionBy("block")) + 1
        guests = out.select("block", ((F.col("island") + 1) % ring).alias("island"), F.get("pool", F.lit(0)).alias("guest"))
        live = out.join(guests, ["block", "island"])
    every = done.unionByName(live.drop("guest"))
    return every.groupBy("block").agg(F.min_by(F.get("pool", F.lit(0)), F.struct("best", "island")).alias("flat"))


def _place(size, elite):
    """The pieces of a block with their places in the best packing; bins full to `elite` are final."""

    def run(key, pieces, best):
        pieces = pieces.sort_by([("length", "descending"), ("rid", "ascending")])
        n, flat = pieces.column("length").to_numpy(), np.array(best.column("flat")[0].as_py(), np.int64)
        order = np.argsort(flat, kind="stable")
        before, bins = np.cumsum(n[order]) - n[order], flat[order]
        first = np.searchsorted(bins, bins)
        offset = np.empty(len(n), np.int64)
        offset[order] = before - before[first]
        final = np.bincount(flat, weights=n)[flat] >= size * elite
        return pieces.append_column("sequence_id", pa.array(flat, pa.int64())).append_column("offset", pa.array(offset)).append_column("final", pa.array(final))

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, block: int = BLOCK, elite: float = 0.999, population: int = 4, islands: int = 4, rounds: int = 3, times: int = 6) -> DataFrame:
    """Return doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece of every row.

    Each document is its ids, then id 0; null text is only that id. Full pieces
    are sequences of their own. The rest is dealt to blocks of bounded size,
    whatever the rows hold. On each block, islands evolve packings of their own
    and hand their best to the next island between rounds; a block whose best-fit
    decreasing packing reaches the lower bound is done at once. Bins full to
    `elite` are final, and what is left is dealt anew among fewer blocks. Rows
    that repeat, and rows without an id, are packed like others. No rows give no
    rows. Long texts are cut only by `length`.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cols = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = checkpoint(src.mapInArrow(_token_pieces(tokenizer, length), cols).withColumn("rid", F.monotonically_increasing_id()))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    done = pieces.where(F.col("length") == length).select("*", (-F.col("rid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).select(names)
    rest = pieces.where(F.col("length") < length)
    for turn, keep in enumerate((elite, 0.0)):
        n = max(1, -(-rest.count() // block))
        dealt = rest.withColumn("block", F.pmod(F.xxhash64("rid", F.lit(turn)), F.lit(n)))
        cells = checkpoint(dealt.select("block", "length").groupBy("block").applyInArrow(_settle(length, population, islands), _POOL))
        best = evolve(cells, length, rounds, times)
        placed = dealt.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(_place(length, keep), f"{cols}, rid long, block long, sequence_id long, offset long, final boolean")
        out = checkpoint(placed).withColumn("sequence_id", F.expr(f"(block * 2 + {turn}) * {1 << 32}L + sequence_id"))
        done = done.unionByName(out.where("final").select(names))
        rest = out.where("not final").select(*names[:5], "rid")
    return done
