"""SimHash near-dedup with a Gray-order hierarchical index."""
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import SALTS, bits_to_salts, checkpoint, salt_bits, salt_of
from .components import components

#: Codes per upper node, on average over chance codes, up to which fewer patterns serve; and codes of one task.
NODE, SPLIT = 512, 20000
#: Up to so many hot nodes, of two longs each, are broadcast.
FEW_HOT = 500_000
#: Shingles hashed at a time: bounds memory on very long texts.
CHUNK = 1 << 14
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, k: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text's k-word shingles, repeats included; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - k + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(k, len(words)) - 1:].tolist()
    h, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        v = np.array([h(joined[a:b], seed) for a, b in zip(starts[i:i + CHUNK], stops[i:i + CHUNK])], "<u8")
        total += np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * total > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for b in batches:
        v = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(v.view(np.int64))], ["doc_id", "fp"])


def gray_rank(v: np.ndarray) -> np.ndarray:
    """Position of each code in Gray order."""
    v = v.copy()
    for s in (1, 2, 4, 8, 16, 32):
        v ^= v >> np.uint64(s)
    return v


class GrayIndex:
    """Codes in Gray order; each node holds the bits that all its codes share.

    linked(d) gives a spanning forest of the pairs at distance d or less: a
    search from a code takes every code within reach out of the index, and
    those are searched from in turn. The differences from a node's shared bits
    add up on the way down: beyond d the whole node is left out; where even its
    free bits cannot exceed d the whole node is taken.
    """

    LEAF = 64

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        self.top = self._node(np.arange(len(codes)))

    def _node(self, at):
        """[bits all ones, bits all zeros, children or None, codes left]"""
        c = self.codes[at]
        one, zero = int(np.bitwise_and.reduce(c)), int(np.bitwise_and.reduce(~c))
        if len(at) <= self.LEAF:
            return [one, zero, None, at]
        mid = len(at) // 2
        return [one, zero, (self._node(at[:mid]), self._node(at[mid:])), len(at)]

    @staticmethod
    def _left(node):
        return node[3] if node[2] else len(node[3])

    def _all(self, node, out):
        if node[2]:
            for k in node[2]:
                self._all(k, out)
            node[3] = 0
        else:
            out.append(node[3])
            node[3] = node[3][:0]

    def _take(self, node, code, d, out):
        differ = (node[0] & ~code | node[1] & code).bit_count()
        if differ > d or not self._left(node):
            return
        if differ + 64 - (node[0] | node[1]).bit_count() <= d:
            self._all(node, out)
        elif node[2]:
            for k in node[2]:
                self._take(k, code, d, out)
            node[3] = sum(map(self._left, node[2]))
        else:
            near = np.bitwise_count(self.codes[node[3]] ^ np.uint64(code)) <= d
            if near.any():
                out.append(node[3][near])
                node[3] = node[3][~near]

    def linked(self, d):
        pairs, seen = [], np.zeros(len(self.codes), bool)
        for start in range(len(self.codes)):
            if seen[start]:
                continue
            seen[start], todo = True, [start]
            while todo:
                i = todo.pop()
                out = []
                self._take(self.top, int(self.codes[i]), d, out)
                for j in np.concatenate(out).tolist() if out else ():
                    if not seen[j]:
                        seen[j] = True
                        todo.append(j)
                        pairs.append((int(self.order[i]), int(self.order[j])))
        return pairs


def _node_links(d):
    """Spanning forests of the upper nodes in rows sorted by (tab, key, part); a node may run over several batches."""

    def run(batches):
        held = []
        for b in batches:
            ids = np.stack([b.column(c).to_numpy() for c in ("tab", "key", "part", "fp", "node")])
            if not ids.shape[1]:
                continue
            cuts = np.flatnonzero((ids[:3, 1:] != ids[:3, :-1]).any(0)) + 1
            if held and (held[-1][:3, -1] != ids[:3, 0]).any():
                yield from _forest(np.concatenate(held, axis=1), d)
                held = []
            if len(cuts):
                yield from _forest(np.concatenate([*held, ids[:, :cuts[-1]]], axis=1), d)
                held = []
                ids = ids[:, cuts[-1]:]
            held.append(ids)
        if held:
            yield from _forest(np.concatenate(held, axis=1), d)

    return run


def _forest(ids, d):
    edges = np.flatnonzero((ids[:3, 1:] != ids[:3, :-1]).any(0)) + 1
    bounds = np.concatenate(([0], edges, [ids.shape[1]]))
    out = []
    for r in np.flatnonzero(np.diff(bounds) > 1).tolist():
        codes, node = ids[3, bounds[r]:bounds[r + 1]].view(np.uint64), ids[4, bounds[r]:bounds[r + 1]]
        out += [(node[i], node[j]) for i, j in GrayIndex(codes).linked(d)]
    if out:
        a, b = np.array(out, np.int64).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def blocks_for(n: int, d: int = 4, most: int = NODE):
    """The fewest blocks of the 64 bits, as (shift, width), with at most `most` of n chance codes in an upper node: d differing bits leave all but d blocks equal."""
    for m in range(d + 1, d + 4):
        cuts = [64 * i // m for i in range(m + 1)]
        if n >> min(sum(b - a for a, b in zip(cuts, cuts[1:])) * (m - d) // m, 62) <= most:
            break
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _upper_nodes(nodes: DataFrame, blocks: list, d: int) -> DataFrame:
    """tab, key, part, fp, node: each code under every masked pattern of all but d blocks, which is the upper node's shared bits.

    An upper node beyond SPLIT codes is cut into groups in Gray order; the
    differences of what two groups share are added up, and only pairs of groups
    within reach go on, each as a part of its own.
    """
    keys = []
    for t, chosen in enumerate(combinations(blocks, len(blocks) - d)):
        at = [sum(w for _, w in chosen[:i]) for i in range(len(chosen))]
        parts = [f"shiftleft((shiftrightunsigned(fp, {s}) & {(1 << w) - 1}L), {o})" for o, (s, w) in zip(at, chosen)]
        keys.append(F.struct(F.lit(t).cast("long").alias("tab"), F.expr(" | ".join(parts)).alias("key")))
    dealt = nodes.select("fp", "node", F.explode(F.array(*keys)).alias("x")).select("x.tab", "x.key", "fp", "node")
    hot = checkpoint(dealt.groupBy("tab", "key").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT))
    count, rows = hot.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    whole = F.lit(0).cast("long").alias("part")
    if not rows:
        return dealt.select("tab", "key", whole, "fp", "node")
    # At most one hot node per SPLIT rows: they go along with the plan while they are few, else they meet the codes by salt.
    on = ["tab", "key"]
    few = F.broadcast(hot.select(*on))
    if count > FEW_HOT:
        on, dealt = [*on, "s"], dealt.withColumn("s", salt_of(F.col("fp")))
        few = hot.select("tab", "key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    cold = dealt.join(few, on, "left_anti").select("tab", "key", whole, "fp", "node")
    warm = dealt.join(few, on).select("tab", "key", "fp", "node", F.col("fp").alias("rank"))
    for s in (1, 2, 4, 8, 16, 32):
        warm = warm.withColumn("rank", F.expr(f"rank ^ shiftrightunsigned(rank, {s})"))
    warm = checkpoint(warm.repartitionByRange(-(-2 * rows // SPLIT), "tab", "key", "rank").withColumn("g", F.spark_partition_id().cast("long")).drop("rank"))
    groups = warm.groupBy("tab", "key", "g").agg(F.expr("bit_and(fp)").alias("one"), F.expr("bit_and(~fp)").alias("zero"))
    other = groups.select("tab", "key", F.col("g").alias("h"), F.col("one").alias("one2"), F.col("zero").alias("zero2"))
    near = groups.join(other, ["tab", "key"]).where(F.expr(f"g <= h and bit_count((one & zero2) | (zero & one2)) <= {d}"))
    pair = near.select("tab", "key", "g", "h", (F.col("g") * (1 << 31) + F.col("h") + 1).alias("part"))
    sides = pair.select("tab", "key", "part", F.explode(F.array_distinct(F.array("g", "h"))).alias("g"))
    return cold.unionByName(warm.join(sides, ["tab", "key", "g"]).select("tab", "key", "part", "fp", "node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", distance: int = 4) -> DataFrame:
    """Return doc_id, fingerprint (16 hex digits), component_id for every row.

    Equal fingerprints fold to one node, named by its smallest id. The index has
    two levels. Its upper nodes factor masked bit patterns: all but `distance`
    of the code's blocks, so that two codes within reach share an upper node,
    and no link is lost; more codes get finer patterns. Under an upper node the
    codes stand in Gray order and give a spanning forest, never all pairs. Null
    and empty texts have fingerprint zero and link like others; rows without an
    id keep their fingerprint and get component_id through it (null if no id is
    there); repeated ids share the fingerprint of each row's own text; texts of
    any length are read whole; an empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fps = checkpoint(src.mapInArrow(_fingerprints, "doc_id long, fp long").withColumn("s", salt_of(F.col("doc_id"))))
    nodes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("node"), salt_bits("s").alias("bits")))
    known = nodes.where("node is not null")
    dealt = _upper_nodes(known.select("fp", "node"), blocks_for(known.count(), distance), distance)
    dealt = dealt.repartition("tab", "key", "part").sortWithinPartitions("tab", "key", "part")
    links = dealt.mapInArrow(_node_links(distance), "a long, b long")
    comp = components(links)
    named = nodes.join(comp, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"), bits_to_salts("bits").alias("s"))
    return fps.join(named, ["fp", "s"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
