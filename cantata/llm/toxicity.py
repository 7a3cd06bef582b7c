"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

BITS = 20
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@dataclass(frozen=True)
class Model:
    """Non-zero weights only: slots, their weights, and the bias."""
    slots: np.ndarray
    weights: np.ndarray
    bias: float


class Features:
    """Slots of a text's words, the stems of its longer words, word pairs and pairs that skip one word.

    A stem is a word's first letters: inflected forms of one rare word share it.
    """

    #: Words remembered; at about 350 bytes a word they stay under 50 MB in a worker.
    MOST = 1 << 17
    STEMS = (5, 6, 7)

    def __init__(self):
        self.seen, self.stems = {}, {}

    def __call__(self, text) -> np.ndarray:
        if len(self.seen) > self.MOST:
            self.seen.clear()
            self.stems.clear()
        seen, stems, words = self.seen, self.stems, _WORD.findall((text or "").lower())
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
            stems[w] = [xxhash.xxh64_intdigest(w[:n].encode("utf-8", "replace"), n) for n in self.STEMS if len(w) > n]
        a = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        s = np.array([h for w in sorted(set(words)) for h in stems[w]], np.uint64)
        with np.errstate(over="ignore"):
            parts = [a * _MIX[0], s * _MIX[1], (a[:-1] * _MIX[1]) ^ (a[1:] * _MIX[0] + _MIX[2]), (a[:-2] * _MIX[2]) ^ (a[2:] * _MIX[1] + _MIX[0])]
            v = np.concatenate(parts) * _MIX[0]
        return (v >> np.uint64(64 - BITS)).astype(np.int32)


def _sample_features(batches):
    f = Features()
    for b in batches:
        xs = [np.unique(f(t)) for t in b.column("text").to_pylist()]
        keys = [xxhash.xxh64_intdigest(x.tobytes()) >> 1 for x in xs]
        yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(keys, pa.int64()), pa.array(xs, pa.list_(pa.int32()))], ["y", "k", "x"])


def _train_task(rates):
    """One task over the bounded sample: the slots of its texts in, the non-zero weights out; slot -1 is the bias."""

    def run(batches):
        ys, xs = [], []
        for b in batches:
            ys += b.column("y").to_pylist()
            # Views of the batch's own memory, 4 bytes a slot.
            flat, cut = b.column("x").flatten().to_numpy(), b.column("x").offsets.to_numpy()
            xs += [flat[i - cut[0]:j - cut[0]] for i, j in zip(cut[:-1], cut[1:])]
        if ys:
            m = train(xs, np.array(ys), **rates)
            slots, weights = np.append(m.slots, -1).astype(np.int32), np.append(m.weights, m.bias)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(weights)], ["slot", "weight"])

    return run


def sample(docs: DataFrame, labels: DataFrame, most: int = 1500) -> DataFrame:
    """y, k, x of at most `most` labelled texts of each class, chosen by the hash of their id; k is the hash of x."""
    known = labels.where("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 3 <> 1")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    pick = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    pick = pick[0].unionByName(pick[1])
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(pick), "doc_id").select(F.col("y").cast("int").alias("y"), "text")
    return rows.mapInArrow(_sample_features, "y int, k long, x array<int>")


def fit(docs: DataFrame, labels: DataFrame, most: int = 1500, **rates) -> Model:
    """Fit on at most `most` labelled texts of each class, in one executor task; only non-zero weights come to the driver.

    Rows whose crc32(id) mod 3 is 1 are held out. Null labels and ids are left
    out; a document labelled twice is toxic if either says so, and a document
    that stands twice is in the sample twice. With no labels the model is empty
    and scores 0.5; with one class only it is what the bias learns.
    """
    one = sample(docs, labels, most).repartition(1).sortWithinPartitions("k", "y")
    got = one.mapInArrow(_train_task(rates), "slot int, weight double").toPandas()
    bias = float(got["weight"][got["slot"] == -1].sum())
    got = got[got["slot"] >= 0].sort_values("slot")
    return Model(got["slot"].to_numpy(np.int32), got["weight"].to_numpy(float), bias)


def cross_validate(xs: list, ys, keys, folds: int = 4, threshold: float = THRESHOLD, **rates) -> tuple:
    """(toxic found, toxic, false alarms, clean, log loss) over folds of the training rows by their key, each fold scored by a fit on the others."""
    part, scores = np.asarray(keys) // 7 % folds, np.zeros(len(ys))
    for k in range(folds):
        m = train([x for x, p in zip(xs, part) if p != k], ys[part != k], **rates)
        dense = np.zeros(1 << BITS)
        dense[m.slots] = m.weights
        for i in np.flatnonzero(part == k):
            scores[i] = 1 / (1 + np.exp(-np.clip(dense[xs[i]].sum() + m.bias, -500, 500)))
    p, hit = np.clip(scores, 1e-6, 1 - 1e-6), scores >= threshold
    loss = -np.mean(np.where(ys == 1, np.log(p), np.log(1 - p)))
    return int(hit[ys == 1].sum()), int((ys == 1).sum()), int(hit[ys == 0].sum()), int((ys == 0).sum()), float(loss)


def train(xs: list, ys, epochs: int = 20, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, least: int = 3, balance: float = 1.0) -> Model:
    """FTRL-proximal over binary slots; a slot that fewer than `least` texts hold, or more than a quarter of the clean ones share, carries no evidence and is left out."""
    one = 1 << BITS  # the slot of the bias
    z, n = np.zeros(one + 1), np.zeros(one + 1)
    held = np.zeros(one + 1, np.int64)
    for x in xs:
        held[x] += 1
    # Judged by clean texts alone, so that the balance of the sample does not decide on a marker of toxic ones.
    clean = np.zeros(one + 1, np.int64)
    for x, y in zip(xs, ys):
        if y == 0:
            clean[x] += 1
    use = (held >= least) & (clean <= max(least, (ys == 0).sum() // 4))
    xs = [np.append(x[use[x]], one) for x in xs]
    gain = np.where(ys == 1, min(10.0, max(1.0, (ys == 0).sum() / max(1, (ys == 1).sum()))), 1.0) ** balance

    def weights(i):
        zi = z[i]
        pen = np.where(i == one, 0.0, l1)
        return np.where(np.abs(zi) <= pen, 0.0, (np.sign(zi) * pen - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    # Each pass takes the texts in an order of its own, so that no one order decides; texts come sorted by the hash of their slots.
    for e in range(epochs):
        for r in np.random.default_rng(e).permutation(len(xs)).tolist():
            x, y, c = xs[r], ys[r], gain[r]
            w = weights(x)
            g = c * (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y)
            s = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / alpha
            z[x] += g - s * w
            n[x] += g * g
    w = weights(np.arange(one + 1))
    slots = np.flatnonzero(w[:-1]).astype(np.int32)
    return Model(slots, w[slots], float(w[-1]))


def _scorer(model: Model):
    """Scores of a batch of texts; null text gets the bias alone."""
    f, dense = Features(), np.zeros(1 << BITS, np.float64)
    dense[model.slots] = model.weights

    def scores(texts):
        out = []
        for t in texts:
            x = f(t)
            out.append(dense[np.unique(x[dense[x] != 0])].sum() + model.bias)
        return 1 / (1 + np.exp(-np.clip(np.array(out, float), -500, 500)))

    return scores


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Return doc_id, held_out, score, predicted per row; null text is empty, and gets the bias alone. A null id is not held out. Rows that repeat stay."""

    def run(batches):
        scores = _scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(b.column("text").to_pylist()))], ["doc_id", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    s = src.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False))
    return s.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that are not predicted toxic; each is judged by its own text."""

    def run(batches):
        scores = _scorer(model)
        for b in batches:
            yield b.filter(pa.array(scores(b.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
