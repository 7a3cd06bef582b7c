"""Text comparison: normalised characters and words, edit distance, error rates."""
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Fixed value: cells of an edit table. A longer pair is not rated, and neither is what it is part of; it must be parted first.
BUDGET = 4_000_000


def normalise(text: str) -> str:
    """NFKC, case-folded, without punctuation."""
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if unicodedata.category(c)[0] != "P")


def letters(a: list, b: list) -> tuple:
    """Two word lists as strings of one letter a word, the same letter for the same word."""
    known = {}
    for w in (*a, *b):
        known.setdefault(w, len(known))
    # From U+0100 on, past the surrogates.
    letter = {w: chr(256 + i + (2048 if i >= 0xD700 else 0)) for w, i in known.items()}
    return tuple("".join(map(letter.__getitem__, x)) for x in (a, b))


def edits(a, b):
    """Insertions, deletions and replacements from string column a to b; null beyond the budget."""
    return F.when(F.length(a).cast("long") * F.length(b) <= BUDGET, F.levenshtein(a, b)).cast("long")


def compare(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, char_errors, reference_chars, word_errors, reference_words, inserted, over_budget) of rows with reference and hypothesis; null texts are empty.

    Characters leave out white space. `inserted` counts hypothesis characters
    where the reference has none. A pair whose characters or words pass the
    budget has null errors there and is `over_budget`.
    """
    full = StructType([*(pairs.schema[k] for k in keys), *StructType.fromDDL("ca string, cb string, wa string, wb string").fields])
    arrow = to_arrow_schema(full)

    def one(r):
        a, b = (normalise(r[c] or "").split() for c in ("reference", "hypothesis"))
        return (*(r[k] for k in keys), "".join(a), "".join(b), *letters(a, b))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, one(r))) for r in b.to_pylist()], arrow)

    # Only the normal form needs Python; the distances are the engine's own.
    c = pairs.select(*keys, "reference", "hypothesis").mapInArrow(run, full)
    n = lambda x: F.length(x).cast("long")
    return c.select(
        *keys, edits("ca", "cb").alias("char_errors"), n("ca").alias("reference_chars"), edits("wa", "wb").alias("word_errors"), n("wa").alias("reference_words"),
        F.when(n("ca") > 0, 0).otherwise(n("cb")).alias("inserted"), (edits("ca", "cb").isNull() | edits("wa", "wb").isNull()).cast("long").alias("over_budget"),
    )


def rate(errors, count):
    """errors / count; 0 of 0 is 0, some of 0 is null."""
    return F.when(count > 0, errors / count).when(errors == 0, F.lit(0.0))


def error_rates(compared: DataFrame, *keys: str) -> DataFrame:
    """Micro-averaged CER and WER over compare() rows; null, like their errors, where a pair is over the budget, as the rest would flatter them."""
    names = ("char_errors", "reference_chars", "word_errors", "reference_words", "inserted", "over_budget")
    m = compared.groupBy(*keys).agg(*[(F.when(F.count(c) == F.count(F.lit(1)), F.coalesce(F.sum(c), F.lit(0)))).alias(c) for c in names])
    return m.withColumns({"cer": rate(F.col("char_errors"), F.col("reference_chars")), "wer": rate(F.col("word_errors"), F.col("reference_words"))})


def repeats(text):
    """Column: whether a piece of 1 to 32 characters stands four times in a row, white space aside; false for null. Compatibility forms count as written; normalise() first where they should not. A mark for review, as choruses repeat too."""
    compact = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")
    return compact.rlike(r"(?s)(.{1,32}?)\1{3,}")
