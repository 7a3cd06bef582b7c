"""Benchmark decontamination: prefix-filtered set join with exact verification over item-sized windows."""
from pyspark.sql import DataFrame, functions as F

from .common import ascii_lower, checkpoint, text_col

WINDOW = 10
#: Bytes of benchmark windows broadcast at a time; a larger benchmark goes in blocks.
BLOCK_BYTES = 64 << 20
#: Everything but 0-9, a-z (after lower-casing) and non-ASCII parts words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(col: str = "text"):
    """The array of words of a text; null and empty give an empty array."""
    return F.filter(F.split(ascii_lower(text_col(col)), GAP, -1), lambda w: w != "")


def _windows(benchmark: DataFrame, width: int) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of().alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(width - 1)))
    win = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("win"))
    return win.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _blocks(win: DataFrame, limit: int) -> int:
    size = win.agg(F.sum(F.octet_length(F.array_join("win", " ")) + 24 * F.size("items") + 64)).first()[0] or 0
    return -(-int(size) // limit)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Return doc_id, n_words, n_hit, n_items, items_sha256, contaminated per row of docs.

    A window is `width` consecutive item words; a shorter, not empty item is one
    window. Words have their frequency counted over all documents; a window's
    prefix is its rarest word, which any document that contains the window must
    hold. Documents' words join the prefixes, position and length bounds cut the
    candidates, and the slice of the document is compared word by word. The
    windows are broadcast in blocks of checked size. Null and empty texts have
    no words; rows that repeat an id with one text get equal results; null items
    and an empty benchmark hit nothing; other columns are not read.
    """
    win = checkpoint(_windows(benchmark, width))
    key = F.md5(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("~")), text_col()))
    n_blocks = _blocks(win, block_bytes)
    hits = None
    if n_blocks:
        vocab = win.select(F.explode("win").alias("word")).distinct()
        parsed = docs.select(words_of().alias("w"))
        seen = parsed.select(F.explode("w").alias("word"))
        held = None
        for b in range(n_blocks):
            part = vocab.where(F.pmod(F.xxhash64("word"), F.lit(n_blocks)) == b)
            one = seen.join(F.broadcast(part), "word").groupBy("word").agg(F.count("*").alias("df"))
            held = one if held is None else held.unionByName(one)
        df = checkpoint(held)
        # A window with a word that no document holds cannot occur.
        toks = win.select("win", "items", F.posexplode("win").alias("at", "word")).join(df, "word")
        best = toks.groupBy("win", "items").agg(F.min(F.struct("df", "at", "word")).alias("p"), F.count("*").alias("found")).where("found = size(win)")
        best = checkpoint(best.select("win", "items", F.col("p.word").alias("word"), F.col("p.at").alias("at"), F.size("win").alias("len")))
        src = docs.select(key.alias("_k"), words_of().alias("w")).select("_k", "w", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
        for b in range(n_blocks):
            part = best.where(F.pmod(F.xxhash64("win"), F.lit(n_blocks)) == b)
            # The comparison runs in the generator's own codegen span, so the word array is not copied per word.
            one = src.join(F.broadcast(part), "word").where(
                "pos >= at and pos - at + len <= n and slice(w, pos - at + 1, len) = win"
            ).select("_k", (F.col("pos") - F.col("at")).alias("start"), "len", "items")
            hits = one if hits is None else hits.unionByName(one)
        hits = checkpoint(hits)
    base = docs.select(F.col(id_col).alias("doc_id"), key.alias("_k"), F.size(words_of()).cast("long").alias("n_words"))
    if hits is None:
        out = base.withColumns({"n_hit": F.lit(None).cast("long"), "items": F.lit(None).cast("array<string>")})
    else:
        pos = hits.select("_k", F.explode(F.expr("sequence(start, start + len - 1)")).alias("p")).distinct().groupBy("_k").agg(F.count("*").alias("n_hit"))
        items = hits.select("_k", F.explode("items").alias("i")).distinct().groupBy("_k").agg(F.array_sort(F.collect_list("i")).alias("items"))
        out = base.join(pos, "_k", "left").join(items, "_k", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
