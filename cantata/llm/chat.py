"""Chat formatting with Spark expressions only."""
from pyspark.sql import DataFrame, functions as F

from .common import cut

#: NEWLINE stands for a line break inside a role.
START, TURN, END, NEWLINE = "<|im_start|>", "<|turn|>", "<|im_end|>", "<|nl|>"


def _escape(c):
    # One more backslash between "<" and "|"; no control string survives inside a text.
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def _unescape(c):
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def format_chats(conv: DataFrame) -> DataFrame:
    """Return conv_id, formatted, mask (array of runs: n_chars, loss).

    Turns are sorted by (turn, role, text), nulls first; adjacent turns of one
    role share a block and stay apart by a turn mark, so every turn can be read
    back. Null text is empty, a null role is the empty role, a null conv_id is
    one conversation of its own. Repeated rows stay; texts of any length are kept whole; an empty table
    gives an empty result; other columns are not read. A conversation becomes one
    row, as the format demands. The mask runs cover the
    whole output in order; loss is true over the escaped assistant texts.
    """
    role = F.replace(_escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit(NEWLINE))
    turns = conv.select("conv_id", F.struct(F.col("turn"), role.alias("role"), _escape(F.coalesce("text", F.lit(""))).alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    parts = F.expr(
        f"""transform(ts, (t, i) -> struct(
            if(i > 0 and get(ts, i - 1).role = t.role, '{TURN}', concat('{START}', t.role, '\n')) as head,
            t.text as body,
            if(get(ts, i + 1).role = t.role, '', '{END}\n') as tail,
            t.role = 'assistant' as loss))"""
    )
    return grouped.select("conv_id", parts.alias("p")).select(
        "conv_id",
        F.expr("array_join(flatten(transform(p, x -> array(x.head, x.body, x.tail))), '')").alias("formatted"),
        F.expr("flatten(transform(p, x -> array(struct(length(x.head) as n_chars, false as loss), struct(length(x.body) as n_chars, x.loss as loss), struct(length(x.tail) as n_chars, false as loss))))").alias("mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted back to conv_id, turns (array of role, text), loss_text, formatted_chars; loss_text is cut out by the mask alone."""
    head = lambda b: F.instr(b, "\n")
    role = lambda b: _unescape(F.replace(F.substring(b, F.lit(1), head(b) - 1), F.lit(NEWLINE), F.lit("\n")))
    body = lambda b: F.regexp_replace(F.substring(b, head(b) + 1, F.length(b)), r"<\|im_end\|>\n\z", "")
    block = lambda b: F.transform(F.split(body(b), r"<\|turn\|>", -1), lambda x: F.struct(role(b).alias("role"), _unescape(x).alias("text")))
    turns = F.flatten(F.transform(F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda b, i: i > 0), block))
    runs = F.zip_with(cut(F.col("formatted"), F.transform("mask", lambda m: m["n_chars"])), F.col("mask"), lambda t, m: F.struct(t.alias("t"), m["loss"].alias("loss")))
    loss = F.transform(F.filter(runs, lambda x: x["loss"]), lambda x: _unescape(x["t"]))
    return formatted.select("conv_id", F.length("formatted").alias("formatted_chars"), turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))


def digest(formatted: DataFrame) -> DataFrame:
    """The digest columns of a formatted table, read back from the output."""
    r = read_back(formatted)
    return r.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
