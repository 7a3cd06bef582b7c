"""PII: base patterns, and terms that disclose them by corpus co-occurrence."""
from pyspark.sql import DataFrame, functions as F

from .common import _once, checkpoint, cut, fold, running, text_col

# The base patterns. A match can only begin where a run of its first characters begins, or where the
# match before ended, and no later part can give back characters to an earlier one: so runs are possessive, which
# keeps a search linear and off the stack on texts of any length, and finds the same matches.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The zeros give back a digit, as a part may be zero itself.
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: What any match must hold; saves the split of ordinary texts.
_GATE = {"email": "@", "ip": r"[0-9]\.[0-9]++\.", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}

#: Up to so many terms are part of the plan itself; more are joined by a shuffle.
PLAN_TERMS = 5000
#: Characters on each side of an entity that are its context.
REACH = 60
_SPANS = "array<struct<s:int,e:int,m:string,c:string>>"


def _parts(text, pattern):
    """A text as array of (p, g, m): each leftmost non-overlapping match m with the gap g before it, which begins at p; the last m is null."""
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda g, m: F.struct(g.alias("g"), m.alias("m"), (F.length(g) + F.coalesce(F.length(m), F.lit(0))).alias("n")))
    return _once(both, lambda z: F.zip_with(z, running(F.transform(z, lambda x: x["n"])), lambda x, p: F.struct(p.alias("p"), x["g"].alias("g"), x["m"].alias("m"))))


def spans(text, pattern, gate=None):
    """Leftmost non-overlapping matches as array of (s, e, m, c): code points, end exclusive, and the context, which ends at the next match on each side."""

    def span(z):
        def one(x, i):
            s, n = x["p"] + F.length(x["g"]), F.length(x["g"])
            # A word that the edge of a context may have cut is left out.
            left = F.when(n > REACH, F.regexp_replace(F.substring(x["g"], n - REACH + 1, F.lit(REACH)), r"^[\p{L}\p{N}]++", "")).otherwise(x["g"])
            after = F.get(z, i + 1)["g"]
            right = F.when(F.length(after) > REACH, F.regexp_replace(F.substring(after, F.lit(1), F.lit(REACH)), r"(?<![\p{L}\p{N}])[\p{L}\p{N}]++$", "")).otherwise(after)
            return F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), x["m"].alias("m"), F.concat(left, F.lit(" "), right).alias("c"))

        return F.filter(F.transform(z, one), lambda x: x["m"].isNotNull())

    found = _once(_parts(text, pattern), span)
    return F.when(text.rlike(gate), found).otherwise(F.array().cast(_SPANS)) if gate else found


def _digits(m):
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m):
    d = F.reverse(F.split(_digits(m), ""))
    val = F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), x.cast("int") + 1)))
    return F.aggregate(val, F.lit(0), lambda a, x: a + x) % 10 == 0


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda m: F.length(_digits(m)).between(16, 19) & F.when(F.length(_digits(m)).between(16, 19), _luhn(m)).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


#: What parts the words of a text.
_GAP = r"[^\p{L}\p{N}]++"


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, and one array of spans per kind."""
    out = docs.select(F.col("doc_id"), text_col().alias("text"))

    def kind(k):
        return F.filter(spans(F.col("text"), F.lit(PATTERNS[k]), _GATE[k]), lambda x: _VALID[k](x["m"])).alias(k)

    return out.select("doc_id", "text", *[kind(k) for k in PATTERNS])


def _words(text):
    """Lower-case words of two letters or more, with what could be an entity taken out."""
    plain = F.when(F.instr(text, "@") > 0, F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.filter(F.split(F.lower(plain), r"[^\p{L}\p{N}]++|[0-9]++", -1), lambda w: F.length(w) > 1)


def disclosing_terms(base: DataFrame, share: float = 0.9, support: int = 20) -> DataFrame:
    """Terms whose PMI with a kind of entity reaches `share` of that kind's own information.

    A context is what stands within REACH characters of an entity; every word
    of every text is counted. Terms seen fewer than `support` times beside a
    kind carry no evidence (a threshold of the method, not a cap). Words that
    stand inside an entity are not terms of their own.
    """
    kinds = list(PATTERNS)
    beside = F.flatten(F.array(*[F.transform(F.col(k), lambda x, k=k: F.struct(F.lit(k).alias("kind"), x["c"].alias("c"))) for k in kinds]))
    near = base.select(F.explode(beside).alias("x")).select("x.kind", F.explode(_words(F.col("x.c"))).alias("term"))
    near = checkpoint(near.groupBy("kind", "term").agg(F.count("*").alias("near")))
    # Only terms with evidence need their count in the whole corpus; hits leave the scan, other words do not.
    known = near.where(F.col("near") >= support)
    wanted = known.select("term").distinct()
    few = wanted.count() <= PLAN_TERMS * 10
    words = base.select(F.explode(_words(F.col("text"))).alias("term"))
    held = words.join(F.broadcast(wanted) if few else wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("c"))
    # PMI / information = log(P(kind|term)/P(kind)) / -log P(kind); a kind beside no word or beside all says nothing.
    total = base.select(F.size(_words(F.col("text"))).alias("n")).agg(F.sum("n").alias("n")).first()[0] or 0
    prior = near.groupBy("kind").agg((F.sum("near") / F.lit(float(max(1, total)))).alias("p"))  # at most four rows
    stat = known.join(held, "term").join(F.broadcast(prior), "kind")
    said = F.when(F.col("p") < 1, F.log2(F.least(F.lit(1.0), F.col("near") / F.col("c")) / F.col("p")) / -F.log2("p"))
    return stat.groupBy("term").agg(F.max(said).alias("disclosure")).where(F.col("disclosure") >= share)


def find(docs: DataFrame, share: float = 0.9, support: int = 20) -> DataFrame:
    """Return doc_id, text, email, ip, card, phone, term (arrays of spans) per row.

    Null text is empty. Rows that repeat an id and its text get equal results;
    null ids are ids like others; an empty table gives an empty result. Texts
    of any length are read whole, in time in proportion to their length.
    """
    base = base_spans(docs)
    terms = checkpoint(disclosing_terms(base, share, support))
    none = F.array().cast("array<struct<s:int,e:int>>")
    n = terms.count()
    if not n:
        return base.withColumn("term", none)
    words = F.array_distinct(F.split(F.lower("text"), _GAP, -1))
    if n <= PLAN_TERMS:
        # A set of bounded size inside the plan: no text and no word moves.
        names = [r.term for r in terms.select("term").collect()]
        out = base.withColumn("_t", F.filter(words, lambda w: w.isin(names)))
    else:
        key = F.md5(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), "text"))
        base = base.withColumn("_k", key)
        held = base.select("_k", F.explode(words).alias("term")).join(terms, "term").groupBy("_k").agg(F.collect_set("term").alias("_t"))
        out = base.join(held, "_k", "left").drop("_k").withColumn("_t", F.coalesce("_t", F.array().cast("array<string>")))
    pat = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("_t", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    # Only an e-mail can hold a word's letters, so terms are looked for between them.
    shift = lambda x: F.transform(spans(x["g"], pat), lambda y: F.struct((x["p"] + y["s"]).alias("s"), (x["p"] + y["e"]).alias("e")))
    clear = F.flatten(F.transform(_parts(F.col("text"), F.lit(PATTERNS["email"])), shift))
    return out.withColumn("term", F.when(F.size("_t") > 0, clear).otherwise(none)).drop("_t")


def sanitised():
    """The text of a row of find() with every span generalised to its kind in angle brackets; of spans that overlap the first, then longest, counts."""
    tag = lambda k: F.transform(F.col(k), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), F.lit(k).alias("k")))
    marks = F.array_sort(F.concat(*[tag(k) for k in (*PATTERNS, "term")]))
    end = lambda p, x: F.when(x["s"] < p, p).otherwise(-x["e"])
    keep = lambda a, x: F.when(x["s"] < a["p"], a).otherwise(F.struct((-x["e"]).alias("p"), F.concat(a["o"], F.array(F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k")))).alias("o")))
    none = F.array().cast("array<struct<s:int,e:int,k:string>>")
    inside = lambda x: F.aggregate(x["b"], F.struct(x["p"].alias("p"), none.alias("o")), keep, lambda a: a["o"])
    clear = F.flatten(F.transform(fold(marks, F.lit(0), lambda p, b: F.aggregate(b, p, end)), inside))

    def put(c):
        gaps = F.transform(c, lambda x, i: F.array(x["s"] - F.coalesce(F.get(c, i - 1)["e"], F.lit(0)), x["e"] - x["s"]))
        pieces = cut(F.col("text"), F.concat(F.flatten(gaps), F.array(F.length("text"))))
        return F.array_join(F.transform(pieces, lambda t, i: F.when(i % 2 == 1, F.concat(F.lit("<"), F.get(c, F.floor(i / 2).cast("int"))["k"], F.lit(">"))).otherwise(t)), "")

    return F.when(F.size(marks) == 0, F.col("text")).otherwise(_once(clear, put))


def sanitise(found: DataFrame) -> DataFrame:
    """doc_id and sanitised text of the rows of find()."""
    return found.select("doc_id", sanitised().alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, digests and spans of the rows of find(), and the digest of the sanitised text."""
    show = lambda k: F.transform(F.col(k), lambda x: F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string")))
    base = F.concat(*[show(k) for k in PATTERNS])
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, show("term")), ",").alias("spans"),
        F.sha2(sanitised(), 256).alias("sanitised_sha256"),
    )
