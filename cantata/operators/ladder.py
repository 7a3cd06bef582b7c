"""Alignment of lyric segments as a ladder: cheap rules first, and only what they leave goes to the costly step."""
from pyspark.sql import Column, DataFrame, functions as F

from . import alignment, folds

#: Fixed value: characters of a segment beyond which it is not aligned in one window.
MOST_CHARS = 512


def judged(segments: DataFrame, emissions, vocabulary: DataFrame, key: str = "segment_id") -> DataFrame:
    """Segments (key, text, start_sample, end_sample) with chars, reason and unsupported, before any acoustic work.

    The first rule that holds names the reason: `no_alignable_text`,
    `digital_silence_or_too_short` (no emissions), `text_window_too_large`,
    `out_of_vocabulary` (with the characters, sorted); null where none holds. Of
    emissions (see align()) only the keys are read, or the size. vocabulary:
    (char, token), of a size that a model's output layer bounds; it becomes part
    of the plan.
    """
    if isinstance(emissions, Column):
        # Little to read and much to do: segments are dealt out before, as a file's parts may be few.
        s = segments.repartition(key).withColumn("_heard", F.when(F.size(emissions) > 0, True))
    else:
        s = segments.join(emissions.where("emissions is not null and size(emissions) > 0").select(key, F.lit(True).alias("_heard")), key, "left")
    s = s.where(F.col(key).isNotNull())
    s = alignment.normalised(s, *s.columns)
    known = {r.char for r in vocabulary.select("char").collect()}
    unknown = F.array_sort(F.array_distinct(F.filter(F.transform("chars", lambda c: c["char"]), lambda c: ~c.isin(list(known)))))
    out = s.withColumn("unsupported", unknown)
    reason = (
        F.when(F.size("chars") == 0, "no_alignable_text").when(F.col("_heard").isNull(), "digital_silence_or_too_short")
        .when(F.size("chars") > MOST_CHARS, "text_window_too_large").when(F.size("unsupported") > 0, "out_of_vocabulary")
    )
    out = out.withColumn("reason", reason).drop("_heard")
    return out.withColumn("unsupported", F.when(F.col("reason") == "out_of_vocabulary", F.col("unsupported")))


def align(segments: DataFrame, emissions, vocabulary: DataFrame, key: str = "segment_id", least: float = 0.05, blank: int = 0) -> DataFrame:
    """(key, status, reason, unsupported, start_sample, end_sample, frames, characters): one row for each segment.

    emissions: a table (key, emissions), which meets the segments that the rules
    left in one join, or a column that makes them of a segment's own columns;
    then segments are dealt out by key without them, and nothing else is moved.

    Behind the rules of judged() come `no_ctc_path` and `low_acoustic_score` (a
    character below `least`); else the segment is aligned, from its first
    character to its last. characters: char, char_start, char_end, status, score,
    start_sample, end_sample of each (times only where it is aligned, observed
    ones beside them). A key is one segment.
    """
    tokens = {r.char: r.token for r in vocabulary.select("char", "token").collect()}
    first = judged(segments, emissions, vocabulary, key)
    token = F.create_map(*[F.lit(x) for pair in tokens.items() for x in pair]) if tokens else F.create_map().cast("map<string,int>")
    named = F.transform("chars", lambda c: F.element_at(token, c["char"]).cast("int"))
    # Emissions are the bulk: they meet only the segments that the rules left.
    if isinstance(emissions, Column):
        fit = F.col("reason").isNull()
        out = folds.align_segments(first.withColumns({"tokens": F.when(fit, named), "emissions": F.when(fit, emissions)}), key, blank, True)
    else:
        left = first.where("reason is null").withColumn("tokens", named)
        out = folds.align_segments(left.join(emissions.select(key, "emissions"), key), key, blank, True)
        out = out.unionByName(first.where("reason is not null"), allowMissingColumns=True)
    n, at, length = F.col("frames").cast("long"), F.col("start_sample"), F.col("end_sample") - F.col("start_sample")
    # Integers only: the nearest sample of a frame's share of the segment, halves up.
    place = lambda f: at + F.floor((2 * f * length + n) / (2 * n)).cast("long")

    def one(c, s):
        start, end = place(s["start_frame"]), F.least(place(s["end_frame"]), F.col("end_sample"))
        sure = F.coalesce(s["confidence"] >= least, F.lit(False))
        return F.struct(
            c["char"].alias("char"), c["char_start"].alias("char_start"), c["char_end"].alias("char_end"), F.when(sure, "aligned").otherwise("unaligned").alias("status"), s["confidence"].alias("score"),
            F.when(sure, start).alias("start_sample"), F.when(sure, end).alias("end_sample"), start.alias("observed_start"), end.alias("observed_end"),
        )

    out = out.withColumn("characters", F.zip_with("chars", F.coalesce("spans", F.array().cast("array<struct<position:int,start_frame:int,end_frame:int,confidence:double>>")), one))
    low = F.exists("characters", lambda c: c["status"] != "aligned")
    out = out.withColumn("reason", F.coalesce("reason", F.when(F.col("spans").isNull(), "no_ctc_path").when(low, "low_acoustic_score")))
    ok = F.col("reason").isNull()
    return out.select(
        key, F.when(ok, "aligned").otherwise("unaligned").alias("status"), "reason", "unsupported",
        F.when(ok, F.get("characters", F.lit(0))["start_sample"]).alias("start_sample"), F.when(ok, F.element_at("characters", -1)["end_sample"]).alias("end_sample"), "frames", "characters",
    )
