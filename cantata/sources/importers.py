"""The choice of an importer for each file: the one that was asked for, or the only one whose mark the file begins with."""
from pyspark.sql import DataFrame, functions as F

#: Bytes of a file beyond which it is not imported.
MOST = 16 << 20
#: What files of a format begin with.
REGISTRY = {"midi": "MThd", "musicxml": "<?xml", "wave": "RIFF", "json": "{", "score-json": '{"score"'}


def choose(files: DataFrame, registry: dict = REGISTRY, content: str = "content", asked: str = "asked", most: int = MOST) -> DataFrame:
    """files with format, matches and status: `invalid_input` (no content), `too_large`, `unknown_format` (none fits, or none of the name that is asked for), `ambiguous_format` (several fit, which `matches` names in order), else `ok`.

    A format that is asked for is taken without looking at the file. The registry
    is part of the plan; a name twice is not possible in it.
    """
    names = sorted(registry)
    fits = F.array_compact(F.array(*[F.when(F.startswith(F.col(content), F.lit(registry[n].encode())), n) for n in names]))
    wanted = F.col(asked).isNotNull()
    out = files.withColumn("_fits", F.when(wanted, F.array_compact(F.array(F.when(F.col(asked).isin(names), F.col(asked))))).otherwise(fits))
    n = F.size("_fits")
    status = F.when(F.col(content).isNull(), "invalid_input").when(F.octet_length(content) > most, "too_large").when(n == 0, "unknown_format").when(n > 1, "ambiguous_format").otherwise("ok")
    out = out.withColumn("status", status)
    return out.withColumns({"format": F.when(F.col("status") == "ok", F.get("_fits", F.lit(0))), "matches": F.when(F.col("status") == "ambiguous_format", F.array_join("_fits", ","))}).drop("_fits")
