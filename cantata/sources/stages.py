"""Pipelines of stages whose results are kept, checked and taken up again."""
import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .publish import Taken, canonical, file_system, names, publish, read_json


class StageError(RuntimeError):
    """What is wrong with a stage; the code is `invalid_stage`, `input_mismatch` or `input_changed`."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Stage:
    """A step that makes a table from others.

    needs: names of earlier stages or sources; compute: their DataFrames in that
    order to the stage's; columns: those that it has to have; options: what its
    result depends on besides, of JSON types; made_from: the stage or source
    whose digests its rows carry in `input_digest`, by key, or none.
    """

    name: str
    needs: tuple
    compute: Callable
    columns: tuple = ()
    options: dict = field(default_factory=dict)
    made_from: str | None = None


def content(df: DataFrame) -> dict:
    """Rows and digest of a table, whatever the order of its rows; made in one pass, in the tasks."""
    cols = [F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in sorted(df.columns)]
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).cast("string"), F.lit("0")).alias("d")).first()
    return {"rows": r.n, "digest": r.d}


def _identity(stage: Stage, inputs: list) -> str:
    return hashlib.sha256(canonical({"stage": stage.name, "options": stage.options, "columns": sorted(stage.columns), "needs": list(stage.needs), "inputs": inputs}).encode()).hexdigest()


def _checked(stage: Stage, made: DataFrame, key: str) -> None:
    missing = ({key} | set(stage.columns) | ({"input_digest"} if stage.made_from else set())) - set(made.columns)
    if missing:
        raise StageError("invalid_stage", f"{stage.name} lacks {', '.join(sorted(missing))}")


def _same_source(stage: Stage, kept: DataFrame, tables: dict, key: str) -> None:
    """Every row must say that it was made from what the named stage has for its key."""
    if stage.made_from:
        theirs = tables[stage.made_from].select(key, F.col("digest").alias("input_digest")).distinct()
        wrong = kept.select(key, "input_digest").distinct().join(theirs, [key, "input_digest"], "left_anti")
        if not wrong.isEmpty():
            raise StageError("input_mismatch", f"{stage.name} was made from something else than {stage.made_from}")


def run(spark: SparkSession, root: str, sources: dict, stages: list, key: str = "song_id", calls: list | None = None) -> dict:
    """Run the stages in order under root; returns the tables of all of them, read from where they are kept.

    A stage is kept under a digest of its name, options and inputs (by their
    content), so a rerun takes up finished stages and makes only what is missing
    or has other inputs; `calls` gets the names of the stages that were made. A
    stage counts as finished by one file that is published after its rows were
    read back and checked: it has its columns, and rows made from another input
    than they should stop the run before the next stage. Before the tables are
    handed out, those of all stages are held against their digests again:
    `input_changed` where one is not what the later ones were made from.
    """
    tables, known = dict(sources), {n: content(df) for n, df in sources.items()}
    at = {}
    for stage in stages:
        if stage.name in tables or not set(stage.needs) <= set(tables):
            raise StageError("invalid_stage", f"{stage.name} is named twice, or needs what is not there")
        identity = _identity(stage, [known[n] for n in stage.needs])
        home = f"{root}/{stage.name}"
        if f"{identity}.json" not in names(spark, f"{home}/done"):
            made = stage.compute(*[tables[n] for n in stage.needs])
            _checked(stage, made, key)
            if calls is not None:
                calls.append(stage.name)
            # What a run left behind that died here is written over; nothing refers to it.
            made.write.mode("overwrite").parquet(f"{home}/data/{identity}")
            kept = spark.read.schema(made.schema).parquet(f"{home}/data/{identity}")
            _same_source(stage, kept, tables, key)
            facts = content(kept)
            try:
                publish(spark, f"{home}/done/{identity}.json", {**facts, "schema": made.schema.jsonValue(), "options": stage.options})
            except Taken:
                pass  # another run of the same stage over the same inputs
        mark = read_json(spark, f"{home}/done/{identity}.json")
        known[stage.name] = {k: mark[k] for k in ("rows", "digest")}
        schema = type(sources[next(iter(sources))].schema).fromJson(mark["schema"])
        tables[stage.name] = spark.read.schema(schema).parquet(f"{home}/data/{identity}")
        at[stage.name] = f"{home}/data/{identity}"
    for stage in stages:
        fs, p = file_system(spark, at[stage.name])
        try:
            now = content(tables[stage.name]) if fs.exists(p) else None
        except Exception:  # a part that is gone or unreadable
            now = None
        if now != known[stage.name]:
            raise StageError("input_changed", f"{stage.name} is not what it was")
    return {s.name: tables[s.name] for s in stages}


def fingerprint(stages: list, sources: dict) -> str:
    """A digest of what a pipeline is and works on: the content of its sources, and its stages with their options in order."""
    return hashlib.sha256(canonical({"sources": {n: content(df) for n, df in sources.items()}, "stages": [{"stage": s.name, "options": s.options} for s in stages]}).encode()).hexdigest()
