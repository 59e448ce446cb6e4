"""One composed run: stages that are kept by what they were made from, guards before them, and a report.

A stage's folder is named by a digest of its name, its settings and the folders of its inputs, the first of which
are named by the files that were read. So a stage whose inputs are the same is found again, by a run that
resumes after a failure as by the next day's, and a stage whose inputs have changed is made anew beside
the old one. What a stage made counts once its write is committed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import decide, model, publish, reporting
from panelwright.session import create_file, path_exists
from panelwright.sources.text import replace_table

BUILT, REUSED, SKIPPED = "built", "reused", "skipped"


@dataclass(frozen=True)
class Stage:
    """``build`` gets the tables of ``needs`` in order. ``guard`` gets them too and says why the stage can't be made, or None."""

    name: str
    build: Callable[..., DataFrame]
    needs: Sequence[str] = ()
    guard: Callable[..., str | None] | None = None
    settings: dict = field(default_factory=dict)


@dataclass
class Outcome:
    table: DataFrame | None
    key: str
    state: str
    reason: str | None = None


def stage_key(stage: Stage, inputs: Sequence[str]) -> str:
    made_from = json.dumps([stage.name, stage.settings, list(inputs)], sort_keys=True)
    return hashlib.sha256(made_from.encode()).hexdigest()[:24]


def run_stages(spark: SparkSession, stages: Sequence[Stage], root: str, source: str) -> dict[str, Outcome]:
    """H19, I8, A8. Make every stage that isn't there yet; ``source`` names what the first stages read.

    A stage whose guard objects is skipped, and so is all that needs it; the other stages go on.
    """
    done: dict[str, Outcome] = {}
    for stage in stages:
        inputs = [done[n] for n in stage.needs]
        key = stage_key(stage, [i.key for i in inputs] or [source])
        folder = f"{root}/{stage.name}/{key}"
        missing = [n for n, i in zip(stage.needs, inputs, strict=True) if i.table is None]
        tables = [i.table for i in inputs]
        if missing:
            done[stage.name] = Outcome(None, key, SKIPPED, f"without {', '.join(missing)}")
        elif path_exists(spark, f"{folder}/_SUCCESS"):
            done[stage.name] = Outcome(spark.read.parquet(folder), key, REUSED)
        elif stage.guard and (reason := stage.guard(*tables)):
            done[stage.name] = Outcome(None, key, SKIPPED, reason)
        else:
            replace_table(stage.build(*tables), folder)
            done[stage.name] = Outcome(spark.read.parquet(folder), key, BUILT)
    return done


def report(spark: SparkSession, outcomes: dict[str, Outcome]) -> DataFrame:
    """A9. (stage, state, reason, rows): one count per table, all in one plan."""
    parts = []
    for name, o in outcomes.items():
        rows = o.table.agg(F.count(F.lit(1)).alias("rows")) if o.table is not None else spark.range(1).select(F.lit(None).cast("long").alias("rows"))
        parts.append(rows.select(F.lit(name).alias("stage"), F.lit(o.state).alias("state"), F.lit(o.reason).cast("string").alias("reason"), "rows"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_report(table: DataFrame, folder: str, load_id: str, run_at: str) -> bool:
    """A9. The report of one run as a JSON file of its own; False if the run has one already."""
    items = reporting.run_report(load_id, run_at, table.select(F.col("stage").alias("metric"), F.col("rows").alias("n")), {"stages": table})
    lines = [row[0] for row in items.select(F.to_json(F.struct("*"))).collect()]  # two for each stage
    return create_file(table.sparkSession, f"{folder}/{load_id}.json", "\n".join(sorted(lines)) + "\n")


def enough_rows(dataset: DataFrame) -> str | None:
    """H19. Training and test rows, or the reason why there is no model."""
    return None if model.has_enough(dataset) else "no development or no test rows"


def all_there(names: Sequence[str]) -> Callable[..., str | None]:
    """I8. The decision's inputs, each with rows."""

    def guard(*tables: DataFrame) -> str | None:
        try:
            decide.require_inputs({n: None if t.isEmpty() else t for n, t in zip(names, tables, strict=True)})
        except decide.MissingInput as missing:
            return f"empty: {missing}"
        return None

    return guard


def publish_outcomes(outcomes: dict[str, Outcome], names: Sequence[str], root: str | None, load_id: str, published_at: str) -> bool:
    """J1, J3. Publish the named stages as one set; False if one of them is missing or there is no target."""
    return publish.publish({n: outcomes[n].table for n in names}, root, load_id, published_at)
