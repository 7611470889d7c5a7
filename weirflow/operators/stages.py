"""Jobs of named stages: what feeds what, what a stage folds, which ran, and what a rerun may skip.

A stage's rows are a table in the campaign's folder, named by the identity of the
stage and of all that feeds it, so a rerun finds what is done and a changed stage
makes its own and its followers' tables anew.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from weirflow.functions.folds import fold
from weirflow.operators.flow import Task, apply, failures, results
from weirflow.operators.tables import _files


@dataclass(frozen=True)
class Fold:
    """How a stage's rows become one value: an empty fold, one row more, two folds joined, and the value's rows."""

    zero: Callable[[], object]
    add: Callable[[object, dict], object]
    merge: Callable[[object, object], object]
    rows: Callable[[object], list[dict]] = lambda v: [v]


@dataclass(frozen=True)
class Stage:
    """A stage: ``make`` is a function of the stages it comes ``after`` (DataFrames in that order), or a Task over the first.

    With a Task, ``schema`` names its results' columns and ``key`` its elements' key.
    ``reduce`` folds the rows; ``reads`` and ``writes`` name tables: it also waits for
    the stages that write what it reads.
    """

    name: str
    make: Callable[..., DataFrame] | Task
    after: tuple[str, ...] = ()
    schema: str = ""
    key: str = "_key"
    reduce: Fold | None = None
    reads: tuple[str, ...] = ()
    writes: tuple[str, ...] = ()
    params: Mapping[str, object] = field(default_factory=dict)
    version: str = ""
    priority: int = 0


def top(k: int, by: str, then: str) -> Fold:
    """The k rows of the largest ``by``, ties by the smaller ``then``."""

    def best(rows: list[dict]) -> list[dict]:
        return sorted(rows, key=lambda r: (-r[by], r[then]))[:k]

    return Fold(list, lambda got, row: best([*got, row]), lambda a, b: best(a + b), lambda got: got)


def order_of(stages: Sequence[Stage]) -> list[Stage]:
    """Stages behind all that they wait for, the most important first among those ready, then as given; a cycle is an error."""
    by_name = {s.name: s for s in stages}
    if len(by_name) != len(stages):
        raise ValueError("two stages of one name")
    unknown = {a for s in stages for a in s.after} - set(by_name)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    needs = {s.name: set(s.after) | {w.name for w in stages if w.name != s.name and set(w.writes) & set(s.reads)} for s in stages}
    out: list[Stage] = []
    while len(out) < len(stages):
        done = {s.name for s in out}
        ready = [s for s in stages if s.name not in done and needs[s.name] <= done]
        if not ready:
            raise ValueError(f"cycle among {sorted(set(by_name) - done)}")
        out.append(max(ready, key=lambda s: s.priority))
    return out


class Campaign:
    """Runs stages once each; ``states`` has each one's status, error, rows and seconds.

    Status is done, skipped (its table was there), failed, or blocked (something that
    it waits for failed); the others go on.  ``on_finish`` gets the states at the end.
    """

    def __init__(self, spark: SparkSession, path: str, stages: Sequence[Stage], on_finish: Callable[[dict], None] | None = None):
        self.spark, self.path, self.stages, self.on_finish = spark, path.rstrip("/"), order_of(stages), on_finish
        self.states: dict[str, dict] = {}
        self.identities: dict[str, str] = {}

    def identity(self, stage: Stage) -> str:
        parts = [stage.name, stage.version, json.dumps(dict(stage.params), sort_keys=True, default=str), *[self.identities[a] for a in stage.after]]
        return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}-{self.identities[name]}"

    def rows(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder(name)}/rows")

    def errors(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder(name)}/errors")

    def _has(self, path: str) -> bool:
        fs, p = _files(self.spark, f"{path}/_SUCCESS")
        return fs.exists(p)

    def _run(self, stage: Stage) -> None:
        feeds, folder = [self.rows(a) for a in stage.after], self.folder(stage.name)
        if isinstance(stage.make, Task):
            made = f"{folder}/elements"
            apply(feeds[0], stage.make, stage.schema, stage.params, stage.key).write.mode("overwrite").parquet(made)
            applied = self.spark.read.parquet(made)
            failures(applied).write.mode("overwrite").parquet(f"{folder}/errors")
            df = results(applied)
        else:
            df = stage.make(*feeds, **stage.params)
        if stage.reduce is not None:
            got = fold(df, stage.reduce.zero, stage.reduce.add, stage.reduce.merge)
            df = self.spark.createDataFrame(stage.reduce.rows(got), stage.schema or None)
        df.write.mode("overwrite").parquet(f"{folder}/rows")

    def run(self) -> dict[str, dict]:
        for stage in self.stages:
            self.identities[stage.name] = self.identity(stage)
            waits = set(stage.after) | {w.name for w in self.stages if w.name != stage.name and set(w.writes) & set(stage.reads)}
            bad = [w for w in waits if self.states[w]["status"] in ("failed", "blocked")]
            began = time.time()
            state = {"status": "done", "error": None}
            if bad:
                state = {"status": "blocked", "error": f"waits for {', '.join(sorted(bad))}"}
            elif self._has(f"{self.folder(stage.name)}/rows"):
                state["status"] = "skipped"
            else:
                try:
                    self._run(stage)
                except Exception as e:
                    state = {"status": "failed", "error": f"{type(e).__name__}: {str(e)[:500]}"}
            self.states[stage.name] = state | {"seconds": round(time.time() - began, 3), "identity": self.identities[stage.name]}
        if self.on_finish:
            self.on_finish(self.states)
        return self.states


def cancel(spark: SparkSession, group: str) -> None:
    """Ends all running work of a job group; what is written stays, so a rerun resumes."""
    spark.sparkContext.cancelJobGroup(group)
