"""Python tasks over rows: per element or per batch, with errors kept per element."""

from __future__ import annotations

import inspect
import json
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Task:
    """A function of an element (a dict), or with ``batched`` of a list of them.

    A try that fails is repeated ``retries`` times, after ``wait`` seconds, twice as
    many each time; ``params_model`` checks the parameters and fills in defaults.
    """

    fn: Callable
    batched: bool = False
    retries: int = 0
    wait: float = 0.0
    params_model: Callable | None = None
    label: str | None = None

    def checked(self, params: Mapping) -> dict:
        if self.params_model is None:
            return dict(params)
        made = self.params_model(**params)
        return dict(made) if isinstance(made, Mapping) else {k: v for k, v in vars(made).items() if not k.startswith("_")}

    def tried(self, work: Callable[[], object]) -> tuple[object, str | None, int]:
        for attempt in range(1, self.retries + 2):
            try:
                return work(), None, attempt
            except Exception as e:
                if attempt > self.retries:
                    return None, f"{type(e).__name__}: {e}", attempt
                if self.wait:
                    time.sleep(self.wait * 2 ** (attempt - 1))
        raise AssertionError

    def call(self, items: list[dict], params: Mapping) -> list[tuple[object, str | None, int]]:
        """(result, error, attempts) of each element; a batch that keeps failing is run one by one."""
        extra = {k: v for k, v in params.items() if k in inspect.signature(self.fn).parameters}
        if not self.batched:
            return [self.tried(lambda x=x: self.fn(x, **extra)) for x in items]

        def whole() -> list:
            got = list(self.fn(items, **extra))
            if len(got) != len(items):
                raise ValueError(f"{len(got)} results for {len(items)} elements")
            return got

        got, error, attempt = self.tried(whole)
        if error is None:
            return [(g, None, attempt) for g in got]
        if len(items) == 1:
            return [(None, error, attempt)]
        return [r for x in items for r in self.call([x], params)]


def task(fn: Callable | None = None, **options) -> Task | Callable[[Callable], Task]:
    return Task(fn, **options) if fn else lambda f: Task(f, **options)


def apply(df: DataFrame, work: Task, schema: str, params: Mapping | None = None, key: str = "_key") -> DataFrame:
    """``key``, ``rows`` (array of results; one result or a list of them), ``error`` and ``attempts`` of each element."""

    params = work.checked(params or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.drop_columns(["__key"]).to_pylist()
            made = work.call(items, params) if items else []
            rows = [[] if r is None else r if isinstance(r, list) else [r] for r, _, _ in made]
            texts = pa.array([json.dumps(r, default=str) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("__key"), texts, pa.array([e for _, e, _ in made], pa.string()), pa.array([a for _, _, a in made], pa.int32())], ["_key", "rows", "error", "attempts"])

    keyed = df.withColumn("__key", F.col(key).cast("string")).drop(key)
    out = keyed.mapInArrow(run, "_key string, rows string, error string, attempts int")
    return out.withColumn("rows", F.from_json("rows", f"array<struct<{schema}>>"))


def results(applied: DataFrame) -> DataFrame:
    """One row for each result of the elements that went well."""
    return applied.where("error IS NULL").select("_key", F.explode("rows").alias("r")).select("_key", "r.*")


def failures(applied: DataFrame) -> DataFrame:
    return applied.where("error IS NOT NULL").select("_key", "error", "attempts")


def chain(steps: Mapping[str, Callable], needs: Mapping[str, str] | None = None, on_error: str = "skip", cleanup: Callable[[dict, dict], None] | None = None, **options) -> Task:
    """Named steps that see ``previous`` results; a failed step skips its dependents only.

    All steps failing fails the element.  ``on_error`` says what becomes of one that
    failed or was skipped: nothing ("skip"), a row with its node and ``error``
    ("row"), or the element's failure ("fail").  ``cleanup`` runs once an element, at
    its end, whatever happened.
    """
    if on_error not in ("skip", "row", "fail"):
        raise ValueError(f"unknown on_error: {on_error}")
    needs = needs or {}

    def run(element: dict) -> list[dict]:
        previous, out, errors = {}, [], []
        try:
            for name, fn in steps.items():
                if name in needs and needs[name] not in previous:
                    errors.append((name, "skipped"))
                    continue
                try:
                    previous[name] = got = fn(element, previous)
                    out += [{"node": name} | r for r in (got if isinstance(got, list) else [got])]
                except Exception as e:
                    if on_error == "fail":
                        raise
                    errors.append((name, f"{type(e).__name__}: {e}"))
        finally:
            if cleanup:
                cleanup(element, previous)
        if not previous:
            raise RuntimeError("; ".join(f"{n}: {e}" for n, e in errors))
        return out + [{"node": n, "error": e} for n, e in errors if on_error == "row"]

    return Task(run, **options)


def autobatch(timings: DataFrame, share: float = 0.95) -> int:
    """From ``n``, ``seconds`` of timed batches: the size at which ``share`` of the time goes to elements, not to a batch's fixed cost."""
    fit = timings.agg(F.regr_slope("seconds", "n").alias("each"), F.regr_intercept("seconds", "n").alias("fixed")).first()
    if fit["each"] is None or fit["each"] <= 0 or fit["fixed"] <= 0:
        return 1
    return max(1, round(share / (1 - share) * fit["fixed"] / fit["each"]))
