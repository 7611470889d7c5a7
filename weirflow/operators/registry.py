"""Artifacts and projects: registering, finding, updating, searching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.scalars import merged_json
from weirflow.operators.sinks import latest, upsert


def register(artifacts: DataFrame, new: DataFrame, status: str = "available") -> DataFrame:
    """``artifacts`` and the new ones, whose ids follow on the largest; a missing status is ``status``."""
    from weirflow.sources.reads import numbered

    top = artifacts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    made = numbered(new, "seq", "id").crossJoin(F.broadcast(top)).withColumn("id", F.col("id") + F.col("__top") + 1).drop("__top", "seq")
    made = made.withColumn("status", F.coalesce("status", F.lit(status))) if "status" in made.columns else made.withColumn("status", F.lit(status))
    return artifacts.unionByName(made, allowMissingColumns=True)


def add_capability(capabilities: DataFrame, new: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Capabilities of known artifacts; each (artifact, capability) once."""
    unknown = new.join(artifacts.select(F.col("id").alias("artifact_id")), "artifact_id", "left_anti")
    if not unknown.isEmpty():
        raise ValueError("a capability of an unknown artifact")
    return capabilities.unionByName(new, allowMissingColumns=True).dropDuplicates(["artifact_id", "capability"])


def find(artifacts: DataFrame, filters: Mapping[str, object] = {}, status: str | None = "available", capabilities: DataFrame | None = None, capability: str | None = None, newest: str | None = "id") -> DataFrame:
    """Artifacts that meet all filters, by default the available ones, newest first; with a capability if one is named."""
    for c, v in filters.items():
        artifacts = artifacts.where(F.col(c) == v if v is not None else F.col(c).isNull())
    if status is not None and "status" not in filters:
        artifacts = artifacts.where(F.col("status") == status)
    if capability is not None:
        artifacts = artifacts.join(with_capability(capabilities, capability).withColumnRenamed("artifact_id", "id"), "id", "left_semi")
    return artifacts.orderBy(F.desc(newest)) if newest else artifacts


def with_capability(capabilities: DataFrame, capability: str) -> DataFrame:
    """The distinct ids that have a capability."""
    return capabilities.where(F.col("capability") == capability).select("artifact_id").distinct()


def current(artifacts: DataFrame, by: Sequence[str]) -> DataFrame:
    return latest(artifacts.where(F.col("status") == "available"), by, "id")


def update_artifact(artifacts: DataFrame, where: Column, status: str | None = None, metadata: str | None = None) -> DataFrame:
    """A new status unless it is empty; metadata are merged entry by entry."""
    values = {}
    if status:
        values["status"] = F.when(where, F.lit(status)).otherwise(F.col("status"))
    if metadata:
        values["metadata_json"] = F.when(where, merged_json(F.col("metadata_json"), F.lit(metadata))).otherwise(F.col("metadata_json"))
    return artifacts.withColumns(values) if values else artifacts


def record_scope_state(states: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One state a scope: a later record replaces what it carries."""
    return upsert(states, new, keys)


def search(projects: DataFrame, text: str = "", columns: Sequence[str] = (), tag: str | None = None, sort: str = "name", descending: bool = False, page: int = 0, size: int = 40, key: str = "id") -> DataFrame:
    """Projects any of whose columns contains the text in any case, and with the tag; one page in a total order."""
    if text:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False))
        projects = projects.where(hit)
    if tag:
        projects = projects.where(F.array_contains(F.transform(F.split("tags", ","), lambda t: F.lower(F.trim(t))), tag.lower()))
    first = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_first()
    return projects.orderBy(first, key).offset(page * size).limit(size)


def toggled(projects: DataFrame, ids: Sequence[int], key: str = "id", flag: str = "favorite") -> DataFrame:
    return projects.withColumn(flag, F.when(F.col(key).isin(list(ids)), ~F.coalesce(flag, F.lit(False))).otherwise(F.col(flag)))


def taken(projects: DataFrame, paths: DataFrame, path: str = "path") -> DataFrame:
    """Of the asked paths those that a project already has."""
    return paths.select(path).distinct().join(projects.select(path), path, "left_semi")


def pruned(projects: DataFrame, present: DataFrame, path: str = "path") -> DataFrame:
    """Projects whose path is still there."""
    return projects.join(present.select(path), path, "left_semi")
