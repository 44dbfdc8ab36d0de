"""Constraint checks: one aggregate job counts every violation, then the driver refuses."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.errors import DatasetError, GovernanceError, PointInTimeError
from tidegate.model import digest

SCOPES = ("precomputed-stateless", "precomputed-stateful", "fold-local")


@dataclass(frozen=True)
class PITSnapshot:
    snapshot_id: str
    source_digest: str
    revision_policy: str = "point-in-time"


@dataclass(frozen=True)
class FeatureDefinition:
    """A feature as manifests describe it: the names below are fixed values, the keys of their JSON."""

    name: str
    source_dataset: str
    source_fields: tuple[str, ...]
    source_digest: str
    transformation: str
    transformation_version: str
    code_digest: str
    lookback_sessions: int = 1
    computation_scope: str = SCOPES[0]
    revision_policy: str = "point-in-time"
    uses_target: bool = False
    parameters: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        hexes = [self.source_digest, self.code_digest]
        if any(len(h) != 64 or set(h) - set("0123456789abcdef") for h in hexes):
            raise GovernanceError("digests must be 64 lower-case hexadecimal digits")
        if self.lookback_sessions < 1 or self.computation_scope not in SCOPES:
            raise GovernanceError("lookback must be at least 1 and the scope a known one")


@dataclass(frozen=True)
class FeatureManifest:
    source_bundle_digest: str
    features: tuple[FeatureDefinition, ...]

    @property
    def digest(self) -> str:
        return digest(self)


def not_finite(column: str) -> Column:
    return F.coalesce(F.isnan(column) | (F.abs(column) == float("inf")), F.lit(True))


def late(available: str = "feature_available", decision: str = "decision_time") -> Column:
    """Whether any feature of a row became available after the decision."""
    return F.exists(available, lambda a: a > F.col(decision))


def violations(dataset: DataFrame, axis: DataFrame, features: int) -> dict[str, int]:
    """How many rows break each rule of a dataset; a single pass besides the axis lookups.

    `dataset` has position, sample_id, session, info_start, info_end, features, target.
    """
    numbered = dataset.join(F.broadcast(axis.select("session", F.col("axis_pos").alias("known_pos"))), "session", "left")
    # the order check compares neighbours inside ranges of positions, so that no task sees the whole table
    near = Window.partitionBy(F.floor(F.col("position") / 100_000)).orderBy("position")
    checked = numbered.withColumn("disordered", F.coalesce(F.lag("known_pos").over(near) > F.col("known_pos"), F.lit(False)))
    rules = {
        "empty": F.when(F.count("*") == 0, 1).otherwise(0),
        "null sample id": F.count_if(F.col("sample_id").isNull() | (F.col("sample_id") == "")),
        "off the axis": F.count_if(F.col("known_pos").isNull()),
        "out of order": F.count_if("disordered"),
        "feature width": F.count_if(F.coalesce(F.size("features") != features, F.lit(True))),
        "feature not finite": F.count_if(F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))),
        "target not finite": F.count_if(not_finite("target")),
        "interval reversed": F.count_if(F.coalesce(F.col("info_start") > F.col("info_end"), F.lit(True))),
    }
    found = checked.agg(*[c.cast("long").alias(n) for n, c in rules.items()]).first().asDict()
    found["duplicate sample id"] = dataset.groupBy("sample_id").count().where("count > 1").count()
    edges = dataset.groupBy(F.floor(F.col("position") / 100_000).alias("part")).agg(F.min_by("session", "position").alias("first"), F.max_by("session", "position").alias("last"))
    found["out of order"] += edges.withColumn("before", F.lag("last").over(Window.orderBy("part"))).where("before > first").count()
    return {n: v for n, v in found.items() if v}


def axis_violations(axis_rows: DataFrame) -> dict[str, int]:
    """Rows (axis_pos, session) that do not rise strictly, or are missing; axis-sized."""
    rise = axis_rows.withColumn("bad", F.coalesce(F.lag("session").over(Window.orderBy("axis_pos")) >= F.col("session"), F.lit(False)) | F.col("session").isNull())
    n, bad = rise.agg(F.count("*"), F.count_if("bad")).first()
    return {k: v for k, v in {"empty axis": int(n == 0), "axis not rising": bad}.items() if v}


def require_valid(dataset: DataFrame, axis: DataFrame, features: int) -> DataFrame:
    found = axis_violations(axis) | violations(dataset, axis, features)
    if found:
        raise DatasetError("; ".join(f"{n}: {v} rows" for n, v in sorted(found.items())))
    return dataset


def require_point_in_time(dataset: DataFrame, snapshot: PITSnapshot | None) -> None:
    """Formal scoring needs a point-in-time source, and every feature before its decision; late rows are named by position."""
    if snapshot is None or snapshot.revision_policy != "point-in-time":
        raise PointInTimeError("scoring needs a point-in-time snapshot")
    missing = F.col("decision_time").isNull() | F.col("feature_available").isNull() | F.exists("feature_available", lambda a: a.isNull())
    n_missing, n_late, places = _late(dataset, missing)
    if n_missing:
        raise PointInTimeError(f"{n_missing} rows have no decision or availability time")
    if n_late:
        raise PointInTimeError("features arrive after the decision at sample positions " + ", ".join(map(str, places)))


def _late(dataset: DataFrame, missing: Column) -> tuple[int, int, list[int]]:
    bad = dataset.withColumn("gone", missing).withColumn("tardy", ~F.col("gone") & F.coalesce(late(), F.lit(False)))
    n_missing, n_late = bad.agg(F.count_if("gone"), F.count_if("tardy")).first()
    places = [r[0] for r in bad.where("tardy").select("position").orderBy("position").limit(20).collect()] if n_late else []
    return n_missing, n_late, places


def require_names(features: Sequence[str], manifest: FeatureManifest) -> None:
    """Mapped features are the manifest's, by name and in order."""
    if list(features) != [f.name for f in manifest.features]:
        raise GovernanceError("mapped features differ from the manifest's in name or order")


def govern(dataset: DataFrame, manifest: FeatureManifest, snapshot: PITSnapshot | None) -> dict[str, object]:
    """The governance receipt of a dataset, or an error that names the rule that fails."""
    require_point_in_time(dataset, snapshot)
    if manifest.source_bundle_digest != snapshot.source_digest:
        raise GovernanceError("the manifest describes another source")
    for f in manifest.features:
        if f.computation_scope != SCOPES[0] or f.uses_target or f.revision_policy != "point-in-time":
            raise GovernanceError("features must be stateless, point-in-time and not derived from the target")
    widths = dataset.agg(F.count("*"), F.min(F.size("features")), F.max(F.size("features")), F.min(F.size("feature_available"))).first()
    if {widths[1], widths[2], widths[3]} != {len(manifest.features)}:
        raise GovernanceError("features, availability and manifest differ in width")
    return {
        "observations": widths[0],
        "features": len(manifest.features),
        "availability_cells": widths[0] * len(manifest.features),
        "max_lookback_sessions": max(f.lookback_sessions for f in manifest.features),
        "manifest_digest": manifest.digest,
    }


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, *keys: str) -> None:
    if (n := duplicates(rows, *keys).count()) > 0:
        raise DatasetError(f"{n} keys of ({', '.join(keys)}) repeat")
