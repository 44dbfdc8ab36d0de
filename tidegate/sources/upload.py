"""A governed upload: one data file, its manifest and its mapping become a checked dataset with a receipt."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampNTZType

from tidegate.errors import GovernanceError, LimitError, RequestError
from tidegate.operators import governance
from tidegate.session import kept
from tidegate.sources.files import Limits, json_document, read_upload

# fixed values: the keys of the two documents and of their parts
FEATURE_KEYS = {
    "name", "source_dataset", "source_fields", "source_digest", "transformation", "transformation_version", "code_digest", "parameters", "lookback_sessions", "computation_scope",
    "revision_policy", "uses_target",
}
MANIFEST_KEYS = {"source_bundle_digest", "features"}
MAPPING_KEYS = {
    "sample_id_column", "session_column", "asset_id_column", "interval_start_column", "interval_end_column", "decision_time_column", "target_column", "feature_columns", "availability_columns",
    "session_axis", "pit_snapshot",
}
SNAPSHOT_KEYS = {"snapshot_id", "source_digest", "revision_policy"}


@dataclass
class Upload:
    """The dataset, its axis (session, axis_pos), the governance receipt and the file's size."""

    dataset: DataFrame
    axis: DataFrame
    receipt: dict[str, object]
    file_bytes: int


def manifest_of(document: Mapping[str, Any], limits: Limits) -> governance.FeatureManifest:
    rows = document["features"]
    if not isinstance(rows, list) or not rows:
        raise RequestError("a manifest lists its features")
    if len(rows) > limits.features:
        raise LimitError(f"{len(rows)} features")
    if any(not isinstance(r, Mapping) or set(r) != FEATURE_KEYS for r in rows):
        raise RequestError("a feature's keys are not the declared ones")
    fixed = lambda r: {"source_fields": tuple(r["source_fields"]), "parameters": tuple(sorted((str(k), str(v)) for k, v in dict(r["parameters"]).items()))}
    features = tuple(governance.FeatureDefinition(**{**r, **fixed(r)}) for r in rows)
    if len({f.name for f in features}) != len(features):
        raise GovernanceError("feature names repeat")
    return governance.FeatureManifest(document["source_bundle_digest"], features)


def load_upload(spark: SparkSession, data_path: str, manifest: str | Mapping[str, Any], mapping: str | Mapping[str, Any], limits: Limits = Limits()) -> Upload:
    """Check documents and limits, read the mapped columns once, and govern them.

    The mapped features must be the manifest's, by name and in order. Documents are paths or what they hold.
    """
    about, places = json_document(manifest, MANIFEST_KEYS, limits, spark), json_document(mapping, MAPPING_KEYS, limits, spark)
    described = manifest_of(about, limits)
    features, available, snapshot = places["feature_columns"], places["availability_columns"], places["pit_snapshot"]
    if not isinstance(snapshot, Mapping) or set(snapshot) != SNAPSHOT_KEYS:
        raise RequestError("the snapshot's keys are not the declared ones")
    if not 1 <= len(features) <= limits.features or len(available) != len(features):
        raise LimitError("features are too many, or not as many as their availabilities")
    governance.require_names(features, described)
    asset = places["asset_id_column"]
    texts = [places["sample_id_column"], *([asset] if asset else [])]
    times = [places[f"{k}_column"] for k in ("session", "interval_start", "interval_end", "decision_time")]
    kinds = {**dict.fromkeys(texts, StringType()), **dict.fromkeys([*times, *available], TimestampNTZType()), **dict.fromkeys([places["target_column"], *features], DoubleType())}
    rows, size = read_upload(spark, data_path, StructType([StructField(n, k) for n, k in kinds.items()]), limits, with_size=True)
    axis = spark.createDataFrame([(str(s), k) for k, s in enumerate(places["session_axis"])], "session string, axis_pos long").withColumn("session", F.col("session").cast("timestamp_ntz"))
    col = lambda name: F.col(f"`{name}`")
    # positions are written down once: a scan that is read again may be packed otherwise
    dataset = rows.select(
        F.monotonically_increasing_id().alias("position"),
        col(texts[0]).alias("sample_id"),
        (col(asset) if asset else F.lit(None).cast("string")).alias("asset"),
        *[col(t).alias(n) for t, n in zip(times, ("session", "info_start", "info_end", "decision_time"), strict=True)],
        F.array(*map(col, available)).alias("feature_available"),
        F.array(*map(col, features)).alias("features"),
        col(places["target_column"]).alias("target"),
    )
    dataset = kept(dataset, "upload-rows")
    governance.require_valid(dataset, axis, len(features))
    receipt = governance.govern(dataset, described, governance.PITSnapshot(**snapshot))
    return Upload(dataset.join(F.broadcast(axis), "session"), axis, receipt, size)  # at most a session for each row of a bounded file
