"""Bounded runs over an upload: closed requests, resource ceilings, a time limit, and one JSON object as the answer.

The work runs in this process under a tag of its own; when time is up, the tag's jobs are interrupted until it ends.
"""

from __future__ import annotations

import json
import shutil
import threading
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, fields, replace
from math import comb
from pathlib import Path
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.errors import LimitError, RequestError, RunTimeout, SinkError
from tidegate.model import CombinatorialCV, Minimums, PurgedKFold, WalkForward, data_digest, digest
from tidegate.operators import evaluate, splits
from tidegate.plans.benchmarks import effectiveness
from tidegate.session import kept
from tidegate.sources.files import Limits
from tidegate.sources.upload import FEATURE_KEYS, MANIFEST_KEYS, MAPPING_KEYS, SNAPSHOT_KEYS, Upload, load_upload

T = TypeVar("T")

# fixed values: the keys of a request and what its options may be
REQUIRED = ("schema_version", "action", "data_path", "manifest_path", "mapping_path")
OPTIONAL = ("options", "timeout_seconds")
ACTIONS = ("audit", "evaluate")
CEILINGS = {
    "max_file_bytes": "file_bytes", "max_rows": "rows", "max_features": "features", "max_combinations": "combinations", "max_columns": "columns", "max_uncompressed_bytes": "uncompressed_bytes",
}
REQUEST_BYTES, LEAST_SECONDS, MOST_SECONDS, SECONDS = 2**20, 1, 3600, 900


@dataclass(frozen=True)
class EvaluationPlan:
    """How an upload is evaluated; every field is an option of a request."""

    n_groups: int = 6
    n_test_groups: int = 2
    walk_forward_splits: int = 5
    embargo_sessions: int = 20
    pre_test_gap_sessions: int = 20
    min_train_observations: int = 10_000
    min_train_sessions: int = 252
    min_train_assets: int = 20
    ridge_alpha: float = 1.0

    def least(self, name: str) -> float:
        return 0 if name in ("embargo_sessions", "pre_test_gap_sessions") else 2 if name == "n_groups" else 1


@dataclass(frozen=True)
class Request:
    """A checked request."""

    action: str
    data_path: str
    manifest_path: str
    mapping_path: str
    limits: Limits
    plan: EvaluationPlan
    seconds: int
    digest: str


def _number(name: str, value: object, least: float, whole: bool = True) -> None:
    if isinstance(value, bool) or not isinstance(value, int if whole else int | float):
        raise RequestError(f"option {name} must be {'an integer' if whole else 'a number'}")
    if value < least or (not whole and value <= 0):
        raise RequestError(f"option {name} is too small")


def checked(document: object, folder: str = "") -> Request:
    """The request in a JSON document, whose keys and values are exactly the declared ones; relative paths start at `folder`."""
    if not isinstance(document, Mapping) or set(REQUIRED) - set(document) or set(document) - {*REQUIRED, *OPTIONAL}:
        raise RequestError("the request's keys are not the declared ones")
    if document["schema_version"] != "1":
        raise RequestError("the request's version is not supported")
    if document["action"] not in ACTIONS:
        raise RequestError(f"action must be one of {', '.join(ACTIONS)}")
    if any(not isinstance(document[k], str) or not document[k] for k in REQUIRED[2:]):
        raise RequestError("paths must be texts")
    options, seconds = document.get("options", {}), document.get("timeout_seconds", SECONDS)
    if not isinstance(options, Mapping):
        raise RequestError("options must be an object")
    plan = EvaluationPlan()
    own = {f.name for f in fields(plan)} if document["action"] == "evaluate" else set()
    if set(options) - {*CEILINGS, *own}:
        raise RequestError("options hold fields that the action does not have")
    for name, value in options.items():
        _number(name, value, plan.least(name) if name != "ridge_alpha" else 0, name != "ridge_alpha")
    if isinstance(seconds, bool) or not isinstance(seconds, int) or not LEAST_SECONDS <= seconds <= MOST_SECONDS:
        raise RequestError(f"timeout_seconds must be an integer from {LEAST_SECONDS} to {MOST_SECONDS}")
    at = lambda path: path if "://" in path or Path(path).is_absolute() or not folder else str(Path(folder) / path)
    limits = replace(Limits(), **{CEILINGS[k]: v for k, v in options.items() if k in CEILINGS})
    plan = replace(plan, **{k: v for k, v in options.items() if k in own})
    return Request(document["action"], *(at(document[k]) for k in REQUIRED[2:]), limits, plan, seconds, digest(dict(document)))


def read_request(path: str) -> Request:
    file = Path(path)
    if not file.is_file():
        raise RequestError("the request must be a file")
    if file.stat().st_size > REQUEST_BYTES:
        raise RequestError("the request is too large")
    try:
        document = json.loads(file.read_text("utf-8"))
    except ValueError as error:
        raise RequestError("the request is not JSON") from error
    return checked(document, str(file.parent))


def bounded(spark: SparkSession, seconds: float, work: Callable[[], T]) -> T:
    """What `work` returns, or RunTimeout when it takes longer; then no job of it is left behind."""
    tag, outcome = f"tidegate-{uuid.uuid4().hex}", {}

    def run() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            outcome["value"] = work()
        except BaseException as error:  # handed to the caller's thread
            outcome["error"] = error
        finally:
            spark.sparkContext.removeJobTag(tag)

    worker = threading.Thread(target=run, daemon=True)
    worker.start()
    worker.join(seconds)
    if worker.is_alive():
        # the work may be between two jobs, so it is asked again until it has ended
        for _ in range(600):
            spark.sparkContext.cancelJobsWithTag(tag)
            worker.join(0.1)
            if not worker.is_alive():
                break
        raise RunTimeout(f"the run took more than {seconds:g} seconds")
    if "error" in outcome:
        raise outcome["error"]
    return outcome["value"]


def audit(spark: SparkSession, request: Request) -> tuple[dict[str, Any], Upload]:
    """What an upload holds, and its governance receipt."""
    found = load_upload(spark, request.data_path, request.manifest_path, request.mapping_path, request.limits)
    rows = found.dataset
    counts = rows.agg(F.count("*").alias("observations"), F.count_distinct("session").alias("sessions"), F.count_distinct("asset").alias("assets"), F.max(F.size("features")).alias("features")).first().asDict()
    said = {
        "input": {"file_name": Path(request.data_path).name, "file_bytes": found.file_bytes},
        "limits": {k: getattr(request.limits, v) for k, v in CEILINGS.items()},
        "dataset": counts | {"digest": data_digest(rows.drop("position"))},
        "governance": dict(found.receipt),
    }
    return said, found


def _samples(found: Upload) -> tuple[DataFrame, list[str]]:
    """An upload's rows with a column for each feature; without assets all rows are of one."""
    width = found.receipt["features"]
    names = [f"feature{k}" for k in range(width)]
    rows = found.dataset.select("*", *[F.col("features")[k].alias(n) for k, n in enumerate(names)])
    return kept(rows.withColumn("asset", F.coalesce("asset", F.lit("-"))), "upload-samples"), names


def evaluated(spark: SparkSession, found: Upload, plan: EvaluationPlan, limits: Limits) -> dict[str, Any]:
    """Three channels and two views of a fold-local ridge on an upload: scores, and whether training suffices everywhere."""
    combinations = comb(plan.n_groups, plan.n_test_groups)
    if combinations > limits.combinations:
        raise LimitError(f"{combinations} combinations")
    rows, names = _samples(found)
    sessions = rows.agg(F.count_distinct("session")).first()[0]
    least = Minimums(train_sessions=plan.min_train_sessions, train_samples=plan.min_train_observations)
    kfold = PurgedKFold(plan.n_groups, plan.embargo_sessions, least)
    cpcv = CombinatorialCV(plan.n_groups, plan.n_test_groups, plan.embargo_sessions, limits.combinations, least)
    walk = WalkForward(plan.walk_forward_splits, max(1, sessions // (plan.walk_forward_splits + 1)), plan.pre_test_gap_sessions, minimums=least)
    training = []
    for name, spec in (("model-selection", kfold), ("cpcv-robustness", cpcv), ("causal-walk-forward", walk)):
        decided = kept(splits.plan(rows, found.axis, spec), "plan")
        splits.require(decided, least)
        train = splits.assignments(rows, decided).where("role = 'train'").groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("session").alias("s"), F.count_distinct("asset").alias("a"))
        few = train.agg(F.min("n").alias("observations"), F.min("s").alias("sessions"), F.min("a").alias("assets")).first().asDict()
        training.append({"channel": name, **few, "sufficient": few["assets"] >= plan.min_train_assets})
    scores = effectiveness(rows, found.axis, kfold, cpcv, walk, names, alpha=plan.ridge_alpha)
    return {
        "evaluation": {"estimator": "fold-local-ridge", "model": evaluate.identity(evaluate.Ridge(plan.ridge_alpha)), "cpcv_combinations": combinations, "plan": asdict(plan)},
        "training": training,
        "report": [r.asDict() for r in scores.orderBy("channel", "view", "path").collect()],  # a row for each channel, view and path
    }


def run(spark: SparkSession, request: Request) -> dict[str, Any]:
    """The answer to a request, within its time."""

    def work() -> dict[str, Any]:
        said, found = audit(spark, request)
        return said if request.action == "audit" else said | evaluated(spark, found, request.plan, request.limits)

    began = time.monotonic()
    answer = bounded(spark, request.seconds, work)
    return {"action": request.action, "request_digest": request.digest, "seconds": round(time.monotonic() - began, 3), **answer}


def _object(required: tuple[str, ...] | list[str], properties: dict[str, Any]) -> dict[str, Any]:
    return {"type": "object", "additionalProperties": False, "required": sorted(required), "properties": properties}


def schema(kind: str) -> dict[str, Any]:
    """The JSON schema of a request, a manifest or a mapping, from the rules that check them."""
    text, texts, whole = {"type": "string", "minLength": 1}, {"type": "array", "items": {"type": "string"}, "minItems": 1}, {"type": "integer", "minimum": 1}
    version = {"const": "1"}
    if kind == "request":
        plan = EvaluationPlan()
        options = {k: whole for k in CEILINGS} | {f.name: {"type": "integer", "minimum": plan.least(f.name)} for f in fields(plan)} | {"ridge_alpha": {"type": "number", "exclusiveMinimum": 0}}
        found = _object(REQUIRED, {"schema_version": version, "action": {"enum": list(ACTIONS)}, **{k: text for k in REQUIRED[2:]}, "options": _object([], options), "timeout_seconds": {"type": "integer", "minimum": LEAST_SECONDS, "maximum": MOST_SECONDS}})
    elif kind == "manifest":
        kinds = {"source_fields": texts, "parameters": {"type": "object"}, "lookback_sessions": whole, "uses_target": {"type": "boolean"}}
        feature = _object(tuple(FEATURE_KEYS), {k: kinds.get(k, text) for k in sorted(FEATURE_KEYS)})
        found = _object(("schema_version", *MANIFEST_KEYS), {"schema_version": version, "source_bundle_digest": text, "features": {"type": "array", "minItems": 1, "items": feature}})
    elif kind == "mapping":
        kinds = {"feature_columns": texts, "availability_columns": texts, "session_axis": texts, "asset_id_column": {"type": ["string", "null"]}, "pit_snapshot": _object(tuple(SNAPSHOT_KEYS), {k: text for k in sorted(SNAPSHOT_KEYS)})}
        found = _object(("schema_version", *MAPPING_KEYS), {"schema_version": version, **{k: kinds.get(k, text) for k in sorted(MAPPING_KEYS)}})
    else:
        raise RequestError("no such schema")
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", **found}


EXAMPLES = ("level", "change", "leak")


def example(name: str) -> dict[str, str]:
    """The files of a small upload of three assets: prices as they are, their changes, or the target itself, which is refused."""
    if name not in EXAMPLES:
        raise RequestError("no such example")
    days = ["2025-01-02", "2025-01-03", "2025-01-06", "2025-01-07"]
    price = {(a, k): 100 * (2 + p) + k * k * (p + 1) - k for p, a in enumerate("ABC") for k in range(len(days))}
    lines = [f"sample_id,session,asset,interval_end,target,{name},known"]
    for k in range(1, len(days) - 1):
        for a in "ABC":
            target = price[a, k + 1] / price[a, k] - 1
            value = {"level": price[a, k], "change": price[a, k] / price[a, k - 1] - 1, "leak": target}[name]
            lines.append(f"{days[k]}::{a},{days[k]}T00:00:00,{a},{days[k + 1]}T00:00:00,{target:.8f},{value:.8f},{days[k]}T00:00:00")
    source = digest(["example", name])
    feature = {
        "name": name, "source_dataset": "example", "source_fields": ["price"], "source_digest": source, "transformation": {"level": "none", "change": "change of a session", "leak": "change to the next session"}[name],
        "transformation_version": "1", "code_digest": digest(name), "parameters": {}, "lookback_sessions": 1 + (name == "change"), "computation_scope": "precomputed-stateless", "revision_policy": "point-in-time", "uses_target": name == "leak",
    }
    mapping = {
        "schema_version": "1", "sample_id_column": "sample_id", "session_column": "session", "asset_id_column": "asset", "interval_start_column": "session", "interval_end_column": "interval_end", "decision_time_column": "session",
        "target_column": "target", "feature_columns": [name], "availability_columns": ["known"], "session_axis": days, "pit_snapshot": {"snapshot_id": "example", "source_digest": source, "revision_policy": "point-in-time"},
    }
    request = {"schema_version": "1", "action": "audit", "data_path": "features.csv", "manifest_path": "manifest.json", "mapping_path": "mapping.json", "timeout_seconds": 300}
    written = lambda value: json.dumps(value, indent=2, sort_keys=True) + "\n"
    manifest = {"schema_version": "1", "source_bundle_digest": source, "features": [feature]}
    return {"features.csv": "\n".join(lines) + "\n", "manifest.json": written(manifest), "mapping.json": written(mapping), "request.json": written(request)}


def export(files: Mapping[str, str], folder: str) -> list[str]:
    """Write files into a folder that is not there yet, all or none: they are staged beside it, and one rename shows them."""
    target = Path(folder).absolute()
    if target.exists():
        raise SinkError("the folder exists already")
    target.parent.mkdir(parents=True, exist_ok=True)
    staged = target.parent / f".{target.name}-{uuid.uuid4().hex}"
    staged.mkdir()
    try:
        for name, text in files.items():
            with (staged / name).open("x", encoding="utf-8") as out:
                out.write(text)
        staged.rename(target)  # refused where a folder with files has come there meanwhile
    except OSError as error:
        raise SinkError("the files could not be exported") from error
    finally:
        shutil.rmtree(staged, ignore_errors=True)
    return sorted(files)
