"""A release gate: development, a frozen choice, one attempt at the holdout, and diagnostics, each bound to the one before.

Every stage leaves a document that names the digest of its predecessor. A stage that finds a document whose contents
are not those of its digest, or that follows another one, refuses; so does one whose data or models have changed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.errors import HoldoutError, LedgerError
from tidegate.model import WalkForward, data_digest, digest
from tidegate.operators import evaluate, metrics, splits
from tidegate.operators.holdout import HoldoutProtocol, evaluate_once
from tidegate.session import kept
from tidegate.sources.sinks import create_exclusive

STAGES = ("development", "choice", "holdout", "diagnostics")


def diagnostics(predictions: DataFrame, periods: float) -> DataFrame:
    """One row: mse, cross_sectional_ic, diagnostic_sharpe, observations, sessions, ic_sessions.

    Without a session of three rows that has a rank correlation the first is 0, without two dispersed session returns
    the second: a gate shows numbers, where `metrics.financial_metrics` shows that there is no evidence.
    """
    rows = predictions.withColumn("all", F.lit(1))
    base = rows.agg(metrics.mse().alias("mse"), F.count("*").alias("observations"), F.count_distinct("session").alias("sessions"))
    ic = metrics.session_ic(rows, ["all"]).agg(F.coalesce(F.avg("ic"), F.lit(0.0)).alias("cross_sectional_ic"), F.count("*").alias("ic_sessions"))
    ret = metrics.session_returns(rows, ["all"])
    scored = ret.agg(F.when((F.count("*") >= 2) & (F.stddev_samp("ret") > 0), metrics.sharpe("ret", periods)).otherwise(0.0).alias("diagnostic_sharpe"))
    return base.join(F.broadcast(ic)).join(F.broadcast(scored)).select("mse", "cross_sectional_ic", "diagnostic_sharpe", "observations", "sessions", "ic_sessions")  # rows of one


def smallest(scores: dict[str, float]) -> str:
    """The name of the smallest value; of equals the one that was named first."""
    return min(scores, key=scores.__getitem__)


@dataclass
class Gate:
    """The stages of one release in a folder; `models` by name, in the order that decides ties."""

    store: str
    models: dict[str, evaluate.Mean | evaluate.Ridge]
    features: list[str]
    walk: WalkForward
    periods: float = 252.0

    def _path(self, stage: str) -> str:
        return f"{self.store}/{stage}.json"

    def _keep(self, rows: DataFrame, stage: str, content: dict[str, Any], previous: dict[str, Any] | None) -> dict[str, Any]:
        document = {"stage": stage, "previous": previous["digest"] if previous else None, **content}
        document["digest"] = digest(document)
        try:
            create_exclusive(rows.sparkSession, self._path(stage), document)
        except LedgerError as error:
            raise HoldoutError(f"the stage {stage} is there already") from error
        return document

    def stage(self, rows: DataFrame, name: str) -> dict[str, Any]:
        """A stage's document, after it and all before it were found as they were written."""
        previous = None
        for stage in STAGES[: STAGES.index(name) + 1]:
            try:
                found = json.loads(rows.sparkSession.read.text(self._path(stage), wholetext=True).first()[0])
            except Exception as error:  # a missing file is named by its stage only
                raise HoldoutError(f"the stage {stage} is missing or unreadable") from error
            if digest({k: v for k, v in found.items() if k != "digest"}) != found.get("digest") or found["previous"] != (previous and previous["digest"]):
                raise HoldoutError(f"the stage {stage} was changed")
            previous = found
        return previous

    def _identities(self) -> dict[str, str]:
        return {n: evaluate.identity(m) for n, m in self.models.items()}

    def develop(self, development: DataFrame, axis: DataFrame) -> dict[str, Any]:
        """Score every model on the development samples by walk-forward."""
        assigned = splits.assignments(development, kept(splits.plan(development, axis, self.walk), "folds"))
        scores = {}
        for name, model in self.models.items():
            scores[name] = evaluate.predict(assigned, self.features, model).agg(metrics.mse()).first()[0]
        return self._keep(development, "development", {"dataset": data_digest(development), "models": self._identities(), "scores": scores}, None)

    def choose(self, development: DataFrame) -> dict[str, Any]:
        """Freeze the model of the smallest error on the very samples that were scored."""
        before = self.stage(development, "development")
        if before["dataset"] != data_digest(development) or before["models"] != self._identities():
            raise HoldoutError("the samples or the models are not those of the development stage")
        return self._keep(development, "choice", {"dataset": before["dataset"], "selected": smallest({n: before["scores"][n] for n in self.models})}, before)

    def attempt(self, development: DataFrame, held: DataFrame) -> dict[str, Any]:
        """Fit the frozen model on all development samples and score the holdout, once."""
        before = self.stage(development, "choice")
        if before["dataset"] != data_digest(development):
            raise HoldoutError("the samples are not those that the choice was made on")
        model = self.models[before["selected"]]
        protocol = HoldoutProtocol.freeze(before["digest"], development, held, model)
        predictions = f"{self.store}/holdout-predictions"
        receipt = evaluate_once(development, held, protocol, self.store, self.features, model, predictions=predictions)
        return self._keep(development, "holdout", {"holdout": data_digest(held), "receipt": receipt, "predictions": predictions}, before)

    def diagnose(self, held: DataFrame) -> dict[str, Any]:
        """Diagnostics of the attempt's own predictions; nothing is fitted again."""
        before = self.stage(held, "holdout")
        if before["holdout"] != data_digest(held):
            raise HoldoutError("the holdout is not the one that was attempted")
        rows = held.sparkSession.read.parquet(before["predictions"]).join(held.select("sample_id", "session"), "sample_id")
        found = diagnostics(rows, self.periods).first().asDict()
        if found["observations"] != before["receipt"]["samples"] or abs(found["mse"] - before["receipt"]["score"]) > 1e-12:
            raise HoldoutError("the stored predictions are not those of the receipt")
        return self._keep(held, "diagnostics", found, before)


def parts(data: DataFrame, holdout_sessions: int) -> tuple[DataFrame, DataFrame]:
    """(development, holdout): the last sessions, and the samples whose information ends before any of theirs begins."""
    last = data.select("session").distinct().orderBy(F.desc("session")).limit(holdout_sessions)
    held = kept(data.join(F.broadcast(last), "session", "left_semi"), "holdout")  # a row for each session of the holdout
    start = held.agg(F.min("info_start")).first()[0]
    return kept(data.where(F.col("info_end") < F.lit(start)), "development"), held
