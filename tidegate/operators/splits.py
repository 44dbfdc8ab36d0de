"""Leakage-exclusion splits as joins on sessions and one ordered window.

A split is a table of roles (fold, axis_pos, role, block, group): which sessions a fold tests, and which are
candidates for training. Exclusions are decided once for each distinct information interval and fold; all
rows of a session move together. Overlap with a test interval needs no range join: a candidate overlaps one
exactly if, among test intervals that start no later than it ends, the latest end reaches its start.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.errors import InvalidFoldError, SplitError
from tidegate.model import CombinatorialCV, Minimums, PurgedKFold, WalkForward
from tidegate.operators.panel import next_position

REASONS = ("purge-overlap", "embargo", "causal-future-information", "pre-test-gap")


def active_sessions(dataset: DataFrame, groups: int) -> DataFrame:
    """(axis_pos, session, place, group): sessions that occur, numbered, in `groups` chunks of almost equal size."""
    order = Window.orderBy("axis_pos")  # one row for each session
    found = dataset.select("axis_pos", "session").distinct()
    return found.withColumn("place", F.row_number().over(order).cast("long") - 1).withColumn("group", F.ntile(groups).over(order).cast("long") - 1)


def _folds(spark, tests: list[tuple[int, tuple[int, ...]]], groups: int) -> DataFrame:
    """(fold, group, role, block): adjacent test groups share a block."""
    rows = []
    for fold, chosen in tests:
        block = -1
        for g in range(groups):
            if g in chosen and g - 1 not in chosen:
                block += 1
            rows.append((fold, g, "test" if g in chosen else "candidate", block if g in chosen else None))
    return spark.createDataFrame(rows, "fold long, group long, role string, block long")


def kfold_roles(dataset: DataFrame, spec: PurgedKFold) -> DataFrame:
    sessions = active_sessions(dataset, spec.n_splits)
    folds = _folds(dataset.sparkSession, [(f, (f,)) for f in range(spec.n_splits)], spec.n_splits)
    return sessions.join(F.broadcast(folds), "group").select("fold", "axis_pos", "session", "role", "block", "group")


def cpcv_roles(dataset: DataFrame, spec: CombinatorialCV) -> DataFrame:
    sessions = active_sessions(dataset, spec.n_groups)
    folds = _folds(dataset.sparkSession, list(enumerate(spec.choices)), spec.n_groups)  # at most max_combinations folds
    return sessions.join(F.broadcast(folds), "group").select("fold", "axis_pos", "session", "role", "block", "group")


def walk_forward_roles(dataset: DataFrame, spec: WalkForward) -> DataFrame:
    """Fold i tests the sessions from n - (splits - i) * test_sessions on; candidates all come before them."""
    sessions = active_sessions(dataset, 1).drop("group")
    n = sessions.count()
    if spec.n_splits * spec.test_sessions >= n:
        raise SplitError("too few sessions for the test windows")
    first = [(i, n - (spec.n_splits - i) * spec.test_sessions) for i in range(spec.n_splits)]
    folds = dataset.sparkSession.createDataFrame([(i, s, s - (spec.max_train_sessions or s)) for i, s in first], "fold long, first long, oldest long")
    at = F.col("place")
    return (
        sessions.join(F.broadcast(folds), (at < F.col("first") + spec.test_sessions) & (at >= F.col("oldest")))
        .withColumn("role", F.when(at >= F.col("first"), "test").otherwise("candidate"))
        .withColumn("block", F.when(F.col("role") == "test", F.lit(0).cast("long")))
        .select("fold", "axis_pos", "session", "role", "block", F.lit(0).cast("long").alias("group"))
    )


def shuffled_roles(dataset: DataFrame, n_splits: int, order: list[str] | None = None, seed: int | None = None) -> DataFrame:
    """Unsafe on purpose: sessions are dealt to folds in the order of a hash, and nothing is excluded.

    With a seed the order is NumPy's permutation of the sessions in use, as a shuffled split on one machine has it.
    """
    sessions = dataset.select("axis_pos", "session").distinct()
    if seed is not None:
        places = active_sessions(dataset, 1).select("axis_pos", "place")
        drawn = np.random.default_rng(seed).permutation(places.count())
        order, turns = ["_turn"], dataset.sparkSession.createDataFrame([(int(place), turn) for turn, place in enumerate(drawn)], "place long, _turn long")
        sessions = sessions.join(places.join(F.broadcast(turns), "place").drop("place"), "axis_pos")  # a row for each session
    by = Window.orderBy(*([F.md5(F.date_format("session", "yyyy-MM-dd"))] if order is None else [F.col(c) for c in order]))
    dealt = sessions.withColumn("group", F.ntile(n_splits).over(by).cast("long") - 1)
    folds = _folds(dataset.sparkSession, [(f, (f,)) for f in range(n_splits)], n_splits)
    return dealt.join(F.broadcast(folds), "group").select("fold", "axis_pos", "session", "role", "block", "group")


def intervals(dataset: DataFrame) -> DataFrame:
    """Distinct (axis_pos, info_start, info_end) and how many rows have them."""
    return dataset.groupBy("axis_pos", "info_start", "info_end").agg(F.count("*").alias("n"))


def with_overlap(rows: DataFrame) -> DataFrame:
    """`rows` (fold, role, info_start, info_end) with `overlaps`: whether a test interval of the fold meets the row's."""
    test = F.col("role") == "test"
    upto = Window.partitionBy("fold").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("key", F.when(test, F.col("info_start")).otherwise(F.col("info_end")))
        .withColumn("reach", F.max(F.when(test, F.col("info_end"))).over(upto))
        .withColumn("overlaps", ~test & F.coalesce(F.col("reach") >= F.col("info_start"), F.lit(False)))
        .drop("key", "reach")
    )


def blocks(dataset: DataFrame, roles: DataFrame) -> DataFrame:
    """(fold, block, start_session, end_session, start_pos, session_count, last_information) of each test block."""
    tests = roles.where("role = 'test'")
    shape = tests.groupBy("fold", "block").agg(
        F.min("session").alias("start_session"), F.max("session").alias("end_session"), F.min("axis_pos").alias("start_pos"), F.count_distinct("axis_pos").alias("session_count")
    )
    ends = intervals(dataset).join(tests, "axis_pos").groupBy("fold", "block").agg(F.max("info_end").alias("last_information"))
    return shape.join(ends, ["fold", "block"])


def decide(dataset: DataFrame, axis: DataFrame, roles: DataFrame, embargo: int = 0, gap: int = 0, causal: bool = False, purge: bool = True) -> DataFrame:
    """Every interval of every fold with its role and, if excluded, the first reason that holds.

    Embargo covers the axis sessions that follow the latest information of each test block; the gap those right
    before a block. Both count sessions on the axis, not days and not sessions in use.
    """
    rows = intervals(dataset).join(F.broadcast(roles), "axis_pos")
    if purge:
        rows = with_overlap(rows)
    else:
        rows = rows.withColumn("overlaps", F.lit(False))
    shape = blocks(dataset, roles)
    held = rows.sparkSession.createDataFrame([], "fold long, axis_pos long, held boolean")
    if embargo:
        after = next_position(axis, shape.select("fold", "last_information"), "last_information")
        spans = after.select("fold", F.explode(F.sequence(F.col("next_pos"), F.col("next_pos") + embargo - 1)).alias("axis_pos"))
        held = spans.distinct().withColumn("held", F.lit(True))
    rows = rows.join(F.broadcast(held), ["fold", "axis_pos"], "left")  # folds times embargo rows
    first = shape.groupBy("fold").agg(F.min("start_session").alias("first_session"), F.min("start_pos").alias("first_pos"))
    rows = rows.join(F.broadcast(first), "fold")
    future = (F.col("info_end") >= F.col("first_session")) if causal else F.lit(False)
    before = F.col("axis_pos").between(F.col("first_pos") - gap, F.col("first_pos") - 1) if gap else F.lit(False)
    reason = F.when(F.col("overlaps"), REASONS[0]).when(F.coalesce("held", F.lit(False)), REASONS[1]).when(future, REASONS[2]).when(before, REASONS[3])
    return rows.withColumn("reason", F.when(F.col("role") == "candidate", reason)).drop("overlaps", "held", "first_session", "first_pos")


class Splitter(Protocol):
    """Anything that plans folds: `plan` returns what `decide` does, with `fold` counted from 0."""

    def plan(self, dataset: DataFrame, axis: DataFrame) -> DataFrame: ...


def plan(dataset: DataFrame, axis: DataFrame, spec: PurgedKFold | CombinatorialCV | WalkForward | Splitter) -> DataFrame:
    """`decide` with a splitter's own roles and exclusions; a user's splitter plans by itself."""
    if not isinstance(spec, PurgedKFold | CombinatorialCV | WalkForward):
        found = spec.plan(dataset, axis)
        if missing := {"fold", "axis_pos", "info_start", "info_end", "n", "role", "reason", "group", "block"} - set(found.columns):
            raise SplitError(f"the splitter's plan lacks {len(missing)} columns")
        return found
    if isinstance(spec, PurgedKFold):
        return decide(dataset, axis, kfold_roles(dataset, spec), embargo=spec.embargo)
    if isinstance(spec, CombinatorialCV):
        return decide(dataset, axis, cpcv_roles(dataset, spec), embargo=spec.embargo)
    return decide(dataset, axis, walk_forward_roles(dataset, spec), gap=spec.gap, causal=True)


def summary(decided: DataFrame) -> DataFrame:
    """Per fold: rows tested, candidates, excluded by reason, and retained."""
    of = lambda condition, name: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long").alias(name)
    candidate, reason = F.col("role") == "candidate", F.col("reason")
    names = ("purged", "embargoed", "noncausal", "pre_test_gapped")
    return decided.groupBy("fold").agg(
        of(F.col("role") == "test", "test_rows"), of(candidate, "candidates"), *[of(reason == r, n) for r, n in zip(REASONS, names, strict=True)], of(candidate & reason.isNull(), "retained")
    )


def assignments(dataset: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of `dataset` for every fold: role is test, train or excluded, the last with its reason."""
    role = F.when(F.col("role") == "test", "test").when(F.col("reason").isNull(), "train").otherwise("excluded")
    kept = decided.select("fold", "axis_pos", "info_start", "info_end", role.alias("role"), "reason", "group", "block")
    return dataset.join(kept, ["axis_pos", "info_start", "info_end"])


def fold_validity(decided: DataFrame, minimums: Minimums) -> DataFrame:
    """(fold, test_sessions, train_sessions, train_samples, message); a message names the first minimum missed."""
    train = (F.col("role") == "candidate") & F.col("reason").isNull()
    found = decided.groupBy("fold").agg(
        F.count_distinct(F.when(F.col("role") == "test", F.col("axis_pos"))).alias("test_sessions"),
        F.count_distinct(F.when(train, F.col("axis_pos"))).alias("train_sessions"),
        F.coalesce(F.sum(F.when(train, F.col("n"))), F.lit(0)).alias("train_samples"),
    )
    missed = F.lit(None).cast("string")
    checks = (("train_samples", "training samples", minimums.train_samples), ("train_sessions", "training sessions", minimums.train_sessions), ("test_sessions", "test sessions", minimums.test_sessions))
    for column, label, least in checks:
        missed = F.when(F.col(column) < least, F.format_string(f"minimum {label} not met: %d < {least}", F.col(column))).otherwise(missed)
    return found.withColumn("message", missed)


def require(decided: DataFrame, minimums: Minimums) -> None:
    bad = fold_validity(decided, minimums).where("message is not null").orderBy("fold").limit(20).collect()
    if bad:
        raise InvalidFoldError("; ".join(f"fold {r['fold']}: {r['message']}" for r in bad))


def retained_overlap(decided: DataFrame) -> DataFrame:
    """Per fold: how many training rows' intervals still meet a test interval; 0 on every safe split."""
    kept = with_overlap(decided.where("reason is null"))
    return kept.groupBy("fold").agg(F.coalesce(F.sum(F.when(F.col("overlaps"), F.col("n"))), F.lit(0)).cast("long").alias("overlap"))


def merged_intervals(rows: DataFrame, *keys: str) -> DataFrame:
    """Islands of overlapping intervals (info_start, info_end) of each key, inclusive ends: low, high, members."""
    order = Window.partitionBy(*keys).orderBy("info_start", "info_end")
    reach = F.max("info_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("opens", F.when(reach >= F.col("info_start"), 0).otherwise(1))
    numbered = opened.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("info_start").alias("low"), F.max("info_end").alias("high"), F.count("*").alias("members"))
