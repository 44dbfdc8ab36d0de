"""Hand-computed splits, and purging against a direct search."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from math import comb

from tidegate.errors import EvaluationError, InvalidFoldError, SplitError
from tidegate.model import CombinatorialCV, Minimums, PurgedKFold, WalkForward
from tidegate.operators import metrics, panel, splits
from tidegate.operators.paths import path_table
from tidegate.plans import weekly


def day(n):
    return dt.date(2025, 1, n)


def dataset(spark, days, spans=None):
    """One sample for each day; `spans` gives other intervals by sample number."""
    rows = [(i, f"s{i}", day(d), *[day(x) for x in (spans or {}).get(i, (d, d))]) for i, d in enumerate(days)]
    frame = spark.createDataFrame(rows, "position long, sample_id string, session date, info_start date, info_end date")
    axis = panel.session_axis(frame)
    return frame.join(axis, "session"), axis


def folds(frame, decided):
    out = {}
    for r in splits.assignments(frame, decided).collect():
        out.setdefault(r["fold"], {}).setdefault(r["role"] if r["role"] != "excluded" else r["reason"], []).append(r["sample_id"])
    return {f: {k: sorted(v) for k, v in x.items()} for f, x in out.items()}


def test_purge_drops_the_overlap(spark):
    frame, axis = dataset(spark, [2, 3, 6, 7], {1: (3, 6)})
    found = splits.plan(frame, axis, PurgedKFold(2))
    assert folds(frame, found)[0] == {"test": ["s0", "s1"], "purge-overlap": ["s2"], "train": ["s3"]}
    row = splits.summary(found).where("fold = 0").first()
    assert (row["purged"], row["embargoed"], row["retained"]) == (1, 0, 1)


def test_embargo_counts_sessions_not_days(spark):
    frame, axis = dataset(spark, [2, 3, 6, 8, 9, 10])
    assert folds(frame, splits.plan(frame, axis, PurgedKFold(3, embargo=1)))[0] == {"test": ["s0", "s1"], "embargo": ["s2"], "train": ["s3", "s4", "s5"]}


def test_rows_between_test_intervals_stay(spark):
    frame, axis = dataset(spark, [1, 2, 5, 6, 11, 12], {1: (10, 10), 3: (10, 10)})
    found = folds(frame, splits.plan(frame, axis, PurgedKFold(3)))[0]
    assert found["train"] == ["s2", "s4", "s5"] and found["purge-overlap"] == ["s3"]


def test_minimums_name_the_fold(spark):
    frame, axis = dataset(spark, [2, 3, 6, 8, 9, 10])
    with pytest.raises(InvalidFoldError, match="minimum training samples not met: 4 < 5"):
        splits.require(splits.plan(frame, axis, PurgedKFold(3)), Minimums(train_samples=5))


def test_walk_forward_gap_and_future(spark):
    days = [2, 3, 6, 7, 8, 9, 10, 13]
    frame, axis = dataset(spark, days)
    found = folds(frame, splits.plan(frame, axis, WalkForward(2, 2, gap=1)))
    assert found[0] == {"test": ["s4", "s5"], "train": ["s0", "s1", "s2"], "pre-test-gap": ["s3"]}
    assert found[1] == {"test": ["s6", "s7"], "train": ["s0", "s1", "s2", "s3", "s4"], "pre-test-gap": ["s5"]}
    frame, axis = dataset(spark, days, {3: (10, 10)})
    assert folds(frame, splits.plan(frame, axis, WalkForward(2, 2)))[0]["causal-future-information"] == ["s3"]


def test_walk_forward_sliding_and_weekend(spark):
    frame, axis = dataset(spark, [2, 3, 6, 7, 8, 9, 10, 13])
    found = folds(frame, splits.plan(frame, axis, WalkForward(2, 1, max_train_sessions=2)))
    assert [found[0]["train"], found[1]["train"]] == [["s4", "s5"], ["s5", "s6"]]
    frame, axis = dataset(spark, [2, 3, 6])
    assert folds(frame, splits.plan(frame, axis, WalkForward(1, 1, gap=1)))[0] == {"train": ["s0"], "pre-test-gap": ["s1"], "test": ["s2"]}
    with pytest.raises(SplitError):
        splits.plan(frame, axis, WalkForward(3, 1))


def test_combinations_merge_adjacent_groups(spark):
    frame, axis = dataset(spark, list(range(1, 9)), {1: (1, 2)})
    spec = CombinatorialCV(4, 2, embargo=1)
    decided = splits.plan(frame, axis, spec)
    blocks = {(r["fold"], r["block"]): r["session_count"] for r in splits.blocks(frame, splits.cpcv_roles(frame, spec)).collect()}
    apart, adjacent = spec.choices.index((1, 3)), spec.choices.index((1, 2))
    assert [blocks[apart, 0], blocks[apart, 1]] == [2, 2] and blocks[adjacent, 0] == 4 and (adjacent, 1) not in blocks
    embargoed = {r["fold"]: r["embargoed"] for r in splits.summary(decided).collect()}
    assert embargoed[apart] == 1 and embargoed[adjacent] == 1
    with pytest.raises(SplitError):
        CombinatorialCV(10, 5, max_combinations=100)


@pytest.mark.parametrize(("n", "k"), [(n, k) for n in range(3, 9) for k in range(2, n)])
def test_paths_are_complete(n, k):
    table = path_table(CombinatorialCV(n, k).choices, n)
    count = comb(n - 1, k - 1)
    assert len(table) == comb(n, k) * k and {p for *_, p in table} == set(range(count))
    for path in range(count):
        assert sorted(g for _, g, p in table if p == path) == list(range(n))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000))
def test_overlap_window_equals_search(spark, seed):
    draw = np.random.default_rng(seed)
    start = draw.integers(0, 60, 120)
    rows = [(int(draw.integers(0, 3)), ["test", "candidate"][int(draw.integers(0, 2))], int(s), int(s + draw.integers(0, 12)), i) for i, s in enumerate(start)]
    frame = spark.createDataFrame(rows, "fold long, role string, info_start long, info_end long, i long")
    found = {r["i"]: r["overlaps"] for r in splits.with_overlap(frame).collect()}
    for f, role, a, b, i in rows:
        assert found[i] == (role == "candidate" and any(g == f and r == "test" and c <= b and a <= d for g, r, c, d, _ in rows))


def test_no_range_join_in_the_purge(spark):
    frame, axis = dataset(spark, [2, 3, 6, 8, 9, 10])
    text = splits.with_overlap(splits.intervals(frame).join(splits.kfold_roles(frame, PurgedKFold(3)), "axis_pos"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_seeded_shuffle_is_numpys(spark, sf_dir):
    """Each fold tests the sessions that a permutation of their numbers, cut into even chunks, gives it."""
    data, _ = weekly.modelled(spark, sf_dir)
    sessions = [r[0] for r in data.select("session").distinct().orderBy("session").collect()]
    roles = splits.shuffled_roles(data, 5, seed=11).where("role = 'test'").collect()
    for fold, chunk in enumerate(np.array_split(np.random.default_rng(11).permutation(len(sessions)), 5)):
        assert {r["session"] for r in roles if r["fold"] == fold} == {sessions[k] for k in chunk}
    assert splits.shuffled_roles(data, 5).columns == splits.shuffled_roles(data, 5, seed=1).columns


def test_rankings_need_the_same_models(spark):
    scores = lambda *rows: spark.createDataFrame(rows, "model string, regime long, mse double")
    good = scores(("a", 0, 1.0), ("b", 0, 2.0), ("a", 1, 2.0), ("b", 1, 1.0), ("c", 0, 3.0), ("c", 1, 3.0))
    assert [r["model"] for r in metrics.model_summary(metrics.model_ranks(metrics.require_same_models(good))).collect()] == ["a", "b", "c"]
    for bad in (scores(("a", 0, 1.0), ("b", 0, 2.0), ("a", 1, 2.0)), scores(("a", 0, 1.0), ("a", 0, 1.0), ("b", 0, 1.0), ("a", 1, 1.0), ("b", 1, 1.0))):
        with pytest.raises(EvaluationError, match="same models"):
            metrics.require_same_models(bad)
    with pytest.raises(EvaluationError, match="two regimes"):
        metrics.require_same_models(scores(("a", 0, 1.0), ("b", 0, 1.0)))
