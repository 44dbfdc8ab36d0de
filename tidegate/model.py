"""Frozen specifications and their digests."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, is_dataclass
from hashlib import sha256
from itertools import combinations
from math import comb
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.errors import SplitError


def digest(value: Any) -> str:
    """SHA-256 of canonical JSON: sorted keys, no spaces, no NaN."""
    plain = asdict(value) if is_dataclass(value) else value
    return sha256(json.dumps(plain, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False, default=str).encode()).hexdigest()


def data_digest(df: DataFrame) -> str:
    """Digest of a table's rows in any order: their count and two sums of row hashes, computed where they lie."""
    row = F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    parts = df.select(F.xxhash64(row).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(1), row).cast("decimal(38,0)").alias("b"))
    found = parts.agg(F.count("*"), F.sum("a"), F.sum("b")).first()
    return digest([df.dtypes and sorted(map(list, df.dtypes)), *map(str, found)])


@dataclass(frozen=True)
class Minimums:
    """What each fold must keep."""

    train_sessions: int = 1
    train_samples: int = 1
    test_sessions: int = 1

    def __post_init__(self) -> None:
        for value in (self.train_sessions, self.train_samples, self.test_sessions):
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise SplitError("minimums must be integers of at least 1")


@dataclass(frozen=True)
class PurgedKFold:
    """Contiguous test chunks of sessions; training on both sides, purged and embargoed."""

    n_splits: int = 5
    embargo: int = 0
    minimums: Minimums = field(default_factory=Minimums)

    def __post_init__(self) -> None:
        if self.n_splits < 2 or self.embargo < 0:
            raise SplitError("n_splits must be at least 2 and embargo at least 0")


@dataclass(frozen=True)
class CombinatorialCV:
    """Every choice of `n_test_groups` out of `n_groups` contiguous groups is one fold."""

    n_groups: int = 6
    n_test_groups: int = 2
    embargo: int = 0
    max_combinations: int = 10_000
    minimums: Minimums = field(default_factory=Minimums)

    def __post_init__(self) -> None:
        if self.n_groups < 3 or not 2 <= self.n_test_groups < self.n_groups or self.embargo < 0:
            raise SplitError("needs at least 3 groups, 2 test groups and fewer test groups than groups")
        if comb(self.n_groups, self.n_test_groups) > self.max_combinations:
            raise SplitError("more combinations than max_combinations")

    @property
    def choices(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.n_groups), self.n_test_groups))


@dataclass(frozen=True)
class WalkForward:
    """The last `n_splits * test_sessions` sessions are tested in turn; training only on what came before."""

    n_splits: int = 5
    test_sessions: int = 1
    gap: int = 0
    max_train_sessions: int | None = None
    minimums: Minimums = field(default_factory=Minimums)

    def __post_init__(self) -> None:
        if self.n_splits < 1 or self.test_sessions < 1 or self.gap < 0 or (self.max_train_sessions is not None and self.max_train_sessions < 1):
            raise SplitError("n_splits and test_sessions must be at least 1, gap at least 0")
