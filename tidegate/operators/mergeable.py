"""Transformers and estimators that learn from sums of partial states, so that no fold is ever in one task.

A step learns in rounds. In each, tasks turn the rows they hold into one partial state for each fold, states of a fold
are merged in two levels, and what is merged advances the fold's knowledge, whose size is bounded. A sample is one
row with the folds that train on it, so it is read once a round for all of them, not copied for each. Later steps see
rows as earlier ones transform them. Rounds that need a part of the rows only, as mini-batches do, read that part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.errors import EvaluationError
from tidegate.session import shared_path

#: Bytes of knowledge and states that are at work at once; where folds need more, they take turns.
AT_ONCE = 64 << 20
#: States of a fold first meet in so many groups, then in one.
SALTS = 32


class Step:
    """What transformers and estimators share. `known` is None in the first round, then what `advance` returned."""

    name, version = "", "1"

    def planned(self, rows: int) -> Step:
        """The step for folds of at most so many training rows."""
        return self

    @property
    def parts(self) -> int:
        """Into how many parts rows are dealt by a hash of their identity."""
        return 1

    def rounds(self, width: int) -> int:
        return 1

    def part(self, turn: int) -> int | None:
        """The part of the rows that a round reads, or None for all."""
        return None

    def size(self, width: int) -> int:
        """How many numbers knowledge and state have at most."""
        raise NotImplementedError

    def partial(self, known: np.ndarray | None, x: np.ndarray, y: np.ndarray, turn: int) -> np.ndarray:
        raise NotImplementedError

    def merge(self, a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
        return a + b

    def advance(self, known: np.ndarray | None, state: np.ndarray, width: int, turn: int) -> np.ndarray:
        return state


class Transformer(Step):
    def transform(self, known: np.ndarray, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class Estimator(Step):
    def predict(self, known: np.ndarray, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError


def moments(z: np.ndarray) -> np.ndarray:
    """Number of rows, means and sums of products of deviations from them, as one array."""
    mean = z.mean(axis=0)
    return np.concatenate([[len(z)], mean, ((z - mean).T @ (z - mean)).ravel()])


def merged_moments(a: np.ndarray, b: np.ndarray, turn: int = 0) -> np.ndarray:
    k = int(np.sqrt(len(a)))  # there are 1 + k + k * k numbers
    n, gap = a[0] + b[0], b[1 : k + 1] - a[1 : k + 1]
    return np.concatenate([[n], a[1 : k + 1] + gap * (b[0] / n), a[k + 1 :] + b[k + 1 :] + (np.outer(gap, gap) * (a[0] * b[0] / n)).ravel()])


def _spread(variance: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.maximum(variance, 0))
    return np.where(scale > 1e-12, scale, 1.0)


@dataclass(frozen=True)
class Standardise(Transformer):
    """Features less their mean, over their population deviation; constant ones count as unscaled."""

    name = "standardise"

    def size(self, width: int) -> int:
        return 1 + 2 * width

    def partial(self, known, x, y, turn):
        mean = x.mean(axis=0)
        return np.concatenate([[len(x)], mean, ((x - mean) ** 2).sum(axis=0)])

    def merge(self, a, b, turn):
        k = len(a) // 2
        n, gap = a[0] + b[0], b[1 : k + 1] - a[1 : k + 1]
        return np.concatenate([[n], a[1 : k + 1] + gap * (b[0] / n), a[k + 1 :] + b[k + 1 :] + gap**2 * (a[0] * b[0] / n)])

    def advance(self, known, state, width, turn):
        return np.stack([state[1 : width + 1], _spread(state[width + 1 :] / state[0])])

    def transform(self, known, x):
        return (x - known[0]) / known[1]


#: Bits of a value that a round of QuantileClip settles, and its rounds.
DIGIT, DIGITS = 11, 6


def _ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; minus zero counts as zero."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _value(key: np.ndarray) -> np.ndarray:
    return np.where(key >> np.uint64(63), key ^ np.uint64(1 << 63), ~key).view(np.float64)


@dataclass(frozen=True)
class QuantileClip(Transformer):
    """Features held between two quantiles of the training rows: the smallest values that so large a share does not exceed.

    Exact: each round counts the next bits of the values that agree with the quantile so far, in a histogram.
    """

    low: float = 0.01
    high: float = 0.99
    name = "quantile-clip"

    def __post_init__(self) -> None:
        if not 0 <= self.low < self.high <= 1:
            raise EvaluationError("quantiles must rise within 0 to 1")

    def rounds(self, width: int) -> int:
        return DIGITS

    def size(self, width: int) -> int:
        return 2 * width << DIGIT

    def partial(self, known, x, y, turn):
        below = 64 - DIGIT * (turn + 1)
        keys, counts = _ordered(x), np.zeros((2, x.shape[1], 1 << DIGIT))
        digit = (keys >> np.uint64(below) if below >= 0 else keys << np.uint64(-below)) & np.uint64((1 << DIGIT) - 1)
        for q in range(2):
            for j in range(x.shape[1]):
                same = slice(None) if turn == 0 else keys[:, j] >> np.uint64(below + DIGIT) == known[q, j, 0]
                counts[q, j] = np.bincount(digit[same, j].astype(np.int64), minlength=1 << DIGIT)
        return counts.ravel()

    def advance(self, known, state, width, turn):
        upto = state.reshape(2, width, 1 << DIGIT).cumsum(axis=2)
        if known is None:
            rank = [np.maximum(np.ceil(upto[q, :, -1] * share - 1e-9), 1) for q, share in enumerate((self.low, self.high))]
            known = np.stack([np.zeros((2, width)), np.stack(rank)], axis=2).astype(np.uint64)
        place = (upto < known[:, :, 1:]).sum(axis=2)
        before = np.take_along_axis(np.concatenate([np.zeros((2, width, 1)), upto], axis=2), place[:, :, None], axis=2)[:, :, 0]
        prefix = (known[:, :, 0] << np.uint64(DIGIT)) | place.astype(np.uint64)
        if turn + 1 < DIGITS:
            return np.stack([prefix, known[:, :, 1] - before.astype(np.uint64)], axis=2)
        over = DIGIT * DIGITS - 64  # bits of the last digit beyond the value's 64
        return _value((known[:, :, 0] << np.uint64(DIGIT - over)) | (place.astype(np.uint64) >> np.uint64(over)))

    def transform(self, known, x):
        return np.clip(x, known[0], known[1])


@dataclass(frozen=True)
class PrincipalComponents(Transformer):
    """The first `count` principal components of the training rows, each with its largest loading positive."""

    count: int = 2
    name = "principal-components"

    def size(self, width: int) -> int:
        return 1 + width + width * width

    def partial(self, known, x, y, turn):
        return moments(x)

    merge = staticmethod(merged_moments)

    def advance(self, known, state, width, turn):
        if not 0 < self.count <= width:
            raise EvaluationError("more components than features")
        vectors = np.linalg.eigh(state[width + 1 :].reshape(width, width) / state[0])[1][:, ::-1][:, : self.count]
        largest = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None, :], axis=0)
        return np.vstack([state[1 : width + 1], (vectors * np.where(largest < 0, -1, 1)).T])

    def transform(self, known, x):
        return (x - known[0]) @ known[1:].T


@dataclass(frozen=True)
class RidgeSums(Estimator):
    """Ridge regression on population-standardised features, the intercept unpenalised, from one block of products."""

    alpha: float = 1.0
    name = "ridge-sums"

    def size(self, width: int) -> int:
        return 1 + (width + 1) * (width + 2)

    def partial(self, known, x, y, turn):
        return moments(np.column_stack([x, y]))

    merge = staticmethod(merged_moments)

    def advance(self, known, state, width, turn):
        n, mean, cross = state[0], state[1 : width + 2], state[width + 2 :].reshape(width + 1, width + 1)
        scale = _spread(np.diag(cross)[:width] / n)
        gram = cross[:width, :width] / np.outer(scale, scale) + self.alpha * np.eye(width)
        slope = np.linalg.solve(gram, cross[:width, width] / scale) / scale
        return np.append(mean[width] - slope @ mean[:width], slope)

    def predict(self, known, x):
        return known[0] + x @ known[1:]


@dataclass(frozen=True)
class SequenceModel(Estimator):
    """A small LSTM over a row's features as one sequence, the last output read by a linear head.

    Features are standardised over the fold's training rows. Each mini-batch is a part of the rows, by hash, and one
    round: tasks run backpropagation through time on the rows they hold, gradients of the squared error are summed, and
    one step of Adam follows. Mini-batches have `batch` rows, more where an epoch would take over `most_batches`.
    """

    hidden: int = 8
    epochs: int = 2
    batch: int = 1024
    rate: float = 0.005
    seed: int = 0
    most_batches: int = 64
    batches: int = 1
    name = "sequence-model"

    def __post_init__(self) -> None:
        if min(self.hidden, self.epochs, self.batch, self.most_batches, self.batches) < 1 or self.rate <= 0:
            raise EvaluationError("sequence model parameters must be positive")

    def planned(self, rows: int) -> SequenceModel:
        return replace(self, batches=max(1, min(-(-rows // self.batch), self.most_batches)))

    @property
    def parts(self) -> int:
        return self.batches

    def rounds(self, width: int) -> int:
        return 1 + self.epochs * self.batches

    def part(self, turn: int) -> int | None:
        return (turn - 1) % self.batches if turn else None

    @property
    def weights(self) -> int:
        h = self.hidden
        return 4 * h * (h + 2) + h + 1

    def size(self, width: int) -> int:
        return 2 * width + 1 + 3 * self.weights

    def _unpack(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
        """Input weights, recurrent weights and biases of the gates (in, forget, cell, out), head weights and bias."""
        h = self.hidden
        ends = np.cumsum([4 * h, 4 * h * h, 4 * h, h])
        w, u, b, head, bias = np.split(theta, ends)
        return w, u.reshape(4 * h, h), b, head, bias[0]

    def forward(self, theta: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """Predictions, and what backpropagation needs of each place in the sequence."""
        w, u, b, head, bias = self._unpack(theta)
        h = np.zeros((len(x), self.hidden))
        c, trace = np.zeros_like(h), []
        for t in range(x.shape[1]):
            gates = x[:, t, None] * w + h @ u.T + b
            i, f, g, o = np.split(gates, 4, axis=1)
            i, f, g, o = 1 / (1 + np.exp(-i)), 1 / (1 + np.exp(-f)), np.tanh(g), 1 / (1 + np.exp(-o))
            before, c_before = h, c
            c = f * c + i * g
            s = np.tanh(c)
            h = o * s
            trace.append((i, f, g, o, s, before, c_before))
        return h @ head + bias, [*trace, h]

    def gradient(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rows, their squared error, and its gradient by all weights."""
        _, u, _, head, _ = self._unpack(theta)
        predicted, (*trace, last) = self.forward(theta, x)
        error = predicted - y
        d_head, d_bias = 2 * error @ last, 2 * error.sum()
        dw, du, db = np.zeros(4 * self.hidden), np.zeros_like(u), np.zeros(4 * self.hidden)
        dh, dc = 2 * error[:, None] * head, np.zeros_like(last)
        for t in range(x.shape[1] - 1, -1, -1):
            i, f, g, o, s, before, c_before = trace[t]
            dc = dc + dh * o * (1 - s * s)
            gates = np.hstack([dc * g * i * (1 - i), dc * c_before * f * (1 - f), dc * i * (1 - g * g), dh * s * o * (1 - o)])
            dw, du, db = dw + x[:, t] @ gates, du + gates.T @ before, db + gates.sum(axis=0)
            dh, dc = gates @ u, dc * f
        return np.concatenate([[len(y), error @ error], dw, du.ravel(), db, d_head, [d_bias]])

    def partial(self, known, x, y, turn):
        if turn == 0:
            return Standardise().partial(None, x, y, 0)
        width, n = x.shape[1], self.weights
        theta, x = known[-n:], (x - known[:width]) / known[width : 2 * width]
        return reduce(np.add, [self.gradient(theta, x[k : k + 4096], y[k : k + 4096]) for k in range(0, len(x), 4096)])

    def merge(self, a, b, turn):
        return a + b if turn else Standardise().merge(a, b, turn)

    def advance(self, known, state, width, turn):
        n = self.weights
        if turn == 0:
            bound = 1 / np.sqrt(self.hidden)
            return np.concatenate([*Standardise().advance(None, state, width, 0), np.zeros(1 + 2 * n), np.random.default_rng(self.seed).uniform(-bound, bound, n)])
        fixed, t = known[: 2 * width], known[2 * width] + 1
        m, v, theta = np.split(known[2 * width + 1 :], 3)
        slope = state[2:] / state[0]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta - self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return np.concatenate([fixed, [t], m, v, theta])

    def predict(self, known, x):
        width = x.shape[1]
        return self.forward(known[-self.weights :], (x - known[:width]) / known[width : 2 * width])[0]


@dataclass
class Learned:
    """What each step knows of each fold."""

    steps: tuple[Step, ...]
    known: list[dict[int, np.ndarray]] = field(default_factory=list)


def train_rows(dataset: DataFrame, decided: DataFrame, features: list[str], keys: tuple[str, ...], parts: int) -> DataFrame:
    """(part, folds, x, y) of each sample that some fold trains on; folds are decided by interval, so rows are not copied."""
    at = ["axis_pos", "info_start", "info_end"]
    train = decided.where("role = 'candidate' and reason is null").groupBy(*at).agg(F.collect_list(F.col("fold").cast("long")).alias("_folds"))
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    return dataset.join(train, at).select(part.alias("part"), F.col("_folds").alias("folds"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col("target").cast("double").alias("y"))


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _passed(steps: tuple[Step, ...], known: list[dict[int, np.ndarray]], fold: int, x: np.ndarray) -> np.ndarray:
    for step, of in zip(steps, known, strict=False):
        x = step.transform(of[fold], x)
    return x


def _round(rows: DataFrame, steps: tuple[Step, ...], earlier: list[dict[int, np.ndarray]], known: dict[int, np.ndarray], folds: set[int], width: int, turn: int) -> dict[int, np.ndarray]:
    """Merged states of `folds` in one round of the step that follows the `earlier` ones."""
    step = steps[len(earlier)]

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            x, y, lists = _matrix(batch["x"], width), batch["y"].to_numpy(zero_copy_only=False), batch["folds"]
            fold, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths())
            for k in folds.intersection(np.unique(fold).tolist()):
                at = row[fold == k]
                state = np.asarray(step.partial(known.get(k), _passed(steps, earlier, k, x[at]), y[at], turn), float)
                found[k] = step.merge(found[k], state, turn) if k in found else state
        columns = [pa.array(list(found), pa.int64()), pa.array([s.tobytes() for s in found.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["fold", "state"])

    def merge(table: pa.Table) -> pa.Table:
        states = [np.frombuffer(s) for s in table["state"].to_pylist()]
        return pa.table([table["fold"][:1], pa.array([reduce(lambda a, b: step.merge(a, b, turn), states).tobytes()], pa.binary())], ["fold", "state"])

    made = rows.mapInArrow(partials, "fold long, state binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    schema = "fold long, state binary"
    salted = made.groupBy("fold", "salt").applyInArrow(merge, schema)
    return {r["fold"]: np.frombuffer(r["state"]) for r in salted.groupBy("fold").applyInArrow(merge, schema).collect()}  # a row for each fold


def learn(dataset: DataFrame, decided: DataFrame, features: list[str], steps: tuple[Step, ...], keys: tuple[str, ...] = ("asset", "session")) -> Learned:
    """Fit all steps in order on each fold's training rows; a fold without any is refused."""
    sizes = {r["fold"]: r["n"] for r in decided.groupBy("fold").agg(F.sum(F.when(F.expr("role = 'candidate' and reason is null"), F.col("n"))).alias("n")).collect()}
    if empty := sum(not n for n in sizes.values()):
        raise EvaluationError(f"{empty} folds have no training rows")
    if any(not isinstance(s, Transformer) for s in steps[:-1]):
        raise EvaluationError("all steps but the last must be transformers")
    spark, steps = dataset.sparkSession, tuple(s.planned(max(sizes.values(), default=0)) for s in steps)
    out = Learned(steps)
    tables: dict[int, DataFrame] = {}
    width = len(features)
    for step in steps:
        if step.parts not in tables:
            path = shared_path(spark, "train-rows")
            train_rows(dataset, decided, features, keys, step.parts).write.partitionBy("part").parquet(path)
            tables[step.parts] = spark.read.schema("folds array<long>, x array<double>, y double, part int").parquet(path)
        known: dict[int, np.ndarray] = {}
        at_once = max(1, AT_ONCE // (8 * step.size(width)))
        for k in range(0, len(sizes), at_once):
            folds = set(sorted(sizes)[k : k + at_once])
            for turn in range(step.rounds(width)):
                rows = tables[step.parts] if step.part(turn) is None else tables[step.parts].where(F.col("part") == step.part(turn))
                states = _round(rows, steps, out.known, {f: known[f] for f in folds if f in known}, folds, len(features), turn)
                # a small fold may have no rows in a part; it stays as it was
                known |= {f: step.advance(known.get(f), s, width, turn) for f, s in states.items()}
        if isinstance(step, Transformer):
            width = step.transform(next(iter(known.values())), np.zeros((1, width))).shape[1] if known else width
        out.known.append(known)
    return out


def apply(assigned: DataFrame, features: list[str], learned: Learned, keys: tuple[str, ...] = ("asset", "session")) -> DataFrame:
    """(fold, *keys, target, prediction) of the test rows in `assigned` (fold, role, *keys, target, features)."""
    kinds = dict(assigned.dtypes)
    names = ["fold", *keys, "target"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, out = batch["fold"].to_numpy(), np.zeros(len(batch))
            x = _matrix(batch["_x"], len(features)) if len(batch) else np.zeros((0, len(features)))
            for k in np.unique(fold).tolist():
                at = fold == k
                out[at] = learned.steps[-1].predict(learned.known[-1][k], _passed(learned.steps[:-1], learned.known[:-1], k, x[at]))
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(out)], [*names, "prediction"])

    rows = assigned.where("role = 'test'").select(F.col("fold").cast("long").alias("fold"), *keys, F.col("target").cast("double").alias("target"), F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    schema = "fold long, " + ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", target double, prediction double"
    return rows.mapInArrow(predict, schema)


def fit_predict(dataset: DataFrame, decided: DataFrame, assigned: DataFrame, features: list[str], steps: tuple[Step, ...], keys: tuple[str, ...] = ("asset", "session")) -> DataFrame:
    """Test rows of all folds with predictions, which are finite or an error."""
    found = apply(assigned, features, learn(dataset, decided, features, steps), keys)
    return found.withColumn("prediction", F.when(F.isnan("prediction") | (F.abs("prediction") == float("inf")), F.raise_error(F.lit("a prediction is not finite"))).otherwise(F.col("prediction")))


class Measure:
    """A score of a ledger that is finished from merged partial states; `partial` gets targets and predictions."""

    name, version = "", "1"

    def partial(self, target: np.ndarray, prediction: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b

    def finish(self, state: np.ndarray) -> float:
        raise NotImplementedError


@dataclass(frozen=True)
class QuantileLoss(Measure):
    """The mean pinball loss of predictions of a quantile."""

    share: float = 0.5
    name = "quantile-loss"

    def partial(self, target, prediction):
        gap = target - prediction
        return np.array([len(gap), np.maximum(self.share * gap, (self.share - 1) * gap).sum()])

    def finish(self, state):
        return state[1] / state[0]


@dataclass(frozen=True)
class Concordance(Measure):
    """The concordance correlation of targets and predictions; equal constants agree wholly."""

    name = "concordance"

    def partial(self, target, prediction):
        return moments(np.column_stack([target, prediction]))

    merge = staticmethod(merged_moments)

    def finish(self, state):
        n, x, y, a, c, _, b = state
        below = (a + b) / n + (x - y) ** 2
        return float(2 * c / n / below) if below > 0 else 1.0


def measured(rows: DataFrame, measures: dict[str, Measure], scopes: dict[str, str]) -> DataFrame:
    """(metric, scope, key, value, n) of `rows` (target, prediction and the columns of `scopes`), in two phases.

    Scopes name a long column each; rows whose column is null have no part in that scope. A task sends one state for
    each measure and group that it has rows of, so no group is ever whole in a task.
    """
    names, at = list(measures), list(scopes.items())

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        counts: dict[tuple, int] = {}
        for batch in batches:
            target, prediction = (batch[c].to_numpy(zero_copy_only=False) for c in ("target", "prediction"))
            for scope, column in at:
                here = batch[column].is_valid().to_numpy(zero_copy_only=False)
                key = batch[column].fill_null(0).to_numpy()
                for k in np.unique(key[here]).tolist():
                    some = here & (key == k)
                    for name in names:
                        where = (name, scope, k)
                        state = np.asarray(measures[name].partial(target[some], prediction[some]), float)
                        found[where] = measures[name].merge(found[where], state) if where in found else state
                        counts[where] = counts.get(where, 0) + int(some.sum())
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array([s.tobytes() for s in found.values()], pa.binary()), pa.array(list(counts.values()), pa.int64())],
            ["metric", "scope", "key", "state", "n"],
        )

    def merged(table: pa.Table) -> pa.Table:
        measure = measures[table["metric"][0].as_py()]
        state = reduce(measure.merge, [np.frombuffer(s) for s in table["state"].to_pylist()])
        return pa.table([*(table[c][:1] for c in ("metric", "scope", "key")), pa.array([state.tobytes()], pa.binary()), pa.array([sum(table["n"].to_pylist())], pa.int64())], ["metric", "scope", "key", "state", "n"])

    def finished(table: pa.Table) -> pa.Table:
        row = merged(table)
        value = float(measures[row["metric"][0].as_py()].finish(np.frombuffer(row["state"][0].as_py())))
        return pa.table([*(row[c] for c in ("metric", "scope", "key")), pa.array([value]), row["n"]], ["metric", "scope", "key", "value", "n"])

    narrow = rows.select(F.col("target").cast("double").alias("target"), F.col("prediction").cast("double").alias("prediction"), *[F.col(c).cast("long").alias(c) for c in scopes.values()])
    state = "metric string, scope string, key long, state binary, n long"
    made = narrow.mapInArrow(partials, state).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    salted = made.groupBy("metric", "scope", "key", "salt").applyInArrow(merged, state)
    return salted.groupBy("metric", "scope", "key").applyInArrow(finished, "metric string, scope string, key long, value double, n long")
