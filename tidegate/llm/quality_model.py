"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded; gated attention, learnt from document labels
alone, weighs the passages, and the weighted representation is scored. Labels are learnt from a bounded
sample of labelled rows; scoring covers every passage of every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import stored
from tidegate.llm.hashing import slabs
from tidegate.llm.signals import NAMES, signals

#: Words in a passage; the last one of a text may be shorter.
PASSAGE_WORDS = 100
#: Numbers of a training sample that the driver holds at most; a labelled text with more than a fiftieth of them is left out of it.
SAMPLE_VALUES = 4_000_000
#: Passages that are scored at once.
SCORED = 100_000


def passages(text: bytes | None, size: int = PASSAGE_WORDS) -> np.ndarray:
    """Signals of each passage of a whole text, one row each; a text without words has one row of zeros."""
    words = text.split() if text else []
    return np.array([signals(words[i : i + size]) for i in range(0, len(words) or 1, size)], np.float64)


@dataclass
class AttentionModel:
    """Encoder (w, b), gated attention (v, u, a) and the scorer (c, d) over standardised signals."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        p = self.weights
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(z @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        return z, h, t, s, (t * s) @ p["a"]

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 for each bag, which holds one passage at least."""
        out = [np.zeros(0)]
        for a, b in slabs(map(len, bags), SCORED):
            sizes = np.array([len(x) for x in bags[a:b]])
            starts = np.cumsum(sizes) - sizes
            _, h, _, _, e = self.parts(np.concatenate(bags[a:b]))
            weight = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
            pooled = np.add.reduceat(weight[:, None] * h, starts) / np.add.reduceat(weight, starts)[:, None]
            out.append(1 / (1 + np.exp(-np.clip(pooled @ self.weights["c"] + self.weights["d"][0], -30, 30))))
        return np.concatenate(out)


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 16, gate: int = 8, rounds: int = 300, rate: float = 0.02, decay: float = 1e-4) -> AttentionModel:
    """Adam on the class-balanced log loss of the bags; the start is seeded, so reruns agree."""
    x, bag = np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    random, k = np.random.default_rng(7), x.shape[1]
    draw = lambda *shape: random.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"w": draw(k, hidden), "b": np.zeros(hidden), "v": draw(hidden, gate), "u": draw(hidden, gate), "a": draw(gate), "c": draw(hidden), "d": np.zeros(1)}
    model = AttentionModel(x.mean(0), x.std(0) + 1e-3, p)
    starts = np.r_[0, np.cumsum([len(b) for b in bags])[:-1]]
    positive = labels.mean()
    balance = np.where(labels == 1, 0.5 / max(positive, 1e-9), 0.5 / max(1 - positive, 1e-9)) / len(labels)
    first, second = ({n: np.zeros_like(q) for n, q in p.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        z, h, t, s, e = model.parts(x)
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        alpha = e / np.add.reduceat(e, starts)[bag]
        pooled = np.add.reduceat(alpha[:, None] * h, starts)
        wrong = (1 / (1 + np.exp(-(pooled @ p["c"] + p["d"][0]))) - labels) * balance
        to_pooled = (wrong[:, None] * p["c"])[bag]
        to_alpha = (to_pooled * h).sum(1)
        to_e = alpha * (to_alpha - np.add.reduceat(alpha * to_alpha, starts)[bag])
        to_gate = to_e[:, None] * p["a"]
        to_t, to_s = to_gate * s * (1 - t * t), to_gate * t * s * (1 - s)
        to_h = alpha[:, None] * to_pooled + to_t @ p["v"].T + to_s @ p["u"].T
        to_z = to_h * (1 - h * h)
        slope = {"w": z.T @ to_z, "b": to_z.sum(0), "v": h.T @ to_t, "u": h.T @ to_s, "a": (t * s).T @ to_e, "c": pooled.T @ wrong, "d": np.array([wrong.sum()])}
        for n, q in p.items():
            g = slope[n] + decay * q
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.999 * second[n] + 0.001 * g * g
            q -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-9)
    return model


def held_out(doc_id: str | Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int, allowed: Column | None = None) -> DataFrame:
    """(doc_id, text, quality) of at most `sample_rows` labelled documents, those of smallest id hash.

    Rows of unlabelled ids, null labels and rows that `allowed` excludes are left out; a repeated label counts once.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    known = known.where(allowed) if allowed is not None else known
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    return docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")  # at most sample_rows ids


def collected_sample(rows: DataFrame, column: str, sample_rows: int, sample_values: int) -> list:
    """Rows (doc_id, quality, `column`: an array of numbers) of a labelled sample on the driver, by the ids' hash.

    The driver gets at most `sample_rows` rows and `sample_values` numbers: rows with more than a fiftieth of these
    are left out, and of the others, where they are more, those of larger hash. What is given up is a training row,
    never a row to score. The sizes are added up in a table of a number a row, so no task holds the sample either.
    """
    rows = stored(rows.withColumn("at", F.xxhash64("doc_id")).where(F.size(column).between(1, sample_values // 50)), "labelled")
    sizes = rows.groupBy("at").agg(F.sum(F.size(column)).alias("n"))
    upto = sizes.withColumn("n", F.sum("n").over(Window.orderBy("at")))  # at most sample_rows ids
    last = upto.where(F.col("n") <= sample_values).agg(F.max("at")).first()[0]
    if last is None:
        return []
    return rows.where(F.col("at") <= last).orderBy("at", "doc_id", column).limit(sample_rows).select("quality", column).toArrow().to_pylist()


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, folds: int = 3, fold: int = 1, sample_values: int = SAMPLE_VALUES) -> AttentionModel | float:
    """Fit on labelled rows outside the held-out fold. With one class or none the model is a constant score.

    The sample is bounded as `collected_sample` says. Null and empty texts count as one empty passage; repeated ids
    and labels are one label; columns of either table beside doc_id, text and quality are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [passages(t).ravel() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bags, pa.list_(pa.float64()))], ["doc_id", "quality", "bag"])

    sample = labelled_sample(docs, labels, sample_rows, ~held_out("doc_id", folds, fold)).select(F.col("doc_id").cast("long"), "text", F.col("quality").cast("int"))
    rows = collected_sample(sample.mapInArrow(encode, "doc_id long, quality int, bag array<double>"), "bag", sample_rows, sample_values)
    y = np.array([r["quality"] for r in rows], np.float64)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    return fit([np.asarray(r["bag"]).reshape(-1, len(NAMES)) for r in rows], y)


def score(docs: DataFrame, model: AttentionModel | float) -> DataFrame:
    """(doc_id, score, n_passages) of every row.

    Null and empty texts are one empty passage; a text of any length is scored whole; equal texts score alike and
    repeated rows each get a row; an empty table gives none; columns beside doc_id and text are ignored.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [passages(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            scores = np.full(len(bags), model) if isinstance(model, float) else model.scores(bags)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([len(b) for b in bags], pa.int64())], ["doc_id", "score", "n_passages"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(apply, "doc_id long, score double, n_passages long")
