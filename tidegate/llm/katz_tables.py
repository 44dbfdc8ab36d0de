"""Katz backoff models of any order, kept as tables: fitted once, then asked about any texts.

`katz.score` learns from a table and scores that same table, at order two, in one pass that keeps nothing. A model
here is a folder: counts of all n-grams, partitioned by level; for each level the probabilities of the n-grams seen
and the weights of their histories; and one row a level with its counts of counts. At order two both give equal scores.

A frequent word is one key in the joins with the lowest level. It stands on the large side only, whose partitions
adaptive execution splits; the side it meets has one row a key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.common import stored
from tidegate.llm.hashing import pair, word_hashes
from tidegate.llm.katz import END, GOOD_TURING, START, Words, discounts
from tidegate.llm.keyed import RANKS

COUNTED = "history long, gram long, lower long, count long, level int"
LEVELS = "level int, total long, distinct long, ranks array<long>"
GRAMS = "gram long, probability double"
HISTORIES = "history long, size double, weight double"


def _grams(texts: list[bytes | None], order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Tokens of each text, and for each level the (history, n-gram) of every token; a text starts after START alone."""
    hashes = [np.append(word_hashes((t or b"").lower().split()), END) for t in texts]
    sizes = np.array([len(h) for h in hashes], np.int64)
    starts = np.cumsum(sizes) - sizes

    def before(x: np.ndarray, at_start: np.ndarray) -> np.ndarray:
        moved = np.roll(x, 1)
        moved[starts] = at_start
        return moved

    word = np.concatenate(hashes)
    opening = np.array([START])
    history = last = before(word, opening)
    found = [(np.zeros(len(word), np.uint64), word)]
    for _ in range(order - 1):
        found.append((history, pair(history, word, 1)))
        history, opening = pair(before(history, opening), last), pair(opening, np.array([START]))
    return sizes, found


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _counts(docs: DataFrame, order: int) -> DataFrame:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, found = _grams(batch["text"].cast(pa.binary()).to_pylist(), order)
            for level, (history, gram) in enumerate(found, 1):
                grams, first, n = np.unique(gram, return_index=True, return_counts=True)
                lower = found[level - 2][1][first] if level > 1 else np.zeros(len(grams), np.uint64)
                columns = [_signed(history[first]), _signed(grams), _signed(lower), pa.array(n), pa.array(np.full(len(n), level, np.int32))]
                yield pa.record_batch(columns, ["history", "gram", "lower", "count", "level"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, COUNTED)
    return rows.groupBy("history", "gram", "lower", "level").agg(F.sum("count").alias("count")).select("history", "gram", "lower", "count", "level")


def _discounted(ranks: list[int]) -> Column:
    """The part of `count` that is left after discounting."""
    factors = F.array(*[F.lit(float(x)) for x in discounts(np.array(ranks))])
    return factors[F.least("count", F.lit(GOOD_TURING + 1)).cast("int")] * F.col("count")


@dataclass(frozen=True)
class Model:
    """A fitted model's folder, its order, and the lowest level's totals."""

    path: str
    order: int
    words: Words

    def table(self, spark: SparkSession, name: str, level: int, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.path}/{name}-{level}")


def load(spark: SparkSession, path: str) -> Model:
    """A model that `fit` has written; a row for each level comes to the driver."""
    rows = sorted(spark.read.schema(LEVELS).parquet(f"{path}/levels").collect())
    return Model(path, len(rows), Words.of(np.r_[rows[0]["total"], rows[0]["distinct"], rows[0]["ranks"]]))


def fit(docs: DataFrame, path: str, order: int = 2) -> Model:
    """Write a model of `docs` to `path`, a folder that driver and executors share; only column `text` is read.

    Null and empty texts have one token, their end. Rows repeated count as often as they occur. Without rows every
    token is unknown, with probability one.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    spark = docs.sparkSession
    _counts(docs, order).write.partitionBy("level").parquet(f"{path}/counts")
    counts = spark.read.schema(COUNTED).parquet(f"{path}/counts")
    ranks = F.array(*[F.count_if(F.col("count") == r) for r in range(1, RANKS + 1)])
    seen = counts.groupBy("level").agg(F.sum("count").alias("total"), F.count("*").alias("distinct"), ranks.alias("ranks"))
    every = spark.range(1, order + 1).select(F.col("id").cast("int").alias("level"))
    none = F.array(*[F.lit(0).cast("long")] * RANKS)
    seen = every.join(seen, "level", "left").select("level", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "distinct")], F.coalesce("ranks", none).alias("ranks"))
    seen.coalesce(1).write.parquet(f"{path}/levels")
    model = load(spark, path)
    ranked = {r["level"]: r["ranks"] for r in spark.read.schema(LEVELS).parquet(f"{path}/levels").collect()}
    lowest = counts.where("level = 1").select("gram", (_discounted(ranked[1]) / model.words.base).alias("probability"))
    lowest.write.parquet(f"{path}/grams-1")
    for level in range(2, order + 1):
        rows = counts.where(F.col("level") == level).withColumn("left", _discounted(ranked[level]))
        lower = model.table(spark, "grams", level - 1, GRAMS).select(F.col("gram").alias("lower"), F.col("probability").alias("covers"))
        sums = rows.join(lower, "lower").groupBy("history").agg(F.sum("count").alias("n"), F.sum("left").alias("spent"), F.sum("covers").alias("covered"))
        size = F.col("n") + F.when(F.col("n") - F.col("spent") < 1e-9, 1.0).otherwise(0.0)
        weight = (F.col("size") - F.col("spent")) / F.col("size") / F.greatest(1 - F.col("covered"), F.lit(1e-12))
        sums.withColumn("size", size).select("history", "size", weight.alias("weight")).write.parquet(f"{path}/histories-{level}")
        sizes = model.table(spark, "histories", level, HISTORIES).select("history", "size")
        rows.join(sizes, "history").select("gram", (F.col("left") / F.col("size")).alias("probability")).write.parquet(f"{path}/grams-{level}")
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, score) of every row by a model's tables; the score is a logarithm to base 10.

    Each distinct n-gram of the highest level is looked up once, level by level: where one is not seen, the lower
    level's probability counts, times the history's weight. Equal texts are judged once. Null and empty texts have
    one token; an empty table gives no rows; columns other than doc_id and text are not read.
    """
    spark, order = docs.sparkSession, model.order
    names = [f"g{k}" for k in range(1, order + 1)] + [f"h{k}" for k in range(2, order + 1)]
    top = f"g{order}"

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, found = _grams(batch["text"].cast(pa.binary()).to_pylist(), order)
            of = np.repeat(np.arange(len(sizes)), sizes)
            sort = np.lexsort((found[-1][1], of))
            fresh = np.r_[True, (np.diff(of[sort]) != 0) | (np.diff(found[-1][1][sort]) != 0)]
            at = sort[fresh]
            times = np.diff(np.r_[np.flatnonzero(fresh), len(sort)])
            columns = [_signed(g[at]) for _, g in found] + [_signed(h[at]) for h, _ in found[1:]]
            yield pa.record_batch([batch["text_key"].take(pa.array(of[at])), pa.array(times), *columns], ["text_key", "times", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = rows.groupBy("text_key").agg(F.first("text").alias("text"))
    asked = stored(texts.mapInArrow(ask, "text_key string, times long, " + ", ".join(f"{n} long" for n in names)), "katz-asked")
    judged, probability = asked.select(*names).distinct(), F.lit(1.0)
    for level in range(1, order + 1):
        grams = model.table(spark, "grams", level, GRAMS).select(F.col("gram").alias(f"g{level}"), F.col("probability").alias(f"p{level}"))
        judged = judged.join(grams, f"g{level}", "left")
        if level == 1:
            probability = F.coalesce("p1", F.lit(float(model.words.unknown)))
            continue
        weights = model.table(spark, "histories", level, HISTORIES).select(F.col("history").alias(f"h{level}"), F.col("weight").alias(f"w{level}"))
        judged = judged.join(weights, f"h{level}", "left")
        probability = F.coalesce(f"p{level}", F.coalesce(f"w{level}", F.lit(1.0)) * probability)
    judged = judged.select(top, F.log10(F.greatest(probability, F.lit(1e-300))).alias("each"), F.col("p1").isNotNull().cast("long").alias("known"))
    sums = [F.sum("times").alias("n_tokens"), F.sum(F.col("times") * F.col("known")).alias("n_known"), F.sum(F.col("times") * F.col("each")).alias("score")]
    scored = asked.select("text_key", "times", top).join(judged, top).groupBy("text_key").agg(*sums)
    return rows.select("doc_id", "text_key").join(scored, "text_key").drop("text_key")
