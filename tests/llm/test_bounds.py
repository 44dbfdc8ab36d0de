"""What the driver and a task may hold, and scores against plain NumPy."""

import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.llm import quality_model, quality_rules


@pytest.fixture(scope="module")
def long_one(spark):
    """Sixty labelled documents, one of 200,000 lines."""
    good = "The cat sat on the mat, and the dog ran off again.\nIt came back later today.\n"
    bad = "### $$$ |||\n### $$$ |||\nCLICK HERE $$$ NOW\n"
    rows = [(i, good * (1 + i % 3) if i % 2 else bad * (1 + i % 4)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionAll(spark.range(1).select(F.lit(99).cast("long"), F.repeat(F.lit(bad), 66_667)))
    return docs, spark.createDataFrame([(i, i % 2) for i in [*range(60), 99]], "doc_id long, quality int")


def test_training_holds_no_long_text(long_one):
    docs, labels = long_one
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    field = quality_rules.train_field(docs, labels, sample_values=400_000)
    model = quality_model.train(docs, labels, folds=1, fold=1, sample_values=400_000)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # kilobytes
    assert field is not None and isinstance(model, quality_model.AttentionModel)
    kept = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, field).collect()}
    assert kept[99]["n_words"] == 66_667 * 10 and not kept[99]["kept"]
    scores = {r["doc_id"]: r["score"] for r in quality_model.score(docs, model).collect()}
    assert scores[99] < 0.5 < scores[1]


def test_the_sample_stops_at_its_bound(spark):
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.array_repeat(F.lit(0.5), F.when(F.col("id") == 3, 30).otherwise(20).cast("int")).alias("bag"))
    found = quality_model.collected_sample(rows, "bag", 100, 1400)
    assert sum(len(r["bag"]) for r in found) == 1400 and {len(r["bag"]) for r in found} == {20}
    assert len(quality_model.collected_sample(rows, "bag", 7, 10**6)) == 7 and quality_model.collected_sample(rows, "bag", 7, 100) == []


def test_scores_equal_a_plain_forward_pass(spark, sf_dir, monkeypatch):
    """Each bag by itself, every sum written out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = quality_model.train(docs, labels)
    monkeypatch.setattr(quality_model, "SCORED", 7)
    p = model.weights
    texts = [r[0] for r in docs.select("text").collect()] + [None, "", " ", "word " * 5000]
    bags = [quality_model.passages(t.encode() if t else None) for t in texts]
    assert [len(b) for b in bags] == [max(1, -(-len((t or "").encode().split()) // 100)) for t in texts]
    for bag, got in zip(bags, model.scores(bags), strict=True):
        hidden, attention = [], []
        for x in bag:
            z = [min(max((x[i] - model.mean[i]) / model.scale[i], -6), 6) for i in range(len(x))]
            h = [np.tanh(sum(z[i] * p["w"][i, k] for i in range(len(z))) + p["b"][k]) for k in range(len(p["b"]))]
            gate = [np.tanh(sum(h[i] * p["v"][i, k] for i in range(len(h)))) / (1 + np.exp(-sum(h[i] * p["u"][i, k] for i in range(len(h))))) for k in range(len(p["a"]))]
            hidden.append(h)
            attention.append(np.exp(sum(g * a for g, a in zip(gate, p["a"], strict=True))))
        pooled = [sum(a * h[k] for a, h in zip(attention, hidden, strict=True)) / sum(attention) for k in range(len(p["c"]))]
        assert got == pytest.approx(1 / (1 + np.exp(-(sum(c * v for c, v in zip(p["c"], pooled, strict=True)) + p["d"][0]))), abs=1e-9)
