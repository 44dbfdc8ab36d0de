"""Stored Katz models against plain counting, at orders one to three, and against the one-pass operator."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.llm import katz, katz_tables

TRAIN = ["a b a b c", "a b d", "A B C a b c", "e", None, "", "a b a b c", "f g h a b", "b c a"]
ASKED = ["a b c", "b a b d", "z a b", "A b C", None, " \n", "q q q", "a b a b c", "d d"]


def plain(order):
    """Probability of a token after its history, by the definition, from dictionaries."""
    counts = [Counter() for _ in range(order + 1)]
    for t in TRAIN:
        w = [*(t or "").lower().split(), "\n"]
        padded = ["\t"] * order + w
        for i in range(order, len(padded)):
            for k in range(1, order + 1):
                counts[k][tuple(padded[i - k + 1 : i + 1])] += 1
    ranks = lambda c: np.array([sum(v == r for v in c.values()) for r in range(1, 7)])
    low = katz.Words.of(np.r_[sum(counts[1].values()), len(counts[1]), ranks(counts[1])])
    factors = [None, None, *[katz.discounts(ranks(counts[k])) for k in range(2, order + 1)]]
    after = defaultdict(list)
    for k in range(2, order + 1):
        for gram in counts[k]:
            after[gram[:-1]].append(gram)

    def probability(gram):
        if len(gram) == 1:
            return float(low.probability(np.array([counts[1][gram]]))[0])
        k = len(gram)
        rows = after[gram[:-1]]
        if not rows:
            return probability(gram[1:])
        n, spent = sum(counts[k][g] for g in rows), sum(factors[k][min(counts[k][g], 6)] * counts[k][g] for g in rows)
        size = n + (n - spent < 1e-9)
        if gram in counts[k]:
            return factors[k][min(counts[k][gram], 6)] * counts[k][gram] / size
        return (size - spent) / size / (1 - sum(probability(g[1:]) for g in rows)) * probability(gram[1:])

    return counts, probability


@pytest.mark.parametrize("order", [1, 2, 3])
def test_tables_give_what_the_definition_gives(spark, tmp_path, order):
    counts, probability = plain(order)
    # after any history the known words and one unknown class have probability one
    for history in [("a", "b"), ("\t", "\t"), ("z", "a"), ("z", "z")]:
        history = history[len(history) - order + 1 :] if order > 1 else ()
        assert sum(probability((*history, w)) for (w,) in [*counts[1], ("never seen",)]) == pytest.approx(1, abs=1e-9)
    katz_tables.fit(spark.createDataFrame([(t, 1) for t in TRAIN], "text string, level int"), str(tmp_path / "m"), order)
    model = katz_tables.load(spark, str(tmp_path / "m"))
    asked = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(ASKED * 2)], "doc_id int, text string, score double")
    rows = katz_tables.score(asked, model).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(2 * len(ASKED)))
    for r in rows:
        w = [*(ASKED[r["doc_id"] % len(ASKED)] or "").lower().split(), "\n"]
        padded = ["\t"] * order + w
        expected = sum(math.log10(probability(tuple(padded[i - order + 1 : i + 1]))) for i in range(order, len(padded)))
        assert r["score"] == pytest.approx(expected, abs=1e-9)
        assert (r["n_tokens"], r["n_known"]) == (len(w), sum((x,) in counts[1] for x in w))


def test_order_two_equals_the_one_pass_operator(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.col("doc_id") % 5 == 1
    model = katz_tables.fit(docs.where(~held_out), str(tmp_path / "m"))
    tables = {r["doc_id"]: r for r in katz_tables.score(docs, model).collect()}
    rows = katz.score(docs, held_out).collect()
    assert len(rows) == len(tables) and {r["train_tokens"] for r in rows} == {model.words.total}
    for r in rows:
        found = tables[r["doc_id"]]
        assert (found["n_tokens"], found["n_known"]) == (r["n_tokens"], r["n_known"]) and found["score"] == pytest.approx(r["score"], abs=1e-6)


def test_nothing_to_learn_from_or_to_score(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = katz_tables.fit(none, str(tmp_path / "m"), 3)
    assert katz_tables.score(none, model).collect() == []
    row = katz_tables.score(spark.createDataFrame([(None, "never seen")], "doc_id long, text string"), model).first()
    assert (row["doc_id"], row["n_tokens"], row["n_known"], row["score"]) == (None, 3, 0, 0.0)
    with pytest.raises(ValueError):
        katz_tables.fit(none, str(tmp_path / "n"), 0)


def test_what_was_seen_is_never_impossible():
    """Without counts of two, absolute discounting would leave nothing to what occurs once."""
    for ranks in ([4, 0, 0, 0, 0, 0], [4, 0, 3, 0, 0, 0], [1, 1, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0], [5, 4, 3, 2, 1, 1]):
        assert (katz.discounts(np.array(ranks))[1:] > 0).all() and (katz.discounts(np.array(ranks)) <= 1).all()
