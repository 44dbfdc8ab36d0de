"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from tidegate.llm import encoding, jaccard, katz, mixing, packing, pii, quality_model, quality_rules, substrings, token_counts, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, part long, `class` long, chunk int"
TEXTS = [(1, "the cat sat on the mat and the dog ran off again today"), (2, None), (3, ""), (4, " \n\t "), (None, "null id text"), (5, "word " * 4000), (6, "x" * 30000), (1, "the cat sat on the mat and the dog ran off again today"), (7, "É è <|endoftext|> ünï +1 (743) 555-3824 a@b.de")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i == 3 else f"s{(i or 0) % 3}", 0, 9, True, 1, 2, 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def runs(labels):
    vocabulary = encoding.vocabulary()
    return {
        "packing": lambda d: packing.pack_documents(d, vocabulary),
        "quality": lambda d: quality_model.score(d, quality_model.train(d, labels)),
        "jaccard": lambda d: jaccard.near_duplicates(d),
        "pii": pii.detect,
        "mixing": mixing.mix_documents,
        "copies": mixing.mixed_copies,
        "substrings": lambda d: substrings.deduplicate(d, 5),
        "katz": lambda d: katz.score(d, quality_model.held_out("doc_id", 5, 1)),
        "rules": lambda d: quality_rules.apply_rules(d, quality_rules.train_field(d, labels)),
        "counts": lambda d: token_counts.suffix_sums(token_counts.length_histogram(d, vocabulary)),
    }


PER_ROW = {"quality", "jaccard", "pii", "mixing", "substrings", "katz", "rules"}


@pytest.mark.parametrize("name", ["packing", "quality", "jaccard", "pii", "mixing", "copies", "substrings", "katz", "rules", "counts"])
def test_edge_rows_and_empty_table(docs, labels, name):
    run = runs(labels)[name]
    found = run(docs).collect()
    if name in PER_ROW:
        assert len(found) == len(TEXTS)
        assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in TEXTS)
    assert run(docs.limit(0)).collect() == []


def test_topk_edges(spark):
    rows = [(0, [0.5, -0.5]), (1, None), (2, [float("nan"), 1.0]), (3, [1.0, None]), (4, [0.5, -0.5]), (5, [float("inf"), 0.0]), (20, [1.0, 1.0]), (None, [1.0, 1.0]), (7, []), (8, [0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    usable = topk.integer_vectors(vectors, "vec_id", "embedding", 64)
    found = [tuple(r) for r in topk.top_k(usable, F.col("vec_id") % 20 == 0, 3).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 4, 2048), (0, 2, 8, 1024), (0, 3, 7, 0), (20, 1, 8, 2048), (20, 2, 0, 0), (20, 3, 4, 0)]
    twice = usable.where("vec_id in (0, 4, 20)").unionAll(usable.where("vec_id = 0"))
    found = sorted(tuple(r) for r in topk.top_k(twice, F.col("vec_id") % 20 == 0, 2).collect())
    assert found == [(0, 1, 0, 2048), (0, 1, 0, 2048), (0, 2, 4, 2048), (0, 2, 4, 2048), (20, 1, 0, 0), (20, 2, 0, 0)]
    assert topk.top_k(usable.limit(0), F.col("vec_id") % 20 == 0, 3).collect() == []
    assert topk.top_k(usable, F.col("vec_id") == 99, 3).collect() == []


def test_pipeline_masks_and_keeps_null(docs):
    texts = {r["doc_id"]: r["text"] for r in pii.masked(docs).collect()}
    assert texts[2] is None and "[PHONE]" in texts[7] and "[EMAIL]" in texts[7]
