"""What each operator says about nulls, empty and long texts, ties, repeated rows and clashing columns."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.llm import encoding, jaccard, katz, mixing, packing, pii, quality_model, quality_rules, substrings, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, part long, `class` long, chunk int, copies long, score double, spans string, length long, row int"
TWELVE = "the cat sat on the mat and the dog ran off again"
TEXTS = [(1, TWELVE), (2, None), (3, ""), (4, " \n\t "), (None, "null id text"), (5, "word " * 4000), (6, "x" * 30000), (1, TWELVE), (8, TWELVE.upper())]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i in (3, 6) else f"s{(i or 0) % 3}", 0, 9, True, 1, 2, 3, 4, 0.5, "x", 7, 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(rows, *names):
    return sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in rows)


def test_packing(docs):
    rows = packing.pack_documents(docs, encoding.vocabulary()).collect()
    end = zlib.crc32(np.zeros(1, "<u4").tobytes())
    assert [(r["doc_id"], r["length"], r["ids_crc32"]) for r in sorted(rows, key=lambda r: r["doc_id"] or 0) if r["doc_id"] in (2, 3)] == [(2, 1, end), (3, 1, end)]
    assert sum(r["doc_id"] == 1 for r in rows) == 2 and {r["piece"] for r in rows if r["doc_id"] == 5} == {0, 1} and sum(r["length"] for r in rows if r["doc_id"] == 5) == 4002


def test_token_counts(docs):
    found = {r["n_tokens"]: r for r in token_counts.suffix_sums(token_counts.length_histogram(docs, encoding.vocabulary())).collect()}
    assert found[0]["n_docs"] == 2 and found[0]["total_docs"] == 9 and found[4001]["docs_at_least"] == 1 and sum(r["n_docs"] for r in found.values()) == 9


def test_jaccard(docs):
    found = by_id(jaccard.near_duplicates(docs, words=3, part=90).collect(), "n_shingles", "component_id")
    assert found == [("1", 10, 1), ("1", 10, 1), ("2", 0, 2), ("3", 0, 3), ("4", 0, 4), ("5", 1, 5), ("6", 1, 6), ("8", 10, 1), ("None", 1, None)]


def test_substrings(docs):
    found = by_id(substrings.deduplicate(docs, 5).collect(), "n_words", "n_removed")
    assert found == [("1", 12, 12), ("1", 12, 12), ("2", 0, 0), ("3", 0, 0), ("4", 0, 0), ("5", 4000, 4000), ("6", 1, 0), ("8", 12, 0), ("None", 3, 0)]


def test_rules(docs):
    found = by_id(quality_rules.apply_rules(docs, None).collect(), "n_words", "n_repeat_words", "base_failed", "kept")
    assert found == [
        ("1", 12, 0, False, True), ("1", 12, 0, False, True), ("2", 0, 0, True, False), ("3", 0, 0, True, False), ("4", 0, 0, True, False), ("5", 4000, 4000, True, False), ("6", 1, 0, True, False),
        ("8", 12, 0, False, True), ("None", 3, 0, True, False),
    ]


def test_katz(docs):
    rows = katz.score(docs, F.col("doc_id") == 8).collect()
    assert by_id(rows, "held_out", "n_tokens", "n_known")[:3] == [("1", False, 13, 13), ("1", False, 13, 13), ("2", False, 1, 1)]
    assert by_id(rows, "held_out", "n_tokens", "n_known")[-2:] == [("8", True, 13, 13), ("None", False, 4, 4)]
    assert {r["train_tokens"] for r in rows} == {13 + 1 + 1 + 1 + 4 + 4001 + 2 + 13}
    assert len({round(r["score"], 9) for r in rows if r["doc_id"] in (1, 8)}) == 1 and len({r["score"] for r in rows if r["doc_id"] in (2, 3, 4)}) == 1


def test_personal_data(docs):
    assert by_id(pii.detect(docs).collect(), "spans", "n_added") == sorted((str(i), "", 0) for i, _ in TEXTS)


def test_scores(docs):
    rows = quality_model.score(docs, 0.25).collect()
    assert by_id(rows, "score", "n_passages") == sorted((str(i), 0.25, 40 if i == 5 else 1) for i, _ in TEXTS)


def test_mixing(docs):
    rows = mixing.mix_documents(docs).collect()
    assert by_id(rows, "size") == sorted((str(i), len((t or "").split())) for i, t in TEXTS)
    whole = {r["source"]: r["source_size"] for r in rows}
    assert whole == {"s0": 3, "s1": 24, "s2": 4012, None: 1}
    assert all(r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3 for r in rows)
    copies = mixing.mixed_copies(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r["copies"] for r in rows)


def test_the_boundary_document_goes_where_it_is_nearer(spark):
    """Weights 5 and 2 of 100 + 60 words: targets of 114.3 and 45.7, so b's one document of 60 is nearer than none."""
    docs = spark.createDataFrame([(1, "w " * 100, "a"), (2, "w " * 60, "b"), (None, "v " * 7, "c"), (None, "u " * 7, "c")], "doc_id long, text string, source string")
    rows = {(r["source"], r["doc_id"]): r for r in mixing.mix_documents(docs.where("source <> 'c'")).collect()}
    assert rows["a", 1]["taken"] == 100 and rows["b", 2]["taken"] == 60
    nulls = [r["taken"] for r in mixing.mix_documents(docs, weights=(100.0, 100.0, 6.0)).collect() if r["source"] == "c"]
    assert sorted(nulls) == [0, 7]  # a target of 5: rows without an id are told apart by their texts


def test_empty_pipeline(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_on_edge_rows(spark, docs, tmp_path):
    """Only texts of ten words that do not repeat themselves are left, one of each group; clashing columns are not carried."""
    import corpus_pipeline

    clean = TWELVE + ", as it had done every morning before; nobody minded much."
    rows = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(20).cast("long"), "text": F.lit(clean), "source": F.lit("s1")}))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in found} == {1, 20} and set(found[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
