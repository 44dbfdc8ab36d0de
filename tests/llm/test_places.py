"""Places name rows alike in every job, however their files are packed."""

from pyspark.sql import functions as F

import corpus_pipeline


def test_places_do_not_depend_on_packing(spark, tmp_path):
    path = str(tmp_path / "documents")
    rows = [(i % 7, f"text {i}", "en", "s", i) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(9).write.parquet(path)
    place = lambda: {r["n_chars"]: r["row"] for r in corpus_pipeline.with_places(spark.read.parquet(path)).collect()}
    before, setting = place(), "spark.sql.files.maxPartitionBytes"
    kept = spark.conf.get(setting)
    spark.conf.set(setting, "1000")
    try:
        assert place() == before and len(set(before.values())) == 400
    finally:
        spark.conf.set(setting, kept)
    other = corpus_pipeline.with_places(spark.createDataFrame(rows[:20], "doc_id long, text string, lang string, source string, n_chars long"))
    assert other.agg(F.count_distinct("row")).first()[0] == 20


def test_one_of_each_group_stays_from_files_and_elsewhere(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "en", "s", 1), (1, words, "en", "s", 1), (2, words + " more", "en", None, 2), (3, None, "en", "s", 3), (3, None, "en", "s", 3), (None, "quite other words than these are here", "de", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "d"))
    for given in (docs, spark.read.parquet(str(tmp_path / "d"))):
        found = corpus_pipeline.near_duplicates_stage(spark, given, "").collect()
        assert sorted(str(r["doc_id"]) for r in found if r["doc_id"] not in (1, 2)) == ["3", "3", "None"] and sum(r["doc_id"] in (1, 2) for r in found) == 1
