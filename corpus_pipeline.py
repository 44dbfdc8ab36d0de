"""A training-data pipeline over `documents`: rules, near duplicates, personal data, mixing, packing.

Every stage reads only COLUMNS, whatever others a table has, and all but the last return them. Every stage gives an
empty table for an empty one, treats a null text as its docstring says, and takes texts of any length whole.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import encoding, jaccard, mixing, packing, pii, quality_rules
from tidegate.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the rules or the share of content lines reject.

    Null and empty texts have fewer than ten words, so they go. Repeated rows are judged alike and stay or go together;
    a share of exactly half stays. Without labels of both kinds the plain rules decide alone.
    """
    field = quality_rules.train_field(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs.select(*COLUMNS), field).where("kept").select(*COLUMNS)


def with_places(docs: DataFrame) -> DataFrame:
    """COLUMNS and `row`, a number of its own for each row that stays the same in every job.

    Rows of a file are numbered by a 64-bit hash of its path and their place in it, however Spark packs files into
    partitions. Rows that come from elsewhere are written down once with their numbers.
    """
    try:
        rows = docs.select(*COLUMNS, F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:  # not a scan of files
        return stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "pipeline-rows")
    place = F.col("file").cast("decimal(20,0)") * F.lit(1 << 40).cast("decimal(13,0)") + F.col("place").cast("decimal(13,0)")
    return rows.select(*COLUMNS, place.cast("decimal(38,0)").alias("row"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group that five-word shingles link at 0.8 or more; rows without words all stay.

    Rows are told apart by their place in the table, so null and repeated ids lose nothing.
    """
    rows = with_places(docs)
    found = jaccard.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), words=5, part=80, whole=100)
    first = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("row"))
    return rows.join(first, "row", "left_semi").select(*COLUMNS)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; n_chars follows the text, and is null for a null text.

    Every row stays, repeated ones as often as they occur; of spans that overlap the first one's kind is written.
    """
    return pii.masked(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents as often as the mix takes them: a row for each copy, none for those left out.

    Null sources are one source. Null and empty texts weigh nothing and are taken once at most; rows that repeat both
    id and text are taken together.
    """
    return mixing.mixed_copies(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; one row for each piece of a document, as packing.PACKED.

    A null or empty text is one piece of one token, and a copy is packed as often as the mix took it.
    """
    return packing.pack_documents(docs, encoding.vocabulary(), capacity=2048)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("personal data", personal_data_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Tokenization, line labelling and masking are not expressible in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's table lies in the shared folder, and the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
