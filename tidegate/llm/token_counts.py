"""Exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import stored
from tidegate.llm.encoding import encoder

#: Lengths that share a block; suffix sums run inside blocks and over the blocks' totals.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row (n_tokens) per document; a null or empty text has 0 tokens.

    Texts of any length are encoded whole, repeated rows each give a row, an empty table gives none, and columns beside
    text are ignored, whatever their names.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(ids_of(t.as_py())) for t in batch.column(0)], pa.int64())], ["n_tokens"])

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "n_tokens long")


def length_histogram(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(n_tokens, n_docs): exact, combined before the shuffle, so no length is hot. Kept as a table, as it is read often."""
    return stored(encoded_lengths(docs, vocabulary).groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each occurring length, taken as a context limit, the totals of the documents up to and above it.

    Columns: n_tokens, n_docs, docs_at_least, tokens_at_least, docs_up_to, total_docs, total_tokens,
    truncated_total (tokens left when every document is cut at this length) and quantile (share of documents
    of at most this length). An empty histogram gives no rows.
    """
    blocks = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK).cast("long"))
    # a few rows: one for each BLOCK lengths up to the longest document
    totals = blocks.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("b_tokens"))
    later = totals.groupBy().agg(F.collect_list(F.struct("block", "b_docs", "b_tokens")).alias("all_blocks"))
    pick = lambda part, keep: F.aggregate(F.filter("all_blocks", keep), F.lit(0).cast("long"), lambda s, x: s + x[part])
    above = totals.join(F.broadcast(later)).select(
        "block",
        pick("b_docs", lambda x: x["block"] > F.col("block")).alias("docs_above"),
        pick("b_tokens", lambda x: x["block"] > F.col("block")).alias("tokens_above"),
        pick("b_docs", lambda x: F.lit(True)).alias("total_docs"),
        pick("b_tokens", lambda x: F.lit(True)).alias("total_tokens"),
    )
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    return (
        blocks.join(above, "block")
        .withColumn("docs_at_least", F.sum("n_docs").over(own) + F.col("docs_above"))
        .withColumn("tokens_at_least", F.sum(F.col("n_docs") * F.col("n_tokens")).over(own) + F.col("tokens_above"))
        .withColumn("docs_up_to", F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs"))
        .select(
            "n_tokens",
            "n_docs",
            "docs_at_least",
            "tokens_at_least",
            "docs_up_to",
            "total_docs",
            "total_tokens",
            (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
            (F.col("docs_up_to") / F.col("total_docs")).alias("quantile"),
        )
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, total): tokens left when documents are cut at each limit, read off the suffix sums."""
    at = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    first = sums.join(F.broadcast(at), F.col("n_tokens") >= F.col("context_limit"), "right").groupBy("context_limit").agg(
        F.min_by(F.struct("docs_at_least", "tokens_at_least", "total_tokens"), "n_tokens").alias("s")
    )
    whole = sums.groupBy().agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("all_tokens"))
    return first.join(F.broadcast(whole)).select(
        "context_limit",
        F.when(F.col("s").isNull() | F.col("s.total_tokens").isNull(), F.col("all_tokens"))
        .otherwise(F.col("s.total_tokens") - F.col("s.tokens_at_least") + F.col("context_limit") * F.col("s.docs_at_least"))
        .alias("total"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents does not exceed."""
    at = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return sums.join(F.broadcast(at), F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
