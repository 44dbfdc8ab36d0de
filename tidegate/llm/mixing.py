"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; the running sum finds, for each source, the bucket that its
budget ends in, and only rows of that bucket are summed again, by their next hash digits. A document is then
taken by comparing its hash with its source's threshold: nothing is sorted, and larger budgets take supersets.
The document at the boundary is taken where that leaves the total nearer to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import WORD, stored

#: Hexadecimal digits of a document's hash that one histogram resolves, and how often it is refined.
DIGITS, LEVELS = 3, 4


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source, source_size, target) of each source in `sizes` (source, source_size).

    Sources by code point, null last, weigh `weights`, repeating. Targets share all sizes by weight, stop at
    `most` times their source's size, and the excess is reshared by weight until none is above: in the order
    of size per weight, the sources that stop are a prefix, which running sums find.
    """
    # one row for each source, so windows over all of them are small
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    )
    rise = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", level)
        .withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("share", F.min(F.when(~F.col("stops"), F.col("level"))).over(everything))
        .withColumn("first_free", F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level")))).over(everything))
        .select(
            "source",
            "source_size",
            F.when(F.col("stops"), F.col("cap")).otherwise(F.col("first_free.level") * F.col("weight")).alias("target"),
        )
    )


def _measures() -> dict[str, Column]:
    whole = F.concat_ws("\n", F.col("doc_id").cast("string"), F.col("text").cast("string"))
    return {"size": word_count("text"), "digits": F.substring(F.md5(whole), 1, DIGITS * LEVELS)}


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, digits) of each row; `digits` is the hash of doc_id and text that rows are taken by."""
    return docs.select("doc_id", "source", *[c.alias(n) for n, c in _measures().items()])


def budgets(rows: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """(source, source_size, target, whole, threshold) of each source in `rows` (source, size, digits).

    A target of t times the source's size takes each of its documents floor(t) times (`whole`) and, once more,
    those whose hash digits are below the source's threshold. Behind the last boundary bucket the threshold ends in
    "g", which is above any digit, so that the bucket is taken, too, where more than half of it fits.
    """
    by_first = rows.groupBy("source", F.coalesce(F.substring("digits", 1, DIGITS), F.lit("")).alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    by_first = stored(by_first, "mix-histogram")  # at most 16 ** DIGITS rows for each source
    goal = targets(by_first.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most)
    budget = stored(
        goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("threshold", F.lit("")),
        "mix-budget",
    )
    histogram = by_first
    for level in range(1, LEVELS + 1):
        if level > 1:
            # rows of each source's boundary bucket alone
            edge = budget.select(F.col("source").alias("e_source"), F.col("threshold").alias("e_threshold"))
            inside = rows.join(edge, _same("source", "e_source") & (F.substring("digits", 1, DIGITS * (level - 1)) == F.col("e_threshold")), "left_semi")
            histogram = inside.groupBy("source", F.substring("digits", 1 + DIGITS * (level - 1), DIGITS).alias("bucket")).agg(F.sum("size").alias("bucket_size"))
        running = histogram.withColumn("upto", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket"))).select(
            F.col("source").alias("h_source"), "bucket", "bucket_size", "upto"
        )
        # the first bucket that the rest of the budget does not cover; the rest shrinks by what stands before it
        reached = (
            budget.join(running, _same("source", "h_source"), "left")
            .groupBy("source", "source_size", "target", "whole", "left", "threshold")
            .agg(F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", (F.col("upto") - F.col("bucket_size")).alias("before"), "bucket_size"))).alias("b"))
        )
        nearer = F.col("b.bucket_size") < 2 * (F.col("left") - F.col("b.before"))
        after = F.when(nearer, "g").otherwise("") if level == LEVELS else F.lit("")
        budget = stored(
            reached.select(
                "source",
                "source_size",
                "target",
                "whole",
                (F.col("left") - F.coalesce("b.before", F.lit(0))).alias("left"),
                F.concat("threshold", F.coalesce("b.bucket", F.lit("g" * DIGITS if level == 1 else "")), after).alias("threshold"),
            ),
            "mix-budget",
        )
    return budget.drop("left")


def take(rows: DataFrame, budget: DataFrame, most: float = 3.0) -> DataFrame:
    """`rows` (with source, size, digits) and source_size, target, copies (how often the row is taken) and taken (copies * size).

    Null sources are one source. Rows hash by doc_id and text, a null doc_id by its text alone; rows that repeat both
    are taken together. Null and empty texts have size 0 and are taken once at most; texts of any length count whole.
    An empty table gives no rows. Columns of `rows` named like a result are not expected here: `mix_documents` and
    `mixed_copies` keep a table's other columns apart.
    """
    cutoff = budget.withColumnRenamed("source", "b_source")
    copies = F.col("whole") + F.when(F.coalesce("digits", F.lit("")) < F.col("threshold"), 1).otherwise(0)
    return (
        rows.join(cutoff, _same("source", "b_source"))
        .withColumn("copies", F.least(copies, F.when(F.col("size") > 0, int(most)).otherwise(1)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("b_source", "whole", "threshold")
    )


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """`take` for a table of documents, without their texts; sizes are counted once and kept in a narrow table."""
    rows = stored(sized(docs), "mix-sizes")
    return take(rows, budgets(rows, weights, most), most)


def mixed_copies(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """Rows of `docs` as often as the mix takes them, with their columns; texts are read once more, not shuffled."""
    budget = budgets(stored(sized(docs), "mix-sizes"), weights, most)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # kept apart from names like the measures'
    rows = docs.select(whole, F.col("source").alias("source"), *[c.alias(n) for n, c in _measures().items()])
    chosen = take(rows, budget, most).where(F.col("copies") > 0)
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
