"""The forward ledger as JSON files, read as a batch or as a stream, with a fault for every row that is not as it was written.

A file holds one document or lines of them. A file named by a digest holds the one document of that digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from tidegate.errors import LedgerError
from tidegate.operators import forward
from tidegate.sources.forward_store import PREDICTION, RECORDED, SETTLED, fields

KINDS = {"predictions": RECORDED, "settlements": SETTLED}
FAULTS = ("malformed", "unknown-key", "missing-value", "altered", "renamed")


def recorded_digest() -> Column:
    """The digest that a prediction was recorded under."""
    return forward.prediction_digest("protocol_digest", *PREDICTION, "recorded_at")


def document(kind: str, *more: Column) -> Column:
    """A row as the JSON document that a file of its kind holds: timestamps keep their microseconds."""
    return F.to_json(F.struct(*[F.col(n) for n in KINDS[kind]], *more), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})


def parsed(texts: DataFrame, kind: str) -> DataFrame:
    """The rows of `texts` (value, file_name) with the columns of their kind, `file_name` and `fault`, the first that holds or null.

    malformed: not a JSON object of the right types; unknown-key and missing-value: not exactly the declared keys, each
    with a value; altered: a prediction whose digest is not that of its contents; renamed: the file's name is another
    digest than the row's. No row is dropped, blank lines apart.
    """
    kinds = KINDS[kind]
    schema = f"{fields(kinds)}, _corrupt string"
    rows = texts.where("trim(value) <> ''").select(
        "file_name", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"), F.json_object_keys("value").alias("keys")
    )
    rows = rows.select("file_name", "keys", "r.*")
    missing = F.lit(False)
    for name in kinds:
        missing |= F.col(name).isNull()
    stem = F.regexp_extract("file_name", r"^([0-9a-f]{64})\.json$", 1)
    fault = (
        F.when(F.col("_corrupt").isNotNull() | F.col("keys").isNull(), FAULTS[0])
        .when(F.size(F.array_except("keys", F.array(*map(F.lit, kinds)))) > 0, FAULTS[1])
        .when(missing, FAULTS[2])
        .when((F.col("prediction_digest") != recorded_digest()) if kind == "predictions" else F.lit(False), FAULTS[3])
        .when((stem != "") & (stem != F.col("prediction_digest")), FAULTS[4])
    )
    return rows.withColumn("fault", fault).select(*kinds, "file_name", "fault")


def _texts(reader: DataStreamReader | object, path: str, whole: bool) -> DataFrame:
    return reader.text(path, wholetext=whole).select("value", F.col("_metadata.file_name").alias("file_name"))


def read(spark: SparkSession, path: str, kind: str, whole: bool = True) -> DataFrame:
    """`parsed` rows of a folder; `whole`: a document is a whole file, else a line."""
    return parsed(_texts(spark.read, path, whole), kind)


def stream(spark: SparkSession, path: str, kind: str, whole: bool = True, files_a_batch: int = 1000) -> DataFrame:
    """The same as a stream of the files that come into the folder."""
    return parsed(_texts(spark.readStream.option("maxFilesPerTrigger", files_a_batch), path, whole), kind)


def sound(rows: DataFrame) -> DataFrame:
    """The rows without fault and file name, or an error that names the files; repeated keys are left to the ledger's rules."""
    bad = rows.where("fault is not null").groupBy("fault", "file_name").count().orderBy("fault", "file_name").limit(20).collect()
    if bad:
        raise LedgerError("; ".join(f"{r['fault']}: {r['file_name']}" for r in bad))
    return rows.drop("fault", "file_name")


def fault_counts(rows: DataFrame) -> DataFrame:
    """(fault, rows); sound rows count as `none`."""
    return rows.groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count("*").alias("rows"))
