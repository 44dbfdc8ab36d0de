"""Governed file scans: limits and names are checked before anything is read, and only asked columns are."""

from __future__ import annotations

import csv
import json
from collections.abc import Mapping
from dataclasses import dataclass
from hashlib import sha256
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegate.errors import LimitError, RequestError, SourceError
from tidegate.session import kept


@dataclass(frozen=True)
class Limits:
    """Ceilings of one uploaded file."""

    file_bytes: int = 512 * 2**20
    rows: int = 1_000_000
    features: int = 512
    combinations: int = 10_000
    columns: int = 2048
    uncompressed_bytes: int = 2 * 2**30
    json_bytes: int = 2**20


def json_document(source: str | Mapping[str, Any], keys: set[str], limits: Limits = Limits(), spark: SparkSession | None = None) -> Mapping[str, Any]:
    """A JSON object with exactly these keys and schema_version "1", from a path or as it is.

    With a session the path may be on any file system that Spark knows, else it is on this machine.
    """
    found: Any = source
    if isinstance(source, str):
        missing = LimitError("the document is missing or too large")
        if spark is None:
            file = Path(source)
            if not file.is_file() or file.stat().st_size > limits.json_bytes:
                raise missing
            text = file.read_bytes()
        else:
            try:
                size = _bytes(spark, source)
            except SourceError as error:
                raise missing from error
            if size > limits.json_bytes:
                raise missing
            text = bytes(spark.read.format("binaryFile").load(source).select("content").first()[0])
        try:
            found = json.loads(text.decode("utf-8"))
        except ValueError as error:
            raise RequestError("the document is not JSON") from error
    if not isinstance(found, Mapping) or set(found) != keys | {"schema_version"} or found["schema_version"] != "1":
        raise RequestError("the document's keys or version are not the declared ones")
    return found


def _named(columns: list[str], schema: StructType, limits: Limits) -> None:
    if len(columns) > limits.columns:
        raise LimitError(f"{len(columns)} columns")
    if len(set(columns)) != len(columns):
        raise SourceError("column names repeat")
    if missing := [f.name for f in schema if f.name not in columns]:
        raise SourceError(f"{len(missing)} declared columns are missing")


def _place(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """A path's file system and the path on it, for any file system that Spark knows."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        raise SourceError("no such file")
    return files, place


def _bytes(spark: SparkSession, path: str) -> int:
    """Size of a file, or of a folder of part files."""
    files, place = _place(spark, path)
    return int(files.getContentSummary(place).getLength())


def _headers(spark: SparkSession, path: str) -> list[list[str]]:
    """The distinct first lines of a CSV file or of a folder's part files, as columns."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    first = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "place").alias("header")).select("header").distinct()
    return [next(csv.reader([r[0]]), []) for r in first.limit(2).collect()]


def _uncompressed(spark: SparkSession, path: str) -> int:
    """Bytes of a Parquet file's or folder's row groups before compression, from the footers alone."""
    files, place = _place(spark, path)
    jvm, conf, total = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for status in files.listStatus(place):
        name = status.getPath().getName()
        if status.isFile() and not name.startswith(("_", ".")):
            footer = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromStatus(status, conf))
            try:
                total += sum(int(b.getTotalByteSize()) for b in footer.getRowGroups())
            finally:
                footer.close()
    return total


def _csv(spark: SparkSession, path: str, schema: StructType, limits: Limits) -> DataFrame:
    """The declared columns of a CSV file, parsed once into a table; no row beyond the limit is parsed.

    The part files of a folder must agree on names and their order: Spark reads them all by one header.
    """
    headers = _headers(spark, path) or [[]]
    if len(headers) > 1:
        raise SourceError("the files' headers differ")
    _named(headers[0], schema, limits)
    kinds = {f.name: f.dataType.simpleString() for f in schema}
    whole = ", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in headers[0])
    rows = spark.read.schema(whole).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    table = kept(rows.select(*[f"`{f.name}`" for f in schema]).limit(limits.rows + 1), "upload")
    if table.count() > limits.rows:
        raise LimitError("too many rows")
    return table


def _parquet(spark: SparkSession, path: str, schema: StructType, limits: Limits) -> DataFrame:
    """The declared columns of a Parquet file; names, sizes and row counts come from footers, before any row is read."""
    rows = spark.read.parquet(path)
    _named(rows.columns, schema, limits)
    if _uncompressed(spark, path) > limits.uncompressed_bytes or rows.count() > limits.rows:
        raise LimitError("the table is too large")
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def read_upload(spark: SparkSession, path: str, schema: StructType, limits: Limits = Limits(), with_size: bool = False) -> DataFrame | tuple[DataFrame, int]:
    """The declared columns of a CSV or Parquet file within the limits, and with `with_size` the file's bytes."""
    size, kind = _bytes(spark, path), Path(path).suffix
    if size > limits.file_bytes:
        raise LimitError("the file is too large")
    if kind not in (".csv", ".parquet"):
        raise SourceError("only .csv and .parquet files are read")
    rows = (_csv if kind == ".csv" else _parquet)(spark, path, schema, limits)
    return (rows, size) if with_size else rows


def daily_directory(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Files named X_daily.parquet as one table; the asset is X in upper case, columns a file lacks are null."""
    rows = spark.read.schema(schema).option("mergeSchema", True).parquet(pattern)
    return rows.withColumn("asset", F.upper(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_daily\.parquet$", 1)))


def trailing_window(rows: DataFrame, column: str, years: int) -> DataFrame:
    """Rows of the last years up to the latest value, both ends included."""
    last = rows.agg(F.max(column).alias("last_at"))
    # a scalar joined back: one row
    return rows.join(F.broadcast(last), (F.col(column) >= F.col("last_at") - F.make_ym_interval(F.lit(years))) & (F.col(column) <= F.col("last_at"))).drop("last_at")


def source_digest(spark: SparkSession, pattern: str) -> str:
    """SHA-256 over the files' names and contents' digests, in the order of names; contents stay on the executors."""
    files = spark.read.format("binaryFile").load(pattern).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("digest"))
    parts = files.orderBy("name", "digest").collect()  # a short row for each file
    return sha256("\n".join(f"{r[0]}:{r[1]}" for r in parts).encode()).hexdigest()
