"""Dataset locations to DataFrames.

A location is ``scheme://rest``: local files, object-store keys, catalog
tables, queries and partitioned directories. Only metadata and, for delimited
text, a file listing are touched on the driver; the rows stay distributed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.sources.delimited import read_delimited

LOCAL = "local"
S3 = "s3"
TABLE = "table"
QUERY = "query"
PARTITION = "partition"
KINDS = (LOCAL, S3, TABLE, QUERY, PARTITION)

OBJECT_STORE_PREFIX = "s3a://"

# A file system that Spark does not know surfaces as a bare Java error.
READ_ERRORS = (PySparkException, Py4JJavaError)


@dataclass(frozen=True)
class SourceRef:
    uri: str
    kind: str
    path: str


@dataclass(frozen=True)
class Resolved:
    """A dataset ready to be checked, or the reason why it cannot be read."""

    uri: str
    frame: DataFrame | None = None
    columns: tuple[str, ...] = ()
    partition_columns: tuple[str, ...] = ()
    row_number: Column | None = None
    # The rows of one text file with block and row ids: row numbers follow from the blocks' counts.
    placed: DataFrame | None = None
    error: str | None = None

    @property
    def readable(self) -> bool:
        return self.error is None

    @property
    def column_count(self) -> int:
        return len(self.columns)


def parse_uri(uri: str) -> SourceRef:
    """Bare paths and unknown schemes are local; the latter keep the whole text as path."""
    scheme, sep, rest = uri.partition("://")
    if not sep:
        return SourceRef(f"{LOCAL}://{uri}", LOCAL, uri)
    if scheme not in KINDS:
        return SourceRef(uri, LOCAL, uri)
    return SourceRef(uri, scheme, rest)


def from_frame(frame: DataFrame, uri: str = "frame://", row_number: Column | None = None) -> Resolved:
    """Wrap a DataFrame that is already at hand."""
    return Resolved(uri, frame, tuple(frame.columns), (), row_number)


def resolve(
    spark: SparkSession,
    uri: str,
    *,
    object_store: str = OBJECT_STORE_PREFIX,
    multi_line: bool | None = None,
) -> Resolved:
    """Find the dataset behind a location.

    ``multi_line`` says whether quoted fields of delimited text may contain
    line breaks. Left at None it is found out by the scan that reads the files'
    first lines, so that clean text stays splittable.
    """
    ref = parse_uri(uri)
    if ref.kind == TABLE:
        return _from_catalog(spark, ref)
    if ref.kind == QUERY:
        return _from_query(spark, ref)
    if ref.kind == PARTITION:
        return _from_partitions(spark, ref, object_store, multi_line)
    if ref.kind == S3:
        bucket, sep, key = ref.path.partition("/")
        if not (bucket and sep and key):
            return Resolved(ref.uri, error=f"Invalid S3 path: {ref.path}")
        return _from_file(spark, ref, object_store + ref.path, multi_line)
    return _from_file(spark, ref, ref.path, multi_line)


def profile(resolved: Resolved) -> DataFrame:
    """One row: location, columns, row and column counts."""
    return resolved.frame.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(resolved.uri).alias("source_uri"),
        F.array(*[F.lit(c) for c in resolved.columns]).alias("columns"),
        "row_count",
        F.lit(resolved.column_count).alias("column_count"),
    )


def reason_of(exc: Exception) -> str:
    text = exc.java_exception.toString() if isinstance(exc, Py4JJavaError) else str(exc)
    return text.splitlines()[0]


def root_cause(exc: Exception) -> str:
    """First line of the innermost cause of a failed scan, not of what it was wrapped in."""
    cause = exc.java_exception if isinstance(exc, Py4JJavaError) else getattr(exc, "_origin", None)
    if cause is None:
        return reason_of(exc)
    while cause.getCause() is not None:
        cause = cause.getCause()
    return (cause.getMessage() or cause.toString()).splitlines()[0]


def _from_catalog(spark: SparkSession, ref: SourceRef) -> Resolved:
    try:
        frame = spark.table(ref.path)
        return Resolved(ref.uri, frame, tuple(frame.columns))
    except READ_ERRORS as exc:
        return Resolved(ref.uri, error=f"Failed to query table: {reason_of(exc)}")


def _from_query(spark: SparkSession, ref: SourceRef) -> Resolved:
    try:
        frame = spark.sql(ref.path)
        return Resolved(ref.uri, frame, tuple(frame.columns))
    except READ_ERRORS as exc:
        return Resolved(ref.uri, error=f"Failed to execute query: {reason_of(exc)}")


def _listing(spark: SparkSession, path: str) -> DataFrame:
    # File paths and lengths only: the content column is pruned away.
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length")
    )


def _from_file(spark: SparkSession, ref: SourceRef, path: str, multi_line: bool | None) -> Resolved:
    empty = "S3 object is empty" if ref.kind == S3 else "File is empty"
    if not path.rstrip("/").endswith(".parquet"):
        return _from_text_file(spark, ref, path, multi_line, empty)
    try:
        frame = spark.read.parquet(path)
        # One row tells whether there are any, and which file they come from.
        peek = frame.select("_metadata.file_path").first() if frame.columns else None
        if peek is None:
            return Resolved(ref.uri, error=empty)
        files = frame.inputFiles()
    except READ_ERRORS as exc:
        return _failure(ref, exc, "file")
    # The position inside the file is only a row number of the dataset when there is one file.
    one_file = len(files) == 1 and _same_path(files[0], path)
    return Resolved(ref.uri, frame, tuple(frame.columns), (), F.col("_metadata.row_index") + 1 if one_file else None)


def _from_text_file(spark: SparkSession, ref: SourceRef, path: str, multi_line: bool | None, empty: str) -> Resolved:
    try:
        text = read_delimited(spark, path, multi_line=multi_line)
    except READ_ERRORS as exc:
        return _failure(ref, exc, "file")
    if any(not _same_path(f, path) for f in text.files):
        return Resolved(ref.uri, error=f"Not a file: {ref.path}")
    if text.error:
        return Resolved(ref.uri, error=f"Failed to read file: {text.error}")
    if text.frame is None:
        return Resolved(ref.uri, error=empty)
    row_number = None if text.placed is not None else F.monotonically_increasing_id() + 1
    return Resolved(ref.uri, text.frame, text.columns, (), row_number, text.placed)


def _failure(ref: SourceRef, exc: Exception, what: str) -> Resolved:
    if _condition(exc) == "PATH_NOT_FOUND":
        return Resolved(ref.uri, error=f"File not found: {ref.path}")
    return Resolved(ref.uri, error=f"Failed to read {what}: {reason_of(exc)}")


def _condition(exc: Exception) -> str | None:
    return exc.getCondition() if isinstance(exc, AnalysisException) else None


def _same_path(listed: str, path: str) -> bool:
    """Whether a listed file is the path itself and not something below it."""

    def bare(p: str) -> str:
        return "/" + re.sub(r"^[a-z0-9]+:/+", "", p).lstrip("/")

    return bare(unquote(listed)).endswith(bare(path).rstrip("/"))


def _from_partitions(
    spark: SparkSession, ref: SourceRef, object_store: str, multi_line: bool | None
) -> Resolved:
    inner = parse_uri(ref.path)
    path = object_store + inner.path if inner.kind == S3 else inner.path
    # The dataset starts above the first key=value folder of the path.
    head = re.split(r"/(?=[^/=]+=[^/]*(?:/|$))", path.rstrip("/"), maxsplit=1)[0]
    try:
        # All files have their say: two numbers for each kind of file.
        ends = F.when(F.col("path").endswith(".parquet"), "parquet").otherwise("text").alias("kind")
        kinds = {r["kind"] for r in _listing(spark, path).select(ends).distinct().collect()}
        if not kinds:
            return Resolved(ref.uri, error=f"No files below: {ref.path}")
        if len(kinds) > 1:
            return Resolved(ref.uri, error="Failed to read partitions: Parquet and text files are mixed")
        if kinds == {"parquet"}:
            # Columns of any partition are columns of the dataset.
            frame = spark.read.option("basePath", head).option("mergeSchema", "true").parquet(path)
            flat = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(path)
            data = tuple(c for c in frame.columns if c in flat.columns)
        else:
            text = read_delimited(spark, path, base=head, multi_line=multi_line)
            if text.error:
                return Resolved(ref.uri, error=f"Failed to read partitions: {text.error}")
            frame, data = text.frame, text.columns
        if frame is None or frame.isEmpty():
            return Resolved(ref.uri, error="Partitioned dataset is empty")
    except READ_ERRORS as exc:
        return _failure(ref, exc, "partitions")
    keys = tuple(c for c in frame.columns if c not in data)
    return Resolved(ref.uri, frame, data, keys)
