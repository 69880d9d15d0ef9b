"""Reading posting tables and writing stage results."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skilltrend.columns import DEFAULT_COLUMNS, PostingColumns, posting_schema

FORMATS = ("parquet", "csv", "json", "orc")

# Quotes are doubled, edge blanks survive and a quoted field may hold line
# breaks: what is written is what is read back.
_CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

# By default text files lose the microseconds.
_TIME_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _check_format(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Return ``df``, or raise and name every column it lacks."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    required: Iterable[str] = (),
    multiline: bool = False,
) -> DataFrame:
    """Read one folder or several files with an explicit schema.

    CSV files are split between tasks. Where fields hold line breaks, as HTML
    scopes do, ``multiline=True`` reads them right, but a file then goes to one
    task whatever its size: such tables belong in Parquet.
    """
    _check_format(fmt)
    if schema is None and fmt in ("csv", "json"):
        raise ValueError(f"{fmt} needs a schema: inferring one reads the data twice")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.options(**_CSV_OPTIONS).option("multiLine", multiline)
        # An empty field is null and a quoted empty one is '': so null needs a
        # mark of its own, one that no text holds.
        reader = reader.option("nullValue", "\ufdd1")
        # A bad field must stop the run, as a bad cell does elsewhere.
        reader = reader.option("mode", "FAILFAST")
    return require_columns(reader.load(path if isinstance(path, str) else list(path)), required)


def read_postings(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "parquet",
    cols: PostingColumns = DEFAULT_COLUMNS,
    multiline: bool = False,
) -> DataFrame:
    """Scan the raw postings table.

    Text formats get the fixed string schema. Self-describing formats keep
    their own types, so a real date column stays a date.
    """
    schema = posting_schema(cols) if fmt in ("csv", "json") else None
    return read_table(spark, path, fmt, schema, posting_schema(cols).names, multiline)


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
) -> None:
    """Write a stage result; ``partition_by`` gives one folder per value."""
    _check_format(fmt)
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.options(**_CSV_OPTIONS)
    if fmt in ("csv", "json"):
        writer = writer.options(**_TIME_OPTIONS)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def rename_if_missing(df: DataFrame, source: str, target: str) -> DataFrame:
    """Rename ``source`` to ``target`` unless ``target`` is there already."""
    return df if target in df.columns else df.withColumnRenamed(source, target)


def to_local(df: DataFrame, max_rows: int):
    """At most ``max_rows`` rows as a pandas frame for display."""
    return df.limit(max_rows).toPandas()
