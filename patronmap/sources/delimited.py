"""Delimited text: separator detection, scan and export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronmap.operators.cleaning import coerce
from patronmap.operators.date_formats import coerce_column
from patronmap.sources.mapping import ColumnMapping, map_columns
from patronmap.sources.quoted import scan_quoted

# Separators that are tried, preferred first among equals.
SEPARATORS = (",", ";", "\t", "|")
QUOTED_TEXT = r'"[^"]*"'

TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def separator_profile(spark: SparkSession, path: str) -> DataFrame:
    """Per separator: lines, the most common number of fields, and how many lines have it.

    Reads every line. Lines are counted by (separator, fields) before anything is
    shuffled, so what moves is bounded by the distinct field counts.
    """
    quoted = F.regexp_replace("value", QUOTED_TEXT, "")
    bare = F.when(F.contains("value", F.lit('"')), quoted).otherwise(F.col("value"))
    # Its own step, so that quoted text is removed once per line and not once per separator.
    lines = spark.read.text(path).where(F.length("value") > 0).select(bare.alias("bare"))
    kept = F.length("bare")
    found = [
        F.struct(
            F.lit(i).alias("preference"),
            F.lit(s).alias("separator"),
            (kept - F.length(F.replace("bare", F.lit(s), F.lit(""))) + 1).alias("fields"),
        )
        for i, s in enumerate(SEPARATORS)
    ]
    per_count = (
        lines.select(F.inline(F.array(*found)))
        .groupBy("preference", "separator", "fields")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    most_common = F.max(F.struct("n", "fields")).alias("top")
    return (
        per_count.groupBy("preference", "separator")
        .agg(F.sum("n").alias("lines"), most_common)
        .select("preference", "separator", "lines", F.col("top.fields").alias("fields"),
                F.col("top.n").alias("agreeing"))
    )


def best_separator(spark: SparkSession, path: str) -> DataFrame:
    """The separator on whose field count most lines agree; more fields win a tie."""
    return (
        separator_profile(spark, path)
        .where(F.col("fields") > 1)
        .orderBy(F.desc("agreeing"), F.desc("fields"), "preference")
        .limit(1)
    )


def detect_separator(spark: SparkSession, path: str) -> str:
    best = best_separator(spark, path).first()
    if best is None:
        raise ValueError(f"no separator found in {path}")
    return best["separator"]


def scan_delimited(
    spark: SparkSession, path: str, sep: str | None = None, multi_line: bool | None = None
) -> DataFrame:
    """All columns as text; nothing is inferred, so the data is not read twice for types.

    Quoted text may hold line breaks. By default a pass over the files finds out whether any
    does; such files are put together by `quoted`, by many tasks. With `multi_line=False` that
    pass is left out and every line is a record.
    """
    sep = sep or detect_separator(spark, path)
    options = {"sep": sep, "quote": '"', "escape": '"'}
    if multi_line is not False:
        found = scan_quoted(spark, path, sep, options)
        if found is not None:
            return found
    return spark.read.csv(path, header=True, **options)


def read_transactions(
    spark: SparkSession,
    path: str,
    mapping: ColumnMapping,
    sep: str | None = None,
    formats: Sequence[str] | None = (),
    multi_line: bool | None = None,
) -> DataFrame:
    """Delimited file as standard transactions; unreadable dates and amounts are null.

    With `formats=None` the date column's format is found by a pass over it.
    """
    mapped = map_columns(scan_delimited(spark, path, sep, multi_line), mapping)
    return coerce_column(mapped) if formats is None else coerce(mapped, formats)


def _one_line(df: DataFrame) -> DataFrame:
    """Text that holds a line break ends the job."""
    message = F.lit("text with a line break: write and read it with multi_line=True")
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    quoted = {name: F.col("`" + name.replace("`", "``") + "`") for name in texts}
    return df.withColumns(
        {
            name: F.when(column.contains("\n") | column.contains("\r"), F.raise_error(message)).otherwise(column)
            for name, column in quoted.items()
        }
    )


def write_delimited(
    df: DataFrame, path: str, sep: str = ",", header: bool = True, multi_line: bool = False
) -> None:
    """Export as text, one file per partition; nulls are empty, quotes are doubled.

    Text is written as it is, white space included. Line breaks in text need `multi_line`,
    here and when the files are read.
    """
    (df if multi_line else _one_line(df)).write.csv(
        path,
        sep=sep,
        header=header,
        quote='"',
        escape='"',
        nullValue="",
        emptyValue='""',
        timestampFormat=TIMESTAMP_TEXT,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
