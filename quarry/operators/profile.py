"""Profiles of tables: types, counts and numeric statistics of all columns in one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formats that count as dates.
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
BOOLEANS = ["true", "false", "yes", "no", "1", "0", "t", "f", "y", "n"]


def stacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value) rows, values as strings."""
    parts = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    return df.select(F.expr(f"stack({len(columns)}, {parts}) as (column_name, value)"))


def column_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return stacked(df, columns).groupBy("column_name").agg(
        F.count("value").alias("non_null"), F.count_if(F.col("value").isNull()).alias("nulls"), F.countDistinct("value").alias("distinct_values")
    )


def column_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """The type that all of a column's values have."""
    value = F.col("value")
    rows = stacked(df, columns).groupBy("column_name").agg(
        F.count("value").alias("n"),
        F.coalesce(F.bool_and(value.try_cast("double").isNotNull() | value.isNull()), F.lit(False)).alias("numeric"),
        F.coalesce(F.bool_and(value.rlike("^[01]$") | value.isNull()), F.lit(False)).alias("binary"),
        F.coalesce(F.bool_and(value.rlike(DATE_PATTERN) | value.isNull()), F.lit(False)).alias("dates"),
        F.coalesce(F.bool_and(F.lower(value).isin(BOOLEANS) | value.isNull()), F.lit(False)).alias("truth"),
    )
    kind = F.when(F.col("n") == 0, "unknown").when(F.col("numeric") & F.col("binary"), "boolean").when(F.col("numeric"), "numeric").when(F.col("dates"), "datetime").when(F.col("truth"), "boolean").otherwise("text")
    return rows.select("column_name", kind.alias("inferred_type"))


def numeric_statistics(df: DataFrame, columns: list[str], places: int = 4) -> DataFrame:
    """Count, mean, median, sample deviation, extremes and quartiles (linear interpolation) of each column."""
    rows = df.select(*[F.col(c).try_cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    r = lambda c: F.round(c, places)

    def statistics(name: str, c: Column) -> Column:
        quartiles = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))  # one state for all three
        return F.struct(
            F.lit(name).alias("column_name"), F.count(c).alias("n"), r(F.avg(c)).alias("mean"), r(quartiles[1]).alias("median"), r(F.stddev_samp(c)).alias("std"),
            r(F.min(c)).alias("min"), r(F.max(c)).alias("max"), r(quartiles[0]).alias("q1"), r(quartiles[2]).alias("q3"),
        )

    every = rows.agg(F.array(*[statistics(name, F.col(f"c{i}")) for i, name in enumerate(columns)]).alias("every"))
    return every.select(F.inline("every"))


def row_text(columns: list[str]):
    """A row as text: values joined by bars, newlines as spaces, null as nothing."""
    return F.concat_ws(" | ", *[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " ") for c in columns])


def scan_share(pages: DataFrame, doc: str, text: str = "text", least: int = 50) -> DataFrame:
    """(doc, n_pages, n_scanned, scan_percent): pages with fewer than ``least`` characters of text count as scanned."""
    scanned = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) < least
    counts = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(scanned).alias("n_scanned"))
    return counts.withColumn("scan_percent", F.round(100.0 * F.col("n_scanned") / F.col("n_pages"), 2))
