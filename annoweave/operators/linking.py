"""Joins between a master sheet, coder sheets and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoweave.operators.ordering import last_by


def alignment_mismatch(there: Column, left_key: Column, right_key: Column) -> Column:
    """Whether the other sheet has no such row, or a row with another key (null equals null)."""
    return ~(F.coalesce(there, F.lit(False)) & left_key.eqNullSafe(right_key))


def line_lookup(tokens: DataFrame, lines: DataFrame, keys: list[str], ordinal: str, columns: list[str]) -> DataFrame:
    """Left join on keys; of several lines with equal keys the last one counts."""
    found = last_by(lines.select(*keys, ordinal, *columns), keys, ordinal).drop(ordinal)
    return tokens.join(found, keys, "left")


def with_reference(records: DataFrame, references: DataFrame, key: str = "record_id") -> DataFrame:
    """Inner in effect: a record without reference raises when it is read."""
    marked = references.withColumn("__there", F.lit(True))
    joined = records.join(marked, key, "left")
    fine = F.coalesce(F.col("__there"), F.raise_error(F.concat(F.lit("no reference for "), F.col(key))).cast("boolean"))
    return joined.filter(fine).drop("__there")


def missing_from(expected: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows that weren't seen."""
    return expected.join(seen.select(*keys).distinct(), keys, "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def key_differences(keys: Column, wanted: Column) -> tuple[Column, Column, Column]:
    """(extra, missing, equal as sets) of two arrays of names; the first two in order."""
    return F.array_sort(F.array_except(keys, wanted)), F.array_sort(F.array_except(wanted, keys)), F.array_sort(F.array_distinct(keys)) == F.array_sort(F.array_distinct(wanted))
