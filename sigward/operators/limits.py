"""Sorted heads of listings. Every order is total, so the result does not depend on the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_n(df: DataFrame, n: int, order=("path",)) -> DataFrame:
    return df.orderBy(*order).limit(n)


def recent_quarantine(q: DataFrame, n: int = 20) -> DataFrame:
    """Last n items in path order, last one first."""
    return q.orderBy(F.col("q_path").desc()).limit(n)


def recent_changes(file_entry: DataFrame, n: int = 5) -> DataFrame:
    """The n integrity rows changed last, with a readable time."""
    newest = file_entry.orderBy(F.col("mtime").desc(), "path").limit(n)
    return newest.select("path", F.timestamp_seconds("mtime").alias("ts"))


def remaining_note(df: DataFrame, shown: int = 10) -> DataFrame:
    """How many rows a listing of `shown` rows leaves out."""
    rest = F.greatest(F.count(F.lit(1)) - F.lit(shown), F.lit(0))
    return df.agg(rest.cast("bigint").alias("remaining"))


def newest_listing(files: DataFrame, n: int = 3) -> DataFrame:
    return files.select("name", "mtime", "path").orderBy(F.col("mtime").desc(), "path").limit(n).select("name", "mtime")


def oldest(q: DataFrame) -> DataFrame:
    first = q.agg(F.min(F.struct("q_time", "path")).alias("o"))
    return first.select("o.q_time", "o.path")
