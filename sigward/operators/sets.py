"""Unions and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_feeds(feeds: dict[str, DataFrame]) -> DataFrame:
    """All rules of several feeds, each row marked with its feed."""
    tagged = [df.withColumn("feed", F.lit(name)) for name, df in feeds.items()]
    return reduce(DataFrame.unionByName, tagged)


def union_scan_results(results: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, results)


def union_restart_sources(service: DataFrame, cron: DataFrame) -> DataFrame:
    """Restart histories of both watchdogs, marked with their source."""
    return service.withColumn("source", F.lit("service")).unionByName(cron.withColumn("source", F.lit("cron")))


def rules_removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """What an update dropped: the rows of `before` with the number of `copies` that `after` lacks.

    A multiset difference kept as counts, so that a row with very many copies stays one row.
    """
    columns = before.columns
    signed = before.withColumn("_n", F.lit(1)).unionByName(after.select(*columns).withColumn("_n", F.lit(-1)))
    return signed.groupBy(*columns).agg(F.sum("_n").alias("copies")).where("copies > 0")
