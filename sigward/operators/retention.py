"""Age arithmetic and retention tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigward import session
from sigward.functions import fixed
from sigward.functions import scalars as X

DAY_SEC = 86400


def age_micros(ts, as_of) -> Column:
    return F.unix_micros(X.col(as_of).cast("timestamp")) - F.unix_micros(X.col(ts).cast("timestamp"))


def whole_days(ts, as_of) -> Column:
    """Whole days elapsed, rounded down."""
    return F.floor(age_micros(ts, as_of) / F.lit(DAY_SEC * 1_000_000.0)).cast("bigint")


def before(df: DataFrame, ts: str, as_of, days: int = 0, minutes: int = 0) -> Column:
    """`as_of` minus a span, in the type of the column, so that a comparison with it can reach the file statistics."""
    span = F.make_dt_interval(F.lit(days), F.lit(0), F.lit(minutes))
    return (X.col(as_of).cast("timestamp") - span).cast(df.schema[ts].dataType)


def age_test(df: DataFrame, ts: str, as_of, op: str, n: int, unit: str = "days") -> Column:
    """`+n`: older than n; `-n`: younger than n. Days are cut to whole days first, minutes are not.

    Whole days above n means n + 1 days or more; whole days below n means less than n days. Both are plain
    comparisons of the column with a constant.
    """
    if unit == "days":
        if op == "+":
            return F.col(ts) <= before(df, ts, as_of, days=n + 1)
        return F.col(ts) > before(df, ts, as_of, days=n)
    bound = before(df, ts, as_of, minutes=n)
    return F.col(ts) < bound if op == "+" else F.col(ts) > bound


def age_filter(df: DataFrame, ts: str, as_of, op: str, n: int, unit: str = "days") -> DataFrame:
    return df.where(age_test(df, ts, as_of, op, n, unit))


def expire(df: DataFrame, ts, as_of, days: int = fixed.EXPIRE_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept rows, expired rows, counts before / removed / remaining). Nothing is deleted here."""
    gone = age_test(df, ts, as_of, "+", days)
    counts = df.agg(
        F.count(F.lit(1)).alias("before"),
        F.count_if(gone).alias("removed"),
        F.count_if(~gone).alias("remaining"),
    )
    return df.where(~gone), df.where(gone), counts


def expire_stored(spark: SparkSession, path: str, ts: str, as_of, days: int = fixed.EXPIRE_DAYS, day: str = "day") -> DataFrame:
    """Take the expired rows out of a stored Parquet table whose folders are the dates of `ts`.

    Returns (day, before, removed, remaining) of the days that lost rows. Only folders up to the day of the limit are read. The day that the
    limit cuts is overwritten with what it keeps, as one commit of that partition; days without rows left lose their folder;
    all others keep their files. Run again, as after a failure, it finds what is left to do. Rows without a time are kept.
    """
    stored = spark.read.parquet(path)
    last = spark.range(1).select(before(stored, ts, as_of, days=days + 1).cast("date")).first()[0]
    gone = F.coalesce(age_test(stored, ts, as_of, "+", days), F.lit(False))
    old = stored.where(F.col(day) <= F.lit(last))
    counts = old.groupBy(day).agg(F.count(F.lit(1)).alias("before"), F.count_if(gone).alias("removed")).where("removed > 0")
    counts = session.written(counts.withColumn("remaining", F.col("before") - F.col("removed")), "expired-days")
    # A row for each day there is.
    emptied = [r[0] for r in counts.where("remaining = 0").select(day).collect()]
    cut = counts.where("remaining > 0").select(day)
    # What stays is safe in a table of its own before its folder is overwritten.
    kept = session.written(old.where(~gone).join(F.broadcast(cut), day, "left_semi"), "kept-rows")
    if not kept.isEmpty():
        kept.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    session.remove_folders(spark, [f"{path.rstrip('/')}/{day}={d}" for d in emptied])
    return counts


def tier(df: DataFrame, ts, as_of) -> DataFrame:
    """Adds tier: hot (up to 7 whole days), compress (8 to 29), boundary (30), expired (31 and more)."""
    age = whole_days(ts, as_of)
    label = (
        F.when(age > fixed.EXPIRE_DAYS, "expired")
        .when((age > fixed.COMPRESS_DAYS) & (age < fixed.EXPIRE_DAYS), "compress")
        .when(age == fixed.EXPIRE_DAYS, "boundary")
        .otherwise("hot")
    )
    return df.withColumn("tier", label)
