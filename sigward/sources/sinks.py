"""Writers. Every one appends or overwrites whole partitions, so a repeated task leaves the same files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigward import session
from sigward.functions import fixed
from sigward.functions import scalars as X
from sigward.operators import retention


def quarantine_rows(df: DataFrame, q_time, *extra: str) -> DataFrame:
    """q_path, orig_path, rule_name, q_time, sha256, size_bytes, content, q_date (and extra columns) of matched files.

    `df` holds path, name, rule_name, content and `item_id`, which makes names unique within a second.
    """
    q_time = X.col(q_time)
    name = X.quarantine_name("name", q_time, "item_id")
    return df.select(
        F.concat_ws("/", F.date_format(q_time, "yyyyMMdd"), name).alias("q_path"),
        F.col("path").alias("orig_path"),
        "rule_name",
        q_time.alias("q_time"),
        X.sha256_hex("content").alias("sha256"),
        F.octet_length("content").cast("bigint").alias("size_bytes"),
        "content",
        F.to_date(q_time).alias("q_date"),
        *extra,
    )


def write_quarantine(df: DataFrame, path: str, mode: str = "append") -> None:
    """Store quarantine rows below one folder per day. Nothing is removed from the source.

    Rebalancing by day gives files of even size: small days are put together, a day that holds most rows is split.
    """
    df.hint("rebalance", "q_date").write.partitionBy("q_date").mode(mode).parquet(path)


def sidecar_text(orig_path="orig_path", rule_name="rule_name", q_time="q_time", sha256="sha256") -> Column:
    """The metadata text that goes with a quarantined file."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Original Path: "), X.col(orig_path)),
        F.concat(F.lit("Detection Rule: "), X.col(rule_name)),
        F.concat(F.lit("Quarantine Time: "), F.date_format(q_time, "yyyy-MM-dd HH:mm:ss")),
        F.concat(F.lit("SHA256: "), X.col(sha256)),
    )


def alert_lines(df: DataFrame, ts="q_time", rule="rule_name", path="path", stored="q_name") -> DataFrame:
    """One alert line per quarantined file, as the decoder of the alert system expects it."""
    line = F.format_string(
        fixed.ALERT_LINE, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), X.col(rule), X.col(path), X.col(stored)
    )
    return df.select(line.alias("value"))


def write_alert_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    alert_lines(df).write.mode(mode).text(path)


def log_line(ts="ts", level="level", msg="msg") -> Column:
    """`[YYYY-MM-DD hh:mm:ss] [LEVEL] msg`; the level part is left out where it is null."""
    stamp = F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("]"))
    tag = F.concat(F.lit("["), X.col(level), F.lit("]"))
    return F.concat_ws(" ", stamp, tag, X.col(msg))


def write_daily_log(df: DataFrame, path: str, mode: str = "append") -> None:
    """Log rows (ts, level, msg) as text lines, one folder per day."""
    lines = df.select(log_line().alias("value"), F.to_date("ts").alias("log_date"))
    lines.hint("rebalance", "log_date").write.partitionBy("log_date").mode(mode).text(path)


def compact_old_logs(df: DataFrame, as_of, path: str, ts="ts", mode: str = "overwrite") -> None:
    """Write the rows of the compression tier (8 to 29 whole days old) as gzip text, one folder per day."""
    old = retention.age_filter(df, ts, as_of, "+", fixed.COMPRESS_DAYS)
    old = retention.age_filter(old, ts, as_of, "-", fixed.EXPIRE_DAYS)
    lines = old.select(log_line(ts).alias("value"), F.to_date(ts).alias("log_date"))
    even = lines.hint("rebalance", "log_date")
    even.write.partitionBy("log_date").mode(mode).option("compression", "gzip").text(path)


def plain_path(path) -> Column:
    """A file's path as all readers write it."""
    return F.regexp_replace(path, r"^file:/+", "/")


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime and the partition columns of the files of a table. Contents are not read."""
    return spark.read.format("binaryFile").load(path).drop("content").withColumn("path", plain_path("path"))


def compact_small_files(spark: SparkSession, path: str, target_bytes: int, day: str = "log_date", compression: str = "none") -> DataFrame:
    """Join the small files of the days of a stored text log to files of about `target_bytes`.

    Returns (day, files, small, slots) of the days that were rewritten: those with two files under the target or more. Their lines keep
    their order by file and place. Such a day is overwritten as one commit of its partition, out of a table of its own, so a
    failure leaves it as it was or as it should be; days without small files are not read.
    """
    files = stored_files(spark, path)
    sizes = files.groupBy(day).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("length") < target_bytes).alias("small"), F.sum("length").alias("bytes"))
    due = sizes.where("small > 1").withColumn("slots", F.ceil(F.col("bytes") / target_bytes))
    due = session.written(due.select(day, "files", "small", "slots"), "days-to-compact")
    slots = due.agg(F.sum("slots")).first()[0]
    if not slots:
        return due
    # Files are few beside their lines: a row for each file of a day.
    earlier = W.partitionBy(day).orderBy("path").rowsBetween(W.unboundedPreceding, -1)
    placed = files.join(due, day, "left_semi").select(
        F.col("path").alias("file"), F.floor(F.coalesce(F.sum("length").over(earlier), F.lit(0)) / target_bytes).alias("slot")
    )
    row_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = spark.read.text(path).select(
        "value", day, plain_path("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") + row_in_task).alias("place")
    )
    lines = lines.join(F.broadcast(due.select(day)), day, "left_semi").join(placed, "file")
    joined = session.written(lines, "lines-to-compact").repartitionByRange(slots, day, "slot").sortWithinPartitions(day, "slot", "file", "place")
    writer = joined.select("value", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression)
    writer.partitionBy(day).text(path)
    return due


def snapshot_rules(df: DataFrame, path: str, as_of) -> None:
    """A copy of the rule set in a folder named by the time of the copy."""
    stamped = df.withColumn("snapshot", F.date_format(as_of, "yyyyMMdd_HHmmss"))
    stamped.write.partitionBy("snapshot").mode("append").parquet(path)
