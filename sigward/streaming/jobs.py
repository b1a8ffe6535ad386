"""Structured Streaming jobs. Each has a batch twin among the operators that gives the same rows.

Sinks write one folder per micro-batch and overwrite it, so a batch that is repeated after a failure leaves the
same files. Checkpoints and outputs belong in the shared folder of the cluster (session.scratch_dir).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sigward.functions import fixed
from sigward.functions import scalars as X
from sigward.operators import filters, matching, windows
from sigward.sources import readers, sinks

LATENESS = "1 hour"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table as a stream of its files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def watch_files(spark: SparkSession, path: str, archive: str | None = None, max_files: int | None = None) -> DataFrame:
    """Files as they arrive below `path`, with the columns of readers.scan_files. Scanned files move to `archive`, where given."""
    reader = spark.readStream.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
    reader = reader.option("recursiveFileLookup", True)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(*readers.file_columns(F.regexp_replace("path", r"^file:/+", "/"), "content", "length", "modificationTime"))


def bounded_intake(max_files: int = 1, every: str = "5 minutes") -> tuple[dict[str, str], dict[str, str]]:
    """(reader options, trigger arguments) that bound how much a micro-batch takes in and how often one runs."""
    return {"maxFilesPerTrigger": str(max_files)}, {"processingTime": every}


def start_batches(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", **trigger
) -> StreamingQuery:
    trigger = trigger or {"availableNow": True}
    # State on local disk with changes kept in the checkpoint: it may outgrow the memory of an executor.
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(batch_folder(path, batch_id))

    return write


def run_to_folder(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what is available into parquet folders, one per micro-batch."""
    query = start_batches(stream, append_to(path), checkpoint, mode)
    query.awaitTermination()


def latest_rows(df: DataFrame, keys, values) -> DataFrame:
    """Rows of an update-mode sink, reduced to the newest state of every key."""
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return newest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


# ---- scan on arrival


def stream_scan(
    files: DataFrame, rules: DataFrame, rule_strings: DataFrame, out: str, checkpoint: str, q_time, **trigger
) -> StreamingQuery:
    """Scan every arriving file, store the matched ones and write their alert lines.

    Below `out`: matches/, quarantine/ (one row per matched file) and alerts/ (text). `files` holds item_id beside
    the usual columns. A file arrives whole, so its rule conditions need no state across batches. Rules are measured once.
    """
    ready = matching.rule_set(rules, rule_strings)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        wanted = filters.exclude_names(filters.exclude_dirs(batch))
        matched = matching.matched_files(wanted, ready)
        items = sinks.quarantine_rows(matched.withColumn("rule_name", F.try_element_at("rule_names", F.lit(-1))), q_time, "rule_names")
        stored = batch_folder(f"{out}/quarantine", batch_id)
        items.write.mode("overwrite").parquet(stored)
        rows = spark.read.schema(items.schema).parquet(stored)
        found = rows.select(F.explode("rule_names").alias("rule_name"), F.col("orig_path").alias("path"))
        found.write.mode("overwrite").parquet(batch_folder(f"{out}/matches", batch_id))
        named = rows.select("q_time", "rule_name", F.col("orig_path").alias("path"), X.basename("q_path").alias("q_name"))
        sinks.write_alert_lines(named, batch_folder(f"{out}/alerts", batch_id), "overwrite")

    return start_batches(files, write, checkpoint, **trigger)


def stream_hits(files: DataFrame, rule_strings: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The hits of every arriving file below `out` (path, rule_key, rule_name, string_id), for conditions over several files.

    Files are excluded by folder and name as in stream_scan.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        wanted = filters.exclude_names(filters.exclude_dirs(batch))
        hits = matching.match_strings(wanted, rule_strings).drop("file_key").distinct()
        hits.write.mode("overwrite").parquet(batch_folder(out, batch_id))

    return start_batches(files, write, checkpoint, **trigger)


# ---- windowed counts


def stream_daily_counts(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """(day, n): detections per day. For update or append mode."""
    counts = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.select(F.to_date("w.start").alias("day"), "n")


def stream_hourly_sliding(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """(host, window_end, n): restarts in the hour before each five-minute mark."""
    span = F.window("ts", "1 hour", "5 minutes").alias("w")
    counts = events.withWatermark("ts", lateness).groupBy("host", span).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("host", F.col("w.end").alias("window_end"), "n")


# ---- event order and late rows, with tables as state

# Each batch leaves its state in folders of its own and reads those of the batch before it, so a batch that is repeated finds the
# same state and leaves the same files. The mark is the greatest event time up to and with a batch; a row is late if it is older than
# the mark of the batches before it by more than the lateness, as with a watermark. Late rows are kept, not dropped.


def state_of(spark: SparkSession, path: str, batch_id: int, schema) -> DataFrame:
    """What a batch left; nothing before the first batch."""
    if batch_id < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(batch_folder(path, batch_id))


def leave(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(batch_folder(path, batch_id))


MARK = "mark TIMESTAMP"


def bound(mark: Column, lateness: str) -> Column:
    return mark - F.expr(f"INTERVAL {lateness}")


def with_late(batch: DataFrame, out: str, batch_id: int, lateness: str) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows) of a batch; leaves its mark. A row without a time is late."""
    spark = batch.sparkSession
    before = state_of(spark, f"{out}/marks", batch_id - 1, MARK)
    newest = batch.select(F.max(F.col("ts").cast("timestamp")).alias("mark"))
    leave(before.unionByName(newest).agg(F.max("mark").alias("mark")).coalesce(1), f"{out}/marks", batch_id)
    mark = before.agg(F.max("mark").alias("m")).first()["m"]
    late = F.col("ts").isNull()
    if mark is not None:
        late = late | (F.col("ts") < bound(F.lit(mark), lateness))
    return batch.where(~late), batch.where(late)


def stream_counts(events: DataFrame, keys: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, lateness: str = LATENESS, **trigger) -> StreamingQuery:
    """Counts of the rows that `keys` makes of the events, with late events kept apart.

    Below `out`: counts/ (the keys with n, partial counts of a batch each) and late/ (whole events). Counts add up, so no state is
    held between batches but the mark.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        in_time, late = with_late(batch, out, batch_id, lateness)
        rows = keys(in_time)
        leave(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), f"{out}/counts", batch_id)
        leave(late, f"{out}/late", batch_id)
        batch.unpersist()

    return start_batches(events, write, checkpoint, **trigger)


def by_day(events: DataFrame) -> DataFrame:
    return events.select(F.to_date("ts").alias("day"))


def by_sliding_hour(events: DataFrame) -> DataFrame:
    """A row for each five-minute mark in the hour after an event."""
    return events.select("host", F.window("ts", "1 hour", "5 minutes").alias("w")).select("host", F.col("w.end").alias("window_end"))


def added_up(counts: DataFrame) -> DataFrame:
    keys = [c for c in counts.columns if c not in ("n", "batch_id")]
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"))


def stream_limit_events(events: DataFrame, limit: int, window: int, out: str, checkpoint: str, lateness: str = LATENESS, **trigger) -> StreamingQuery:
    """The greedy limiter in event order: events wait until no earlier one can come in time, then pass or not.

    Below `out`: accepted/ and late/ (whole events), and as state waiting/ (events within the lateness), last/ (the last `limit` accepted
    events of each host, as long as they bear on later ones) and marks/. When a stream has ended for good, `finish_limit` releases what waits.
    """
    schema = events.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        in_time, late = with_late(batch, out, batch_id, lateness)
        leave(late, f"{out}/late", batch_id)
        release_until(spark, in_time, out, batch_id, limit, window, lateness, schema)
        batch.unpersist()

    return start_batches(events, write, checkpoint, **trigger)


def release_until(spark: SparkSession, more: DataFrame, out: str, batch_id: int, limit: int, window: int, lateness: str | None, schema) -> None:
    """Let the events that are complete (all of them without a lateness) through the limiter, in order, behind the ones accepted last."""
    waiting = state_of(spark, f"{out}/waiting", batch_id - 1, schema).unionByName(more)
    complete, until = F.lit(True), None
    if lateness is not None:
        mark = state_of(spark, f"{out}/marks", batch_id, MARK).first()["mark"]
        until = None if mark is None else bound(F.lit(mark), lateness)
        complete = F.lit(False) if until is None else F.col("ts") < until
    last = state_of(spark, f"{out}/last", batch_id - 1, schema)
    known = last.select("*", F.lit(True).alias("_old")).unionByName(waiting.where(complete).select("*", F.lit(False).alias("_old")))
    # Accepted events pass again, as nothing before them is left; so the limiter goes on as if it had not stopped.
    passed = windows.limit_events(known, limit, window).select("*")
    leave(passed.where("NOT _old").drop("_old"), f"{out}/accepted", batch_id)
    leave(waiting.where(~complete), f"{out}/waiting", batch_id)
    newest = last.unionByName(state_of(spark, f"{out}/accepted", batch_id, schema))
    if until is not None:
        newest = newest.where(X.to_epoch("ts") + window >= X.to_epoch(until))
    leave(windows.first_per_key(newest, ["host"], [F.col("ts").desc(), F.col("event_id").desc()], limit), f"{out}/last", batch_id)


def finish_limit(spark: SparkSession, out: str, limit: int, window: int, schema) -> None:
    """Release the events that wait behind the last batch, as a batch of its own."""
    last = spark.read.option("basePath", f"{out}/marks").parquet(f"{out}/marks").agg(F.max("batch_id").alias("b")).first()["b"]
    release_until(spark, spark.createDataFrame([], schema), out, last + 1, limit, window, None, schema)


def stream_limit_restarts(events: DataFrame, out: str, checkpoint: str, **how) -> StreamingQuery:
    return stream_limit_events(events, fixed.MAX_RESTARTS, fixed.RESTART_WINDOW_SEC, out, checkpoint, **how)


def stream_suppress_alerts(events: DataFrame, out: str, checkpoint: str, **how) -> StreamingQuery:
    return stream_limit_events(events, 1, fixed.ALERT_GAP_SEC, out, checkpoint, **how)


# ---- stateless checks


def stream_health(snapshots: DataFrame) -> DataFrame:
    """Issue list of every check cycle."""
    return filters.issues(snapshots)
