"""Operators put together to what is run as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sigward import session
from sigward.functions import fixed
from sigward.functions import scalars as X
from sigward.operators import aggregates, filters, matching, windows
from sigward.sources import readers, sinks


def update_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged rules, disabled rules with their reason, counts before / after / removed) of the rules of all feeds.

    Of files with the same name the first feed's survives, deny-listed files go, then one rule per name and one per body stay.
    Ties go by file name and rule number. The counts are of rule rows before and after.
    """
    flat = windows.flatten_by_name(rules, tie=("rule_no",))
    active, disabled = filters.deny_rules(flat)
    merged = windows.dedupe_rules(windows.dedupe_rules(active), "body")
    return merged, disabled, aggregates.before_after(rules, merged)


def quarantine_matches(files: DataFrame, rules: DataFrame, q_time, path: str, mode: str = "append") -> None:
    """Scan `files` with parsed `rules` and store what matches below `path`, a row for each file with the names of its rules.

    Broken and deny-listed rules are left out. `files` holds item_id beside the usual columns.
    """
    working, _ = matching.validate_rules(rules)
    active, _ = filters.deny_rules(working)
    # Rules are parsed and checked once, not by each job that measures them.
    active = session.written(active, "active-rules")
    wanted = filters.exclude_names(filters.exclude_dirs(files))
    matched = matching.matched_files(wanted, active, readers.rule_strings(active))
    items = matched.withColumn("rule_name", F.try_element_at("rule_names", F.lit(-1)))
    sinks.write_quarantine(sinks.quarantine_rows(items, X.col(q_time), "rule_names"), path, mode)


def write_updated_rules(rules: DataFrame, path: str) -> DataFrame:
    """Store the merged rules of all feeds; returns (before, after, removed), counted by the job that writes them."""
    came, stayed = Observation("came"), Observation("stayed")
    counted = F.count(F.lit(1)).alias("n")
    merged, _, _ = update_rules(rules.observe(came, counted))
    merged.observe(stayed, counted).write.mode("overwrite").parquet(path)
    before, after = came.get["n"], stayed.get["n"]
    numbers = {"before": before, "after": after, "removed": before - after}
    return rules.sparkSession.range(1).select(*[F.lit(n).cast("bigint").alias(c) for c, n in numbers.items()])


def watchdog(snapshots: DataFrame) -> DataFrame:
    """(host, ts, event_id, issues, decision, alert) of the snapshots with an issue, in one table.

    A host is restarted unless the limit of restarts is reached in the hour before, which is `refused` and leaves no trace in the limit. A
    restart always gives an alert (`sent`); refusals give one after which others are `held back` for the gap of alerts. `snapshots`
    holds host, ts, event_id (unique) and the columns of filters.issue_list.
    """
    checked = snapshots.select("host", "ts", "event_id", filters.issue_list().alias("issues")).where(F.size("issues") > 0)
    bad = session.written(checked, "watchdog-issues")
    decided = bad.join(windows.limit_restarts(bad.drop("issues")).select("event_id", F.lit("restart").alias("decision")), "event_id", "left")
    decided = session.written(decided.withColumn("decision", F.coalesce("decision", F.lit("refused"))), "watchdog-decisions")
    refused = decided.where("decision = 'refused'").select("host", "ts", "event_id")
    told = windows.suppress_alerts(refused).select("event_id", F.lit("sent").alias("alert"))
    alert = F.when(F.col("decision") == "restart", "sent").otherwise(F.coalesce("alert", F.lit("held back")))
    return decided.join(told, "event_id", "left").select("host", "ts", "event_id", "issues", "decision", alert.alias("alert"))


def weekly_hosts(logs: DataFrame, metrics: DataFrame, as_of, days: int = 7) -> DataFrame:
    """The weekly report as a row for each host of `metrics`: changes, scans and detections of the last `days` dates, score, health and advice.

    `logs`: host, ts, action, msg. `metrics`: host, cpu, mem, disk. Logs are read once and counted per host before the shuffle.
    """
    recent = logs.where(aggregates.in_days(as_of, days)).groupBy("host").agg(
        F.count_if(X.contains_any("msg", fixed.CHANGE_WORDS)).alias("changes"),
        F.count_if(F.col("action") == "scan_started").alias("scans"),
        F.count_if(F.contains("msg", F.lit("THREAT DETECTED"))).alias("detections"),
    )
    counts = ("changes", "scans", "detections")
    rows = metrics.select("host", "cpu", "mem", "disk").join(recent, "host", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    return aggregates.health_score(rows).select("host", *counts, "score", "health", aggregates.weekly_advice().alias("advice"))
