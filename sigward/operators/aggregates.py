"""Totals, distributions, scores and reports. All of them aggregate on the map side before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigward.functions import fixed
from sigward.functions import scalars as X
from sigward.operators import joins, retention, windows

# ---- matches


def scan_totals(matches: DataFrame) -> DataFrame:
    """Matches, distinct files and distinct rules."""
    return matches.agg(
        F.count(F.lit(1)).alias("matches"),
        F.count_distinct("path").alias("files"),
        F.count_distinct("rule_name").alias("rules"),
    )


def threat_distribution(matches: DataFrame) -> DataFrame:
    counts = matches.groupBy("rule_name").agg(F.count(F.lit(1)).alias("matches"))
    return counts.orderBy(F.col("matches").desc(), "rule_name")


def threat_report(matches: DataFrame) -> DataFrame:
    """Per rule its display name, description, matches and distinct files, most matches first. One shuffle of the matches."""
    per_file = matches.groupBy("rule_name", "path").agg(F.count(F.lit(1)).alias("n"))
    counts = per_file.groupBy("rule_name").agg(F.sum("n").alias("matches"), F.count(F.lit(1)).alias("files"))
    named = counts.select("rule_name", joins.display_name().alias("display_name"), joins.threat_description().alias("description"), "matches", "files")
    return named.orderBy(F.col("matches").desc(), "rule_name")


def list_part(path, parts: int) -> Column:
    """Part of a list a path belongs to: the first 32 bits of its MD5, modulo the number of parts."""
    head = F.conv(F.substring(F.md5(X.col(path)), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(parts))


def files_per_rule(matches: DataFrame) -> DataFrame:
    """(rule_name, path, n_files): the files of every rule with their number, one row each, however many there are."""
    sizes = matches.groupBy("rule_name").agg(F.count(F.lit(1)).alias("n_files"))
    return matches.select("rule_name", "path").join(sizes, "rule_name")


# Paths of a list in one row, where the number of parts is left to file_lists.
LIST_FILES = 10_000


def parts_needed(matches: DataFrame, most: int = LIST_FILES) -> int:
    """Parts that keep the list of the rule with the most files under about `most` paths (one job over rule names)."""
    longest = matches.groupBy("rule_name").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return max(1, -(-2 * longest // most))


def file_lists(matches: DataFrame, parts: int | None = None) -> DataFrame:
    """(rule_name, part, parts, n_files, files): the `|`-joined files of every rule in `parts` parts, the same number for all rules.

    A list is one row, so there have to be as many parts as keep the longest one in a task's memory: by default parts_needed,
    which counts first; a caller who knows the matches may say.
    """
    parts = parts_needed(matches) if parts is None else parts
    placed = matches.withColumn("part", list_part("path", parts))
    lists = placed.groupBy("rule_name", "part").agg(
        F.count(F.lit(1)).alias("n_files"), X.array_to_list(F.sort_array(F.collect_list("path")), "|").alias("files")
    )
    return lists.withColumn("parts", F.lit(parts).cast("bigint"))


def rule_per_file(matches: DataFrame, seq="rule_name") -> DataFrame:
    """One rule per file: the last one in the given order."""
    return matches.groupBy("path").agg(F.max_by("rule_name", X.col(seq)).alias("rule_name"))


# ---- rule corpus


def category_counts(rules: DataFrame, text="body") -> DataFrame:
    """(category, rules) of all twelve categories in one pass. With one line per row it counts lines instead."""
    flags = [F.count_if(joins.category_test(p, text)).alias(name) for name, p in fixed.CATEGORIES]
    row = rules.agg(*flags)
    return row.unpivot([], [name for name, _ in fixed.CATEGORIES], "category", "rules")


def category_summary(rules: DataFrame, text="body") -> DataFrame:
    """`N rules (a Trojan, b Exploit ...)` with the categories that are not empty."""
    patterns = dict(fixed.CATEGORIES)
    flags = [F.count_if(joins.category_test(patterns[n], text)).alias(n) for n, _ in fixed.SUMMARY_LABELS]
    row = rules.agg(F.count(F.lit(1)).alias("total"), *flags)
    parts = [F.when(F.col(n) > 0, F.concat_ws(" ", F.col(n), F.lit(label))) for n, label in fixed.SUMMARY_LABELS]
    inner = F.concat_ws(", ", F.array_compact(F.array(*parts)))
    return row.select(F.concat(F.col("total").cast("string"), F.lit(" rules ("), inner, F.lit(")")).alias("summary"))


def feed_counts(rules: DataFrame, name="file_name") -> DataFrame:
    """(feed, files): rule files per feed by file name, feeds without files left out, and the total."""
    name = X.col(name)
    is_yar = F.endswith(name, F.lit(".yar"))
    flags = [
        F.count_if(F.startswith(name, F.lit(p)) & is_yar).alias(label) for label, p in fixed.FEED_PREFIXES
    ] + [F.count_if(X.contains_ci(name, w)).alias(label) for label, w in fixed.FEED_WORDS]
    labels = [label for label, _ in fixed.FEED_PREFIXES + fixed.FEED_WORDS] + ["Total"]
    row = rules.agg(*flags, F.count_if(is_yar).alias("Total"))
    return row.unpivot([], labels, "feed", "files").where("files > 0 OR feed = 'Total'")


def rule_count(lines: DataFrame, files: DataFrame, line="line") -> DataFrame:
    """(n, unit): header lines `rule ` of the merged set, or the number of rule files when there is no merged set."""
    headers = lines.agg(F.count_if(F.startswith(X.col(line), F.lit("rule "))).alias("n"), F.count(F.lit(1)).alias("all"))
    n_files = files.agg(F.count(F.lit(1))).scalar()
    merged = F.col("all") > 0
    return headers.select(
        F.when(merged, F.col("n")).otherwise(n_files).alias("n"),
        F.when(merged, "rules").otherwise("files").alias("unit"),
    )


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    tagged = before.select(F.lit(1).alias("b")).unionByName(after.select(F.lit(0).alias("b")))
    counts = tagged.agg(F.count_if(F.col("b") == 1).alias("before"), F.count_if(F.col("b") == 0).alias("after"))
    return counts.withColumn("removed", F.col("before") - F.col("after"))


# ---- logs and alerts


def in_days(as_of, days: int, ts="ts") -> Column:
    """Within the `days` dates that end with the date of `as_of`, as a prunable range."""
    last = F.to_date(F.lit(as_of))
    return (F.col(ts) >= F.date_sub(last, days - 1)) & (F.col(ts) < F.date_add(last, 1))


def daily_counts(rows: DataFrame, wanted: Column, as_of, days: int, ts="ts") -> DataFrame:
    """(day, n, total) of the wanted rows for each of the last `days` dates, zero-filled.

    Dates are tested first: they are cheap and prunable, and texts of other days need no look.
    """
    last = F.to_date(F.lit(as_of))
    calendar = rows.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    recent = rows.where(in_days(as_of, days, ts)).where(wanted)
    counts = recent.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    filled = calendar.join(counts, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.withColumn("total", F.sum("n").over(W.partitionBy()))


def daily_change_counts(logs: DataFrame, as_of, days: int = 7) -> DataFrame:
    return daily_counts(logs, X.contains_any("msg", fixed.CHANGE_WORDS), as_of, days)


def is_detection(msg="msg") -> Column:
    return F.contains(X.col(msg), F.lit("THREAT DETECTED")) | X.col(msg).rlike("rule.*matched")


def weekly_detections(logs: DataFrame, as_of, days: int = 7) -> DataFrame:
    return daily_counts(logs, F.contains("msg", F.lit("THREAT DETECTED")), as_of, days)


def scan_trigger_sum(logs: DataFrame, as_of, days: int = 7) -> DataFrame:
    """(logs, scans): scans started, summed over the logs whose last line is younger than `days` whole days."""
    per_log = logs.groupBy("log_file").agg(
        F.max("ts").alias("mtime"), F.count_if(F.col("action") == "scan_started").alias("scans")
    )
    young = retention.age_filter(per_log, "mtime", as_of, "-", days)
    return young.agg(F.count(F.lit(1)).alias("logs"), F.coalesce(F.sum("scans"), F.lit(0)).cast("bigint").alias("scans"))


def activity_24h(logs: DataFrame, alerts: DataFrame, as_of) -> DataFrame:
    """Files changed, scans and detections of one day; test-file hits count only when nothing else was found.

    logs: ts, action, msg. alerts: timestamp, rule. Both go through one aggregation.
    """
    day = F.to_date(F.lit(as_of))
    today = lambda c: (F.col(c) >= day) & (F.col(c) < F.date_add(day, 1))
    zero = F.lit(0)
    flag = lambda c: F.when(c, 1).otherwise(0)
    description = F.coalesce(F.col("rule.description"), F.lit(""))
    from_logs = logs.where(today("ts")).select(
        flag(X.contains_any("msg", fixed.CHANGE_WORDS)).alias("changed"),
        flag(F.col("action") == "scan_started").alias("scan"),
        flag(is_detection()).alias("hit"),
        zero.alias("test"),
    )
    from_alerts = alerts.where(today("timestamp")).select(
        zero.alias("changed"),
        zero.alias("scan"),
        flag(F.array_contains("rule.groups", "yara")).alias("hit"),
        flag(X.contains_ci(description, "eicar")).alias("test"),
    )
    total = from_logs.unionByName(from_alerts).agg(
        *[F.coalesce(F.sum(c), zero).cast("bigint").alias(c) for c in ("changed", "scan", "hit", "test")]
    )
    return total.select(
        F.col("changed").alias("files_changed"),
        F.col("scan").alias("scans"),
        F.when(F.col("hit") > 0, F.col("hit")).otherwise(F.col("test")).alias("detections"),
        F.col("test").alias("test_file_hits"),
    )


def response_totals(logs: DataFrame) -> DataFrame:
    return logs.agg(
        F.count_if(F.col("action") == "scan_started").alias("scans"),
        F.count_if(F.contains("msg", F.lit("THREAT DETECTED"))).alias("detections"),
        F.count_if(F.contains("msg", F.lit("File quarantined"))).alias("quarantined"),
    )


def top_detections(alerts: DataFrame, n: int = 10, group: str = "yara") -> DataFrame:
    counts = (
        alerts.where(F.array_contains("rule.groups", group))
        .groupBy(F.col("rule.description").alias("description"))
        .agg(F.count(F.lit(1)).alias("alerts"))
    )
    return counts.orderBy(F.col("alerts").desc(), "description").limit(n)


def threat_trend(alerts: DataFrame, as_of, days: int = 7, group: str = "yara") -> DataFrame:
    """Alerts per day, later than `days` days before `as_of`; days without alerts have no row."""
    start = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    recent = alerts.where(F.array_contains("rule.groups", group) & (F.col("timestamp") > start))
    return recent.groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("threats"))


# ---- quarantine, monitoring, fleet


def quarantine_summary(q: DataFrame) -> DataFrame:
    return q.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.min("q_time").alias("oldest"),
        F.min(F.struct("q_time", "q_path"))["q_path"].alias("oldest_path"),
    )


def monitor_mode(monitored: DataFrame) -> DataFrame:
    """One row per directory; realtime beats scheduled."""
    live = F.bool_or(F.col("mode") == "realtime")
    return monitored.groupBy("dir").agg(F.when(live, "realtime").otherwise("scheduled").alias("mode"))


def fleet_totals(fleet: DataFrame) -> DataFrame:
    """Hosts that gave a result, and threats over all of them."""
    return fleet.agg(
        F.count_if(F.col("status").isin("clean", "threats")).alias("hosts_scanned"),
        F.coalesce(F.sum("threats"), F.lit(0)).cast("bigint").alias("threats_total"),
    )


# ---- scores


def band(score, weekly: bool) -> Column:
    score = X.col(score)
    out = F.when(score >= 80, "EXCELLENT").when(score >= 60, "GOOD")
    return out.otherwise("WARNING") if weekly else out.when(score >= 40, "WARNING").otherwise("CRITICAL")


def penalty(test: Column, points: int) -> Column:
    return F.when(test, points).otherwise(0)


def health_score(metrics: DataFrame, kind: str = "weekly") -> DataFrame:
    """Adds score and health. weekly: cpu, mem, disk, detections. status: engine_ok, agent_ok, rules, cpu, disk."""
    if kind == "weekly":
        lost = (
            penalty(F.floor("cpu") > 80, 20)
            + penalty(F.floor("mem") > 80, 20)
            + penalty(F.floor("disk") > 80, 20)
            + penalty(F.col("detections") > 10, 10)
        )
    else:
        lost = (
            penalty(~F.col("engine_ok"), 30)
            + penalty(~F.col("agent_ok"), 30)
            + penalty(F.col("rules") == 0, 20)
            + penalty(F.floor("cpu") > 80, 10)
            + penalty(F.floor("disk") > 80, 10)
        )
    scored = metrics.withColumn("score", (F.lit(100) - lost).cast("int"))
    return scored.withColumn("health", band("score", kind == "weekly"))


def weekly_advice() -> Column:
    """What the metrics (cpu, disk, detections, changes) call for, and general advice always."""
    advice = [
        F.when(F.floor("cpu") > 80, fixed.ADVICE_CPU),
        F.when(F.floor("disk") > 80, fixed.ADVICE_DISK),
        F.when(F.col("detections") > 0, fixed.ADVICE_DETECTIONS),
        F.when(F.col("changes") > 100, fixed.ADVICE_CHANGES),
        *[F.lit(text) for text in fixed.ADVICE_ALWAYS],
    ]
    return F.array_compact(F.array(*advice))


def recommendations(metrics: DataFrame, kind: str = "weekly") -> DataFrame:
    """(host, advice) rows.

    weekly (host, cpu, disk, detections, changes): what the metrics call for, and general advice always. status
    (host, engine_ok, agent_ok, rules, cpu, disk): only for hosts whose status score is below 80.
    """
    hot, full = F.floor("cpu") > 80, F.floor("disk") > 80
    if kind == "weekly":
        advice = weekly_advice()
    else:
        metrics = health_score(metrics, "status").where(F.col("score") < fixed.STATUS_GOOD)
        advice = F.array_compact(F.array(
            F.when(~F.col("engine_ok"), fixed.STATUS_ENGINE),
            F.when(~F.col("agent_ok"), fixed.STATUS_AGENT),
            F.when(F.col("rules") == 0, fixed.STATUS_RULES),
            F.when(hot, fixed.STATUS_CPU),
            F.when(full, fixed.STATUS_DISK),
        ))
    return metrics.select("host", F.explode(advice).alias("advice"))


def changed_since(file_entry: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Integrity rows changed within the hours before `as_of`, compared as numbers of seconds."""
    start = X.to_epoch(as_of) - F.lit(hours * 3600)
    return file_entry.where(F.col("mtime") > start).agg(F.count(F.lit(1)).alias("changed"))


def detection_kpis(matches: DataFrame, truth: DataFrame, rules: DataFrame) -> DataFrame:
    """Detection rate, false-positive rate and rule coverage.

    truth: path, toxic of the files whose nature is known. rules: rule_name, active.
    """
    flagged = matches.select("path").distinct().withColumn("hit", F.lit(True))
    judged = truth.join(flagged, "path", "left")
    bad, hit = F.col("toxic") == 1, F.col("hit").isNotNull()
    counts = judged.agg(
        F.count_if(bad).alias("known"),
        F.count_if(bad & hit).alias("detected"),
        F.count_if(hit).alias("alerts"),
        F.count_if(~bad & hit).alias("false_alerts"),
    )
    coverage = rules.select(F.round(F.try_divide(F.count_if("active"), F.count(F.lit(1))), 6)).scalar()
    return counts.select(
        "known",
        "detected",
        F.round(F.try_divide("detected", "known"), 6).alias("detection_rate"),
        F.round(F.try_divide("false_alerts", "alerts"), 6).alias("false_positive_rate"),
        coverage.alias("rule_coverage"),
    )


def response_latency(detections: DataFrame, quarantined: DataFrame, fast: int = 5) -> DataFrame:
    """Seconds from each detection to the next quarantine of the same host: pairs, average, share under `fast`.

    The next quarantine is an as-of look-up, so no pairs are formed within a host.
    """
    facts = quarantined.select("host", "ts", F.lit(0).alias("q"))
    pairs = windows.asof_join(detections, facts, ["q"], forward=True).where("fact_ts IS NOT NULL")
    wait = X.to_epoch("fact_ts") - X.to_epoch("ts")
    timed = pairs.select(wait.alias("wait"))
    return timed.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.round(F.avg("wait"), 3).alias("avg_seconds"),
        F.round(F.try_divide(F.count_if(F.col("wait") < fast), F.count(F.lit(1))), 6).alias("share_fast"),
    )


def pct(used, total) -> Column:
    return X.pct(used, total)


def config_line_count(lines: DataFrame, mode: str = "digit", line="line") -> DataFrame:
    """Settings lines that start with a digit (`digit`), or with anything but a comment sign (`active`)."""
    pattern = r"^[0-9]" if mode == "digit" else r"^[^#]"
    return lines.agg(F.count_if(X.col(line).rlike(pattern)).alias("n"))
