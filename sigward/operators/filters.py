"""Row filters and banding rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigward.functions import fixed
from sigward.functions import scalars as X


def under(path, folder: str) -> Column:
    """At or below a directory; a sibling that only shares the prefix does not count."""
    path = X.col(path)
    return F.startswith(path, F.lit(folder.rstrip("/") + "/")) | (path == folder)


def exclude_dirs(files: DataFrame, dirs=fixed.EXCLUDED_DIRS, path="path") -> DataFrame:
    return files.where(reduce(lambda keep, d: keep & ~under(path, d), dirs, F.lit(True)))


def exclude_names(files: DataFrame, globs=fixed.EXCLUDED_NAMES, name="name") -> DataFrame:
    return files.where(reduce(lambda keep, g: keep & ~X.glob_match(name, g), globs, F.lit(True)))


def max_depth(files: DataFrame, root: str, n: int, path="path") -> DataFrame:
    """Files at most n levels below the root (a file directly in the root is at level 1)."""
    base = root.rstrip("/") + "/"
    rest = F.substr(X.col(path), F.lit(len(base) + 1))
    return files.where(F.startswith(X.col(path), F.lit(base)) & (F.size(F.split(rest, "/")) <= n))


def parse_matches(lines: DataFrame, line="value") -> DataFrame:
    """rule_name and path of engine output lines; empty, warning and one-field lines are dropped."""
    text = X.col(line)
    return (
        lines.where((text != "") & ~F.startswith(text, F.lit("warning:")))
        .withColumn("rule_name", X.split_fields(line, 1))
        .withColumn("path", X.clean_path(X.split_fields(line, 2)))
        .where((F.length("rule_name") > 0) & (F.length("path") > 0))
        .drop(line)
    )


def on_date(df: DataFrame, day, ts="ts") -> DataFrame:
    """Rows stamped with one day. Written as a range, so it can prune files by their statistics."""
    start = F.to_date(F.lit(day))
    return df.where((F.col(ts) >= start) & (F.col(ts) < F.date_add(start, 1)))


def contains_any(df: DataFrame, c, words) -> DataFrame:
    return df.where(X.contains_any(c, words))


def contains_ci(df: DataFrame, c, word: str) -> DataFrame:
    return df.where(X.contains_ci(c, word))


def platform_lines(df: DataFrame, line="line", tokens=fixed.PLATFORM_TOKENS) -> DataFrame:
    """Drop lines that name another platform, wherever the token stands in the line."""
    return df.where(~X.contains_any(line, tokens))


def platform_rules(rules: DataFrame, body="body", tokens=fixed.PLATFORM_TOKENS) -> DataFrame:
    """Drop whole rules that name another platform in any line."""
    return rules.where(~X.contains_any(body, tokens))


def deny_reason(file_name="file_name", body="body") -> Column:
    """Why a rule file is disabled; null for an active one."""
    name, text = X.col(file_name), X.col(body)
    bad_include = F.startswith(text, F.lit(fixed.BAD_INCLUDE)) | F.contains(text, F.lit("\n" + fixed.BAD_INCLUDE))
    return (
        F.when(F.startswith(name, F.lit(fixed.DENIED_PREFIX)) & F.endswith(name, F.lit(".yar")), "android")
        .when(name.isin(fixed.DENIED_GENERIC), "generic")
        .when(name.isin(fixed.DENIED_INDEX) & bad_include, "index")
    )


def deny_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active rules, disabled rules with their reason)."""
    marked = rules.withColumn("reason", deny_reason())
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def threshold_level(n) -> Column:
    n = X.col(n)
    return F.when(n > fixed.CRITICAL_ABOVE, "critical").when(n > fixed.WARNING_ABOVE, "warning").otherwise("clean")


def alert_level(line) -> Column:
    """0 for a decoded line, 12 when it reports a threat, null for other lines."""
    line = X.bare_alert(line)
    decoded = F.startswith(line, F.lit(fixed.ALERT_PREFIX))
    return (
        F.when(decoded & F.contains(line, F.lit(fixed.ALERT_PHRASE)), F.lit(fixed.ALERT_LEVEL))
        .when(decoded, F.lit(0))
        .cast("int")
    )


def alert_group(line) -> Column:
    return F.when(alert_level(line) == fixed.ALERT_LEVEL, fixed.ALERT_GROUP)


def severity_route(df: DataFrame, severity="severity") -> DataFrame:
    """Adds the array of actions for a severity; an unknown one gets none."""
    actions = F.create_map(
        *[x for s, a in fixed.SEVERITY_ACTIONS for x in (F.lit(s), F.array(*[F.lit(v) for v in a]))]
    )
    found = F.try_element_at(actions, F.lower(X.col(severity)))
    return df.withColumn("actions", F.coalesce(found, F.array().cast("array<string>")))


def report_class(threats, quarantined) -> Column:
    return F.when(X.col(threats) > 0, "threats").when(X.col(quarantined) > 0, "quarantine").otherwise("clean")


def issue_list(components=fixed.COMPONENTS) -> Column:
    """The issues of a process snapshot: service_active, process_count and one column `<component>_kb` each, null when not running."""
    found = [F.when(~F.col("service_active"), "Service not active")]
    for name in components:
        kb = F.col(f"{name}_kb")
        over = X.int_div(kb, F.lit(1024)) > fixed.MAX_MEMORY_MB
        found.append(F.when(kb.isNull(), f"{name} not running").when(over, f"{name} memory exceeded"))
    many = F.concat(F.lit("Too many processes: "), F.col("process_count").cast("string"))
    found.append(F.when(F.col("process_count") > fixed.MAX_PROCESSES, many))
    return F.array_compact(F.array(*found))


def issues(snapshots: DataFrame, components=fixed.COMPONENTS) -> DataFrame:
    """(host, issue) rows of process snapshots."""
    return snapshots.select("host", F.explode(issue_list(components)).alias("issue"))
