"""Look-ups and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigward import session
from sigward.functions import fixed
from sigward.functions import scalars as X
from sigward.operators import matching, windows


def display_name(rule="rule_name", globs: bool = False) -> Column:
    """Display name of a rule: a fixed name, with `globs` also a fixed glob, else the rule name itself."""
    rule = X.col(rule)
    exact = X.map_lookup(X.literal_map(fixed.DISPLAY_NAMES), rule)
    rest = X.glob_case(rule, fixed.DISPLAY_GLOBS, rule) if globs else rule
    return F.coalesce(exact, rest)


def threat_description(rule="rule_name") -> Column:
    """Description by the first word of the ordered list that occurs in the rule name."""
    globs = [(f"*{word}*", text) for word, text in fixed.THREAT_DESCRIPTIONS]
    return X.glob_case(X.default_value(rule, "Unknown"), globs, fixed.DEFAULT_DESCRIPTION)


def quarantine_detail(items: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Quarantine items with their sidecar fields; without sidecar the item speaks for itself.

    items: q_path, name, mtime, content, size_bytes. sidecars: q_path, orig_path, rule_name, q_time, sha256 (text).
    """
    side = sidecars.select("q_path", "orig_path", "rule_name", "q_time", "sha256", F.lit(True).alias("has_sidecar"))
    has = F.col("has_sidecar").isNotNull()
    # What the item says about itself is worked out before the join, so that no content is shuffled.
    own = items.select(
        "q_path", "name", "size_bytes", F.date_format("mtime", "yyyy-MM-dd HH:mm:ss").alias("own_time"),
        X.sha256_short("content").alias("own_hash"),
    )
    return own.join(side, "q_path", "left").select(
        "q_path",
        F.when(has, F.col("orig_path")).otherwise(F.substring_index("name", ".", 1)).alias("orig_path"),
        F.when(has, F.col("rule_name")).otherwise("Unknown").alias("rule_name"),
        F.when(has, F.col("q_time")).otherwise(F.col("own_time")).alias("q_time"),
        F.when(has, F.substring("sha256", 1, 16)).otherwise(F.col("own_hash")).alias("sha256_short"),
        X.human_size("size_bytes").alias("size"),
    )


def attribute_detection(items: DataFrame, log: DataFrame, matches: DataFrame) -> DataFrame:
    """Adds `detection`: from the log, else a rule match, else a content marker, else the file name, else Unknown.

    log: path, rule_name. matches: rule_name, path. Several names for a file: the smallest one. The content is
    tested before the joins and dropped, so it is not shuffled.
    """
    logged = log.groupBy("path").agg(F.min("rule_name").alias("_log"))
    matched = matches.groupBy("path").agg(F.min("rule_name").alias("_rule"))
    by_name = F.when(X.contains_ci("name", "eicar"), "EICAR Test")
    slim = items.withColumn("_own", F.coalesce(matching.marker_name("content"), by_name)).drop("content")
    found = F.coalesce(F.col("_log"), X.friendly_threat("_rule"), F.col("_own"), F.lit("Unknown"))
    joined = slim.join(logged, "path", "left").join(matched, "path", "left")
    return joined.withColumn("detection", found).drop("_log", "_rule", "_own")


def asof_detection(items: DataFrame, detections: DataFrame) -> DataFrame:
    """Items with the last detection of their host at or before their time."""
    return windows.asof_join(items, detections, ["event_id", "threat"])


def ancestors(path="path") -> Column:
    """A path and all directories above it."""
    parts = F.split(X.col(path), "/")
    depth = F.size(parts)
    return F.when(depth >= 2, F.transform(F.sequence(F.lit(2), depth), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def dir_coverage(monitored: DataFrame, file_entry: DataFrame) -> DataFrame:
    """Files at or below each monitored directory; directories without files stay with 0.

    A path is turned into its ancestors, so the prefix test is an equi-join and not a comparison of all pairs. Few
    directories are shipped to the paths; many are met after the paths have been counted per ancestor, so that a
    directory that holds most files is one row per task.
    """
    dirs = monitored.select("dir").distinct()
    above = file_entry.select(F.explode(ancestors()).alias("dir"))
    if session.fits_broadcast(dirs, "dir"):
        above = above.join(F.broadcast(dirs), "dir", "left_semi")
    counts = above.groupBy("dir").agg(F.count(F.lit(1)).alias("files"))
    return monitored.join(counts, "dir", "left").withColumn("files", F.coalesce("files", F.lit(0)))


def still_present(matches: DataFrame, files: DataFrame) -> DataFrame:
    return matches.join(files.select("path"), "path", "left_semi")


def missing_required(required: DataFrame, present: DataFrame, keys) -> DataFrame:
    # Distinct first: copies of a key are combined per task and never meet in one.
    return required.join(present.select(*keys).distinct(), list(keys), "left_anti")


def category_test(pattern: str, text="body") -> Column:
    plain = pattern.replace("_", "").isalnum()
    return F.contains(X.col(text), F.lit(pattern)) if plain else X.col(text).rlike(pattern)


def rule_category(rules: DataFrame, text="rule_name") -> DataFrame:
    """One row per rule and category its text falls into; a rule may have several or none."""
    labels = [F.when(category_test(p, text), name) for name, p in fixed.CATEGORIES]
    return rules.withColumn("category", F.explode(F.array_compact(F.array(*labels))))


def decode_alert(lines: DataFrame, line="value") -> DataFrame:
    """threat_name and file_path of decoded alert lines, with a time stamp before them or not; other lines are dropped."""
    text = X.bare_alert(line)
    threat = F.regexp_extract(text, fixed.ALERT_PATTERN, 1)
    path = F.regexp_extract(text, fixed.ALERT_PATTERN, 2)
    wanted = F.startswith(text, F.lit(fixed.ALERT_PREFIX)) & (threat != "")
    return lines.where(wanted).withColumns({"threat_name": threat, "file_path": path})


def new_rules(incoming: DataFrame, active: DataFrame) -> DataFrame:
    """Rules of a new feed whose name is not active yet."""
    return incoming.join(active.select("rule_name").distinct(), "rule_name", "left_anti")


def version_check(hosts: DataFrame, reports: DataFrame) -> DataFrame:
    """(host, status): unreachable, no scripts, ok or outdated.

    hosts: host, expected_version. reports: host, main_version, common_version, scripts of the hosts that answered.
    """
    joined = hosts.join(reports, "host", "left")
    ok = (
        (F.col("main_version") == F.col("expected_version"))
        & (F.col("common_version") == F.col("expected_version"))
        & (F.col("scripts") > fixed.EXPECTED_SCRIPTS_ABOVE)
    )
    status = (
        F.when(F.col("scripts").isNull(), "unreachable")
        .when(ok, "ok")
        .when(F.col("scripts") == 0, "no scripts")
        .otherwise("outdated")
    )
    return joined.select("host", status.alias("status"))
