"""Aggregations and ordered logic."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigward.functions import fixed
from sigward.functions import scalars as X
from sigward.operators import aggregates, chains, filters, windows
from sigward.plans import views as V
from sigward.plans.filter_queries import ISSUES, LINES, REASON
from sigward.plans.match_queries import fleet
from sigward.plans.registry import ORACLES, Tables, query
from sigward.plans.source_queries import MONITORED, directories_xml
from sigward.sources import readers


@query(
    "a1_scan_totals",
    f"""WITH {V.MATCHES} SELECT count(*) AS matches, count(DISTINCT path) AS files, count(DISTINCT rule_name) AS rules
    FROM matches""",
)
def a1_scan_totals(t: Tables):
    return aggregates.scan_totals(V.matches(t))


@query("a2_threat_distribution", f"WITH {V.MATCHES} SELECT rule_name, count(*) AS matches FROM matches GROUP BY 1 ORDER BY 2 DESC, 1")
def a2_threat_distribution(t: Tables):
    return aggregates.threat_distribution(V.matches(t))


PARTS = 10


@query("a3_files_per_rule", f"WITH {V.MATCHES} SELECT rule_name, path, count(*) OVER (PARTITION BY rule_name) AS n_files FROM matches")
def a3_files_per_rule(t: Tables):
    return aggregates.files_per_rule(V.matches(t))


@query(
    "a3_files_per_rule_short",
    f"""WITH {V.MATCHES}, placed AS (SELECT rule_name, path, CAST('0x' || md5(path)[1:8] AS BIGINT) % {PARTS} AS part FROM matches)
    SELECT rule_name, part, CAST({PARTS} AS BIGINT) AS parts, count(*) AS n_files, string_agg(path, '|' ORDER BY path) AS files
    FROM placed GROUP BY ALL""",
)
def a3_files_per_rule_short(t: Tables):
    """The lists as texts, each rule's in so many parts."""
    return aggregates.file_lists(V.matches(t), PARTS)


@query("a4_rule_per_file", f"WITH {V.MATCHES} SELECT path, max(rule_name) AS rule_name FROM matches GROUP BY path")
def a4_rule_per_file(t: Tables):
    return aggregates.rule_per_file(V.matches(t))


def category_sql(source: str, text: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS category, count(*) FILTER (regexp_matches({text}, {V.quote(p)})) AS rules FROM {source}"
        for name, p in fixed.CATEGORIES
    )


@query("a5_category_counts", f"WITH {V.CORPUS} {category_sql('corpus', 'body')}")
def a5_category_counts(t: Tables):
    return aggregates.category_counts(V.corpus(t))


@query(
    "a5_category_counts_lines",
    f"WITH {V.CORPUS}, rule_lines AS (SELECT unnest(string_split(body, chr(10))) AS line FROM corpus) "
    + category_sql("rule_lines", "line"),
)
def a5_category_counts_lines(t: Tables):
    """As a line count, the way grep does it."""
    lines = windows.document_lines(V.corpus(t), "rule_no", "body")
    return aggregates.category_counts(lines, "line")


SUMMARY = ", ".join(
    f"CASE WHEN count(*) FILTER (regexp_matches(body, {V.quote(dict(fixed.CATEGORIES)[n])})) > 0 THEN "
    f"count(*) FILTER (regexp_matches(body, {V.quote(dict(fixed.CATEGORIES)[n])})) || ' {label}' END"
    for n, label in fixed.SUMMARY_LABELS
)


@query(
    "a6_category_summary",
    f"WITH {V.CORPUS} SELECT count(*) || ' rules (' || concat_ws(', ', {SUMMARY}) || ')' AS summary FROM corpus",
)
def a6_category_summary(t: Tables):
    return aggregates.category_summary(V.corpus(t))


FEEDS = " UNION ALL ".join(
    [f"SELECT '{f}' AS feed, count(*) FILTER (starts_with(file_name, '{p}') AND suffix(file_name, '.yar')) AS files FROM corpus"
     for f, p in fixed.FEED_PREFIXES]
    + [f"SELECT '{f}', count(*) FILTER (contains(lower(file_name), '{w}')) FROM corpus" for f, w in fixed.FEED_WORDS]
    + ["SELECT 'Total', count(*) FILTER (suffix(file_name, '.yar')) FROM corpus"]
)


@query("a7_feed_counts", f"WITH {V.CORPUS} SELECT feed, files FROM ({FEEDS}) WHERE files > 0 OR feed = 'Total'")
def a7_feed_counts(t: Tables):
    return aggregates.feed_counts(V.corpus(t))


@query("a8_rule_count", f"WITH {V.CORPUS} SELECT count(*) AS n, 'rules' AS unit FROM corpus WHERE {REASON} IS NULL")
def a8_rule_count(t: Tables):
    active, _ = filters.deny_rules(V.corpus(t).withColumn("body", F.col("text")))
    lines = windows.document_lines(active, "rule_no", "body")
    return aggregates.rule_count(lines, active)


@query(
    "a8_rule_count_files",
    f"WITH {V.CORPUS} SELECT count(DISTINCT file_name) AS n, 'files' AS unit FROM corpus",
)
def a8_rule_count_files(t: Tables):
    """No merged set yet: rule files are counted."""
    files = V.corpus(t).select("file_name").distinct()
    no_lines = windows.document_lines(V.corpus(t), "rule_no", "body").where("line IS NULL")
    return aggregates.rule_count(no_lines, files)


def daily_sql(condition: str) -> str:
    return f"""WITH {V.LOGS}, days AS (SELECT CAST(unnest(range(DATE '2024-01-24', DATE '2024-01-31',
        INTERVAL 1 DAY)) AS DATE) AS day), counts AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM logs
      WHERE {condition} GROUP BY 1)
    SELECT day, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER () AS BIGINT) AS total
    FROM days LEFT JOIN counts USING (day)"""


ANY_CHANGE = "(" + " OR ".join(f"contains(msg, {V.quote(w)})" for w in fixed.CHANGE_WORDS) + ")"


@query("a10_daily_change_counts", daily_sql(ANY_CHANGE))
def a10_daily_change_counts(t: Tables):
    return aggregates.daily_change_counts(V.logs(t), V.LAST_DAY)


@query("a11_weekly_detections", daily_sql("contains(msg, 'THREAT DETECTED')"))
def a11_weekly_detections(t: Tables):
    return aggregates.weekly_detections(V.logs(t), V.LAST_DAY)


@query(
    "a12_scan_trigger_sum",
    f"""WITH {V.LOGS}, per_log AS (SELECT log_file, max(ts) AS mtime, count(*) FILTER (action = 'scan_started') AS scans
      FROM logs GROUP BY log_file)
    SELECT count(*) AS logs, CAST(coalesce(sum(scans), 0) AS BIGINT) AS scans FROM per_log
    WHERE floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - mtime) / 86400) < 1""",
)
def a12_scan_trigger_sum(t: Tables):
    """Logs with a line of the last day; all of them have one within a week."""
    return aggregates.scan_trigger_sum(V.logs(t), V.as_of(), 1)


@query(
    "a13_activity_24h",
    f"""WITH {V.LOGS}, {V.ALERTS}, l AS (SELECT count(*) FILTER ({ANY_CHANGE}) AS changed,
        count(*) FILTER (action = 'scan_started') AS scans, count(*) FILTER (contains(msg, 'THREAT DETECTED')
        OR regexp_matches(msg, 'rule.*matched')) AS hits FROM logs WHERE CAST(ts AS DATE) = DATE '2024-01-30'),
      a AS (SELECT count(*) FILTER (grp = 'yara') AS hits FROM alerts WHERE CAST(ts AS DATE) = DATE '2024-01-30')
    SELECT changed AS files_changed, scans, l.hits + a.hits AS detections, CAST(0 AS BIGINT) AS test_file_hits FROM l, a""",
)
def a13_activity_24h(t: Tables):
    return aggregates.activity_24h(V.logs(t), V.alerts(t), V.LAST_DAY)


@query(
    "a14_response_totals",
    f"""WITH {V.LOGS} SELECT count(*) FILTER (action = 'scan_started') AS scans,
      count(*) FILTER (contains(msg, 'THREAT DETECTED')) AS detections,
      count(*) FILTER (contains(msg, 'File quarantined')) AS quarantined FROM logs""",
)
def a14_response_totals(t: Tables):
    return aggregates.response_totals(V.logs(t))


@query(
    "a15_quarantine_summary",
    f"""WITH {V.MATCHES}, {V.QUARANTINE} SELECT count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes,
      min(q_time) AS oldest, min(ROW(q_time, q_path))[2] AS oldest_path FROM quarantine""",
)
def a15_quarantine_summary(t: Tables):
    return aggregates.quarantine_summary(V.quarantine(t)).withColumn("oldest", V.ntz("oldest"))


@query(
    "a16_monitor_mode",
    f"""WITH {MONITORED} SELECT dir, CASE WHEN bool_or(mode = 'realtime') THEN 'realtime' ELSE 'scheduled' END AS mode
    FROM monitored GROUP BY dir""",
)
def a16_monitor_mode(t: Tables):
    xml = directories_xml(t)
    rows = xml.select(X.xml_body("value", "directories").alias("body"), X.xml_attr("value", "realtime").alias("realtime"))
    return aggregates.monitor_mode(readers.explode_monitored(rows))


@query(
    "a17_fleet_totals",
    f"""SELECT count(*) FILTER (status IN ('clean', 'threats')) AS hosts_scanned,
      CAST(sum(threats) AS BIGINT) AS threats_total FROM ({ORACLES['m7_fleet_scan']})""",
)
def a17_fleet_totals(t: Tables):
    return aggregates.fleet_totals(fleet(t))


WEEKLY = """100 - 20 * CAST(floor(cpu) > 80 AS INTEGER) - 20 * CAST(floor(mem) > 80 AS INTEGER)
  - 20 * CAST(floor(disk) > 80 AS INTEGER) - 10 * CAST(detections > 10 AS INTEGER)"""


@query(
    "a18_health_score_weekly",
    f"""WITH {V.METRICS} SELECT host, score, CASE WHEN score >= 80 THEN 'EXCELLENT' WHEN score >= 60 THEN 'GOOD'
      ELSE 'WARNING' END AS health FROM (SELECT host, {WEEKLY} AS score FROM metrics)""",
)
def a18_health_score_weekly(t: Tables):
    return aggregates.health_score(V.metrics(t), "weekly").select("host", "score", "health")


STATUS = """100 - 30 * CAST(host % 5 = 0 AS INTEGER) - 30 * CAST(host % 7 = 0 AS INTEGER)
  - 20 * CAST(host % 11 = 0 AS INTEGER) - 10 * CAST(floor(cpu) > 80 AS INTEGER) - 10 * CAST(floor(disk) > 80 AS INTEGER)"""


@query(
    "a19_health_score_status",
    f"""WITH {V.METRICS} SELECT host, score, CASE WHEN score >= 80 THEN 'EXCELLENT' WHEN score >= 60 THEN 'GOOD'
      WHEN score >= 40 THEN 'WARNING' ELSE 'CRITICAL' END AS health FROM (SELECT host, {STATUS} AS score FROM metrics)""",
)
def a19_health_score_status(t: Tables):
    return aggregates.health_score(status_metrics(t), "status").select("host", "score", "health")


def status_metrics(t: Tables):
    host = F.col("host")
    return V.metrics(t).withColumns(
        {"engine_ok": host % 5 != 0, "agent_ok": host % 7 != 0, "rules": F.when(host % 11 == 0, 0).otherwise(5)}
    )


ADVICE = " UNION ALL ".join(
    f"SELECT host, {V.quote(text)} AS advice FROM metrics WHERE {test}"
    for test, text in [
        ("floor(cpu) > 80", fixed.ADVICE_CPU), ("floor(disk) > 80", fixed.ADVICE_DISK),
        ("detections > 0", fixed.ADVICE_DETECTIONS), ("changes > 100", fixed.ADVICE_CHANGES),
        *[("true", text) for text in fixed.ADVICE_ALWAYS],
    ]
)


@query("a20_recommendations", f"WITH {V.METRICS} {ADVICE}")
def a20_recommendations(t: Tables):
    return aggregates.recommendations(V.metrics(t))


STATUS_ADVICE = " UNION ALL ".join(
    f"SELECT host, {V.quote(text)} AS advice FROM low WHERE {test}"
    for test, text in [
        ("host % 5 = 0", fixed.STATUS_ENGINE), ("host % 7 = 0", fixed.STATUS_AGENT), ("host % 11 = 0", fixed.STATUS_RULES),
        ("floor(cpu) > 80", fixed.STATUS_CPU), ("floor(disk) > 80", fixed.STATUS_DISK),
    ]
)


@query("a20_recommendations_status", f"WITH {V.METRICS}, low AS (SELECT * FROM metrics WHERE {STATUS} < 80) {STATUS_ADVICE}")
def a20_recommendations_status(t: Tables):
    return aggregates.recommendations(status_metrics(t), "status")


@query(
    "a21_top_detections",
    f"""WITH {V.ALERTS} SELECT description, count(*) AS alerts FROM alerts WHERE grp = 'yara' GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 10""",
)
def a21_top_detections(t: Tables):
    return aggregates.top_detections(V.alerts(t))


@query(
    "a22_threat_trend",
    f"""WITH {V.ALERTS} SELECT CAST(ts AS DATE) AS day, count(*) AS threats FROM alerts WHERE grp = 'yara'
      AND ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY GROUP BY 1""",
)
def a22_threat_trend(t: Tables):
    return aggregates.threat_trend(V.alerts(t), V.AS_OF)


@query(
    "a23_detection_kpis",
    f"""WITH {V.MATCHES}, {V.CORPUS}, hit AS (SELECT DISTINCT path FROM matches), truth AS (SELECT toxic, hit.path IS NOT NULL AS h
      FROM labels JOIN files USING (doc_id) LEFT JOIN hit USING (path)), c AS (SELECT count(*) FILTER (toxic = 1) AS known,
      count(*) FILTER (toxic = 1 AND h) AS detected, count(*) FILTER (h) AS alerts,
      count(*) FILTER (toxic <> 1 AND h) AS false_alerts FROM truth)
    SELECT known, detected, round(detected / known, 6) AS detection_rate,
      round(false_alerts / alerts, 6) AS false_positive_rate,
      (SELECT round(count(*) FILTER ({REASON} IS NULL) / count(*), 6) FROM corpus) AS rule_coverage FROM c""",
)
def a23_detection_kpis(t: Tables):
    truth = t.labels.join(V.files(t).select("doc_id", "path"), "doc_id").select("path", "toxic")
    reason = filters.deny_reason("file_name", "text")
    rules = V.corpus(t).select("rule_name", reason.isNull().alias("active"))
    return aggregates.detection_kpis(V.matches(t), truth, rules)


@query(
    "a24_response_latency",
    f"""WITH {V.LOGS}, e AS (SELECT host, action, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM logs),
      q AS (SELECT DISTINCT host, sec FROM e WHERE action = 'file_quarantined'),
      p AS (SELECT q.sec - d.sec AS wait FROM (SELECT * FROM e WHERE action = 'threat_detected') d
        ASOF JOIN q ON d.host = q.host AND d.sec <= q.sec)
    SELECT count(*) AS pairs, round(avg(wait), 3) AS avg_seconds,
      round(count(*) FILTER (wait < 3600) / count(*), 6) AS share_fast FROM p""",
)
def a24_response_latency(t: Tables):
    """Share within an hour: the events are too far apart for five seconds."""
    e = V.logs(t).select("host", "ts", "action")
    detected, stored = e.where("action = 'threat_detected'"), e.where("action = 'file_quarantined'")
    return aggregates.response_latency(detected, stored, 3600)


@query(
    "a25_mem_pct",
    """SELECT user_id, round(sum(CAST(value * 100 AS BIGINT)) FILTER (event_type = 'error')
      / sum(CAST(value * 100 AS BIGINT)) * 100.0, 1) AS pct FROM (SELECT user_id, event_type, round(value, 2) AS value
      FROM events) GROUP BY user_id""",
)
def a25_mem_pct(t: Tables):
    cents = F.round(F.round("value", 2) * 100).cast("bigint")
    used = F.sum(F.when(F.col("event_type") == "error", cents))
    sums = t.events.groupBy("user_id").agg(used.alias("used"), F.sum(cents).alias("total"))
    return sums.select("user_id", aggregates.pct("used", "total").alias("pct"))


CONV_LINES = "conv_lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations)"


def conv_lines(t: Tables):
    return t.conversations.select(F.explode(F.split("text", "\n")).alias("line"))


@query("a26_config_line_count", f"WITH {CONV_LINES} SELECT count(*) FILTER (regexp_matches(line, '^[0-9]')) AS n FROM conv_lines")
def a26_config_line_count(t: Tables):
    return aggregates.config_line_count(conv_lines(t))


@query(
    "a26_config_line_count_active",
    f"WITH {CONV_LINES} SELECT count(*) FILTER (regexp_matches(line, '^[^#]')) AS n FROM conv_lines",
)
def a26_config_line_count_active(t: Tables):
    return aggregates.config_line_count(conv_lines(t), "active")


# ---- ordered logic


@query(
    "w1_dedupe_first",
    f"""WITH {LINES} SELECT doc_id, pos, line FROM doc_lines
    QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) = 1""",
)
def w1_dedupe_first(t: Tables):
    lines = windows.document_lines(t.documents, "doc_id", "text")
    return windows.dedupe_first(lines, ["line"], ["doc_id", "pos"])


@query(
    "w2_dedupe_rules_by_name",
    f"""WITH {V.CORPUS} SELECT rule_name, feed, rule_no FROM corpus
    QUALIFY row_number() OVER (PARTITION BY rule_name ORDER BY priority, file_name, rule_no) = 1""",
)
def w2_dedupe_rules_by_name(t: Tables):
    rules = V.corpus(t).select("rule_name", "feed", "rule_no", "priority", "file_name")
    return windows.dedupe_rules(rules).select("rule_name", "feed", "rule_no")


@query(
    "w2_dedupe_rules_by_body",
    r"""WITH keyed AS (SELECT doc_id, source, sha256(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')) AS h
      FROM documents)
    SELECT doc_id AS rule_no, source AS feed FROM keyed
    QUALIFY row_number() OVER (PARTITION BY h ORDER BY CAST(substr(source, 4) AS INTEGER), doc_id) = 1""",
)
def w2_dedupe_rules_by_body(t: Tables):
    """Exact copies among the documents, white space evened out."""
    d = t.documents.select(
        F.col("doc_id").alias("rule_no"), F.col("source").alias("feed"),
        F.substr("source", F.lit(4)).cast("int").alias("priority"), F.col("text").alias("body"),
    )
    return windows.dedupe_rules(d, "body", tie=("rule_no",)).select("rule_no", "feed")


@query(
    "w3_flatten_by_name",
    f"""WITH {V.CORPUS} SELECT file_name, feed, rule_no FROM corpus
    QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY priority, rule_no) = 1""",
)
def w3_flatten_by_name(t: Tables):
    rules = V.corpus(t).select("file_name", "feed", "rule_no", "priority")
    return windows.flatten_by_name(rules, tie=("rule_no",)).select("file_name", "feed", "rule_no")


@query(
    "w4_last_n",
    f"""WITH {V.LOGS} SELECT log_file, line_no, msg FROM logs
    QUALIFY row_number() OVER (PARTITION BY log_file ORDER BY line_no DESC) <= 5""",
)
def w4_last_n(t: Tables):
    return windows.last_n(V.logs(t).select("log_file", "line_no", "msg"), 5)


@query(
    "w4_last_n_conversations",
    """SELECT conv_id, turn, text FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""",
)
def w4_last_n_conversations(t: Tables):
    lines = t.conversations.select("conv_id", "turn", "text")
    return windows.last_n(lines, 3, ["conv_id"], ["turn"])


LOOK_BACK = f"""{V.RESTARTS}, counted AS (SELECT host, event_id, count(*) OVER (PARTITION BY host ORDER BY sec
  RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS restarts FROM restarts)"""


@query("w5_restarts_last_hour", f"WITH {LOOK_BACK} SELECT host, event_id, restarts FROM counted")
def w5_restarts_last_hour(t: Tables):
    return windows.restarts_last_hour(V.restarts(t)).select("host", "event_id", "restarts")


@query(
    "w6_restart_band",
    f"""WITH {LOOK_BACK} SELECT host, event_id, CASE restarts WHEN 0 THEN 'ok' WHEN 1 THEN 'warning' ELSE 'danger' END
      AS band, greatest(2 - restarts, 0) AS remaining FROM counted""",
)
def w6_restart_band(t: Tables):
    counted = windows.restarts_last_hour(V.restarts(t))
    return counted.select(
        "host", "event_id", windows.restart_band("restarts").alias("band"),
        windows.restarts_remaining("restarts").alias("remaining"),
    )


def limiter_sql(limit: int) -> str:
    """Row by row over each host: the last accepted seconds are carried along."""
    state = "a2 + 3600 < n.sec" if limit == 1 else "a1 + 3600 < n.sec"
    return f"""WITH RECURSIVE {V.RESTARTS}, n AS (SELECT host, event_id, sec,
        row_number() OVER (PARTITION BY host ORDER BY sec, ts, event_id) AS rn FROM restarts),
      walk AS (SELECT host, rn, event_id, true AS ok, CAST(-9999999999 AS BIGINT) AS a1, sec AS a2 FROM n WHERE rn = 1
        UNION ALL SELECT n.host, n.rn, n.event_id, {state},
          CASE WHEN {state} THEN a2 ELSE a1 END, CASE WHEN {state} THEN n.sec ELSE a2 END
        FROM walk JOIN n ON n.host = walk.host AND n.rn = walk.rn + 1)
    SELECT host, event_id FROM walk WHERE ok"""


@query("w7_limit_restarts", limiter_sql(2))
def w7_limit_restarts(t: Tables):
    return windows.limit_restarts(V.restarts(t)).select("host", "event_id")


@query("w8_suppress_alerts", limiter_sql(1))
def w8_suppress_alerts(t: Tables):
    return windows.suppress_alerts(V.restarts(t)).select("host", "event_id")


@query(
    "w9_latest_per_key",
    f"""WITH {V.LOGS}, hosts AS (SELECT c_custkey AS host FROM customer), latest AS (
      SELECT host, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM logs WHERE action = 'scan_started' GROUP BY host)
    SELECT host, coalesce(latest, 'Never') AS latest FROM hosts LEFT JOIN latest USING (host)""",
)
def w9_latest_per_key(t: Tables):
    scans = V.logs(t).where("action = 'scan_started'")
    return windows.latest_per_key(scans, ["host"], expected=V.fleet_hosts(t))


def walk_sql(name: str, source: str, limit: int) -> str:
    """CTEs that walk over the rows of a source host by host; `<name>_walk` has ok for each event."""
    state = "a2 + 3600 < n.sec" if limit == 1 else "a1 + 3600 < n.sec"
    return f"""{name} AS (SELECT host, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, row_number() OVER (PARTITION BY host ORDER BY floor(epoch(ts)), ts, event_id) AS rn FROM {source}),
      {name}_walk AS (SELECT host, rn, event_id, true AS ok, CAST(-9999999999 AS BIGINT) AS a1, sec AS a2 FROM {name} WHERE rn = 1
        UNION ALL SELECT n.host, n.rn, n.event_id, {state}, CASE WHEN {state} THEN a2 ELSE a1 END, CASE WHEN {state} THEN n.sec ELSE a2 END
        FROM {name}_walk w JOIN {name} n ON n.host = w.host AND n.rn = w.rn + 1)"""


@query(
    "c4_watchdog",
    f"""WITH RECURSIVE {V.SNAPSHOTS}, found AS ({ISSUES}),
      bad AS (SELECT user_id % 4 AS host, ts, e.event_id, count(*) AS n_issues FROM found f JOIN events e ON e.event_id = f.host GROUP BY ALL),
      {walk_sql("n", "bad", 2)}, refused AS (SELECT bad.* FROM bad JOIN n_walk w USING (event_id) WHERE NOT ok),
      {walk_sql("r", "refused", 1)}
    SELECT bad.host, bad.event_id, n_issues, CASE WHEN w.ok THEN 'restart' ELSE 'refused' END AS decision,
      CASE WHEN w.ok OR r.ok THEN 'sent' ELSE 'held back' END AS alert
    FROM bad JOIN n_walk w USING (event_id) LEFT JOIN r_walk r ON r.event_id = bad.event_id""",
)
def c4_watchdog(t: Tables):
    """Issues, restarts and alerts of process snapshots in one table."""
    seen = V.events(t).select("event_id", "ts", (F.col("user_id") % 4).alias("host"))
    snapshots = V.snapshots(t).withColumnRenamed("host", "event_id").join(seen, "event_id")
    rows = chains.watchdog(snapshots)
    return rows.select("host", "event_id", F.size("issues").cast("bigint").alias("n_issues"), "decision", "alert")


WEEK = "CAST(ts AS DATE) BETWEEN DATE '2024-01-24' AND DATE '2024-01-30'"
WEEK_ADVICE = " || ".join(
    [f"CASE WHEN {test} THEN {V.quote(text + '|')} ELSE '' END" for test, text in (
        ("floor(cpu) > 80", fixed.ADVICE_CPU), ("floor(disk) > 80", fixed.ADVICE_DISK), ("detections > 0", fixed.ADVICE_DETECTIONS), ("changes > 100", fixed.ADVICE_CHANGES))]
    + [V.quote("|".join(fixed.ADVICE_ALWAYS))]
)


@query(
    "c5_weekly_hosts",
    f"""WITH {V.LOGS}, {V.METRICS}, week AS (SELECT host, count(*) FILTER ({ANY_CHANGE}) AS changes, count(*) FILTER (action = 'scan_started') AS scans,
        count(*) FILTER (contains(msg, 'THREAT DETECTED')) AS detections FROM logs WHERE {WEEK} GROUP BY host),
      rows AS (SELECT m.host, cpu, mem, disk, coalesce(w.changes, 0) AS changes, coalesce(w.scans, 0) AS scans, coalesce(w.detections, 0) AS detections
        FROM metrics m LEFT JOIN week w ON m.host = w.host),
      scored AS (SELECT *, {WEEKLY} AS score FROM rows)
    SELECT host, changes, scans, detections, score, CASE WHEN score >= 80 THEN 'EXCELLENT' WHEN score >= 60 THEN 'GOOD' ELSE 'WARNING' END AS health,
      {WEEK_ADVICE} AS advice FROM scored""",
)
def c5_weekly_hosts(t: Tables):
    rows = chains.weekly_hosts(V.logs(t), V.metrics(t), V.LAST_DAY)
    return rows.withColumn("advice", F.array_join("advice", "|"))
