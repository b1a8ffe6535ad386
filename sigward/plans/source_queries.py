"""Sources and sinks: data derived from the tables is written, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigward import session
from sigward.functions import scalars as X
from sigward.plans import views as V
from sigward.plans.registry import Tables, query
from sigward.sources import readers, sinks


def scratch(t: Tables, name: str) -> str:
    return session.scratch_dir(t.spark, name)


@query(
    "s1_scan_files",
    """SELECT source AS root, count(*) AS n_lines, CAST(sum(strlen(text) + 1) AS BIGINT) AS total_bytes
    FROM documents GROUP BY source""",
)
def s1_scan_files(t: Tables):
    """Documents as text files below two roots, found again by the recursive inventory; a third root is missing."""
    out = scratch(t, "files")
    lines = t.documents.select(F.translate("text", "\n\r", "  ").alias("value"), "source", "lang")
    english = F.col("lang") == "en"
    for root, part in ((f"{out}/en", lines.where(english)), (f"{out}/other", lines.where(~english))):
        part.drop("lang").write.partitionBy("source").text(root)
    found = readers.scan_files(t.spark, [f"{out}/en", f"{out}/other", f"{out}/missing"], "*.txt")
    lines = F.size(F.split(F.decode("content", "UTF-8"), "\n")) - 1
    root = F.regexp_extract("dir", "source=([^/]+)", 1)
    return found.groupBy(root.alias("root")).agg(
        F.sum(lines).alias("n_lines"), F.sum("size_bytes").alias("total_bytes")
    )


@query("s2_read_logs", f"WITH {V.LOGS} SELECT date_trunc('second', ts) AS ts, level, msg FROM logs")
def s2_read_logs(t: Tables):
    out = scratch(t, "logs")
    e = V.logs(t)
    colour = F.when(F.col("level") == "INFO", "\x1b[0;32m").otherwise("\x1b[1;33m")
    tag = F.concat(colour, F.lit("["), F.col("level"), F.lit("]\x1b[0m"))
    stamp = F.date_format("ts", "'['yyyy-MM-dd HH:mm:ss']'")
    e.select(F.concat_ws(" ", stamp, tag, "msg").alias("value")).write.text(out)
    return readers.read_logs(t.spark, out).select(V.ntz("ts").alias("ts"), "level", "msg")


@query("s2_parse_agent_log", f"WITH {V.LOGS} SELECT event_id, date_trunc('second', ts) AS ts, msg FROM logs")
def s2_parse_agent_log(t: Tables):
    """Agent log lines, whose dates are written with slashes."""
    lines = V.logs(t).select(
        "event_id", F.concat_ws(" ", F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), "msg").alias("value")
    )
    return readers.parse_log_lines(lines).select("event_id", V.ntz("ts").alias("ts"), "msg")


@query(
    "s3_read_alerts",
    f"""WITH {V.ALERTS} SELECT ts, CAST(k AS VARCHAR) AS id, 12 AS level, description, grp AS groups FROM alerts""",
)
def s3_read_alerts(t: Tables):
    out = scratch(t, "alerts")
    V.alert_json(t).write.text(out)
    r = F.col("rule")
    return readers.read_alerts(t.spark, out).select(
        V.ntz("timestamp").alias("ts"), r["id"].alias("id"), r["level"].alias("level"),
        r["description"].alias("description"), F.array_join(r["groups"], ",").alias("groups"),
    )


def directories(t: Tables):
    """`_VALUE` and `_realtime` of one settings element per page."""
    path = V.url_path()
    top = F.concat(F.lit("/"), F.get(F.split(path, "/"), F.lit(1)))
    live = F.when(F.col("page_id") % 3 == 0, "yes").otherwise("no")
    return t.pages.select(live.alias("_realtime"), F.concat(top, F.lit(", "), path, F.lit(" ,")).alias("_VALUE"))


def directories_xml(t: Tables):
    live = F.concat(F.lit('<directories realtime="'), F.col("_realtime"), F.lit('">'))
    return directories(t).select(F.concat(live, F.col("_VALUE"), F.lit("</directories>")).alias("value"))


MONITORED = f"""monitored AS (
  SELECT unnest([top, p]) AS dir, mode FROM (SELECT '/' || split_part(p, '/', 2) AS top, p, mode FROM (
    SELECT {V.URL_PATH} AS p, CASE WHEN page_id % 3 = 0 THEN 'realtime' ELSE 'scheduled' END AS mode FROM pages)))"""


@query("s4_read_monitored_dirs", f"WITH {MONITORED} SELECT dir, mode FROM monitored")
def s4_read_monitored_dirs(t: Tables):
    out = scratch(t, "settings")
    tags = {"rowTag": "directories", "rootTag": "agent_config"}
    directories(t).write.format("xml").options(**tags).save(out)
    return readers.read_monitored_dirs(t.spark, out)


PARSED_SQL = f"""WITH {V.CORPUS}
  SELECT rule_name, feed, condition,
    CASE condition WHEN 'filesize < 1KB' THEN NULL WHEN '2 of them' THEN 2 ELSE 1 END AS min_hits,
    CASE WHEN condition LIKE '$%' THEN condition END AS only_id, 2 AS n_strings, first_line AS first_pattern,
    '{{6D 61 6C}}' AS second_pattern, feed AS description, md5(body) AS body_md5
  FROM corpus"""


def parsed_columns(parsed):
    s = F.col("strings")
    return parsed.select(
        "rule_name", F.regexp_replace("feed", "^feed=", "").alias("feed"), "condition", "min_hits", "only_id",
        F.size(s).alias("n_strings"), F.get(s, F.lit(0))["pattern"].alias("first_pattern"),
        F.get(s, F.lit(1))["pattern"].alias("second_pattern"), F.col("meta")["description"].alias("description"),
        F.md5("body").alias("body_md5"),
    )


@query("s5_read_rules", PARSED_SQL)
def s5_read_rules(t: Tables):
    """Rule texts in one folder per feed, read as whole files and split into rules."""
    out = scratch(t, "rules")
    V.corpus(t).select("feed", F.col("text").alias("value")).write.partitionBy("feed").text(out)
    return parsed_columns(readers.read_rules(t.spark, out, name_glob="*.txt"))


@query("s5_parse_rules", PARSED_SQL)
def s5_parse_rules(t: Tables):
    return parsed_columns(readers.parse_rules(V.corpus(t), "text"))


FILE_ENTRY = f"""file_entry AS (SELECT {V.URL_PATH} AS path,
  CAST(1706659200 - (page_id % 3000) * 60 AS BIGINT) AS mtime FROM pages)"""


def file_entry(t: Tables):
    mtime = F.lit(1706659200) - (F.col("page_id") % 3000) * 60
    return t.pages.select(V.url_path().alias("path"), mtime.cast("bigint").alias("mtime"))


@query("s6_read_file_entry", f"WITH {FILE_ENTRY} SELECT path, mtime FROM file_entry")
def s6_read_file_entry(t: Tables):
    out = scratch(t, "file-entry")
    file_entry(t).write.parquet(out)
    return readers.read_file_entry(t.spark, out)


@query(
    "s7_read_sidecar",
    """SELECT doc_id, '/' || source || '/a:b_' || doc_id AS orig_path, 'Rule_' || lang AS rule_name,
      '2024-01-31 00:00:00' AS q_time, sha256(text) AS sha256 FROM documents""",
)
def s7_read_sidecar(t: Tables):
    """Sidecar texts whose values hold colons."""
    d = t.documents
    side = sinks.sidecar_text(
        F.format_string("/%s/a:b_%d", "source", "doc_id"), F.concat(F.lit("Rule_"), "lang"), V.as_of(), X.sha256_hex("text")
    )
    return readers.read_sidecar(d.select("doc_id", side.alias("text"))).drop("text")


@query("s8_read_restart_state", "SELECT event_id, date_trunc('second', ts) AS ts FROM events WHERE event_id % 3 <> 2")
def s8_read_restart_state(t: Tables):
    """State lines of three shapes: epoch, epoch with count, and broken ones."""
    sec = X.to_epoch("ts").cast("string")
    k = F.col("event_id") % 3
    line = F.when(k == 0, F.concat(sec, F.lit(":1"))).when(k == 1, sec).otherwise("broken:1")
    state = readers.read_restart_state(V.events(t).select("event_id", line.alias("value")))
    return state.select("event_id", V.ntz("ts").alias("ts"))


@query(
    "s9_first_column",
    r"""SELECT conv_id, turn, string_split_regex(regexp_replace(split_part(text, chr(10), 1), '^\s+|\s+$', '', 'g'),
      '\s+')[1] AS first_column FROM conversations""",
)
def s9_first_column(t: Tables):
    return readers.first_column(t.conversations, "text").select("conv_id", "turn", "first_column")


@query("s10_first_available", "SELECT doc_id, 2 AS priority FROM documents WHERE lang = 'de'")
def s10_first_available(t: Tables):
    """The first source (the feed itself) is empty, so the second one is taken whole."""
    d = t.documents.select("doc_id", "lang")
    sources = [(1, d.where("lang = 'api'")), (2, d.where("lang = 'de'")), (3, d.where("lang = 'fr'")), (4, d)]
    return readers.first_available(sources).select("doc_id", "priority")


@query(
    "s11_write_quarantine",
    f"""WITH {V.MATCHES}, {V.QUARANTINE}
    SELECT q_path, orig_path, rule_name, q_time, sha256, size_bytes, q_date FROM quarantine""",
)
def s11_write_quarantine(t: Tables):
    out = scratch(t, "quarantine")
    sinks.write_quarantine(V.quarantine(t), out)
    stored = t.spark.read.parquet(out)
    return stored.select("q_path", "orig_path", "rule_name", V.ntz("q_time").alias("q_time"), "sha256", "size_bytes", "q_date")


@query(
    "s12_write_alert_lines",
    f"""WITH {V.MATCHES}, {V.QUARANTINE}
    SELECT strftime(q_time, '%Y-%m-%d %H:%M:%S') || ' YARA: Threat detected - ' || rule_name || ' - File: '
      || orig_path || ' - Quarantined: ' || split_part(q_path, '/', 2) AS value FROM quarantine""",
)
def s12_write_alert_lines(t: Tables):
    out = scratch(t, "alert-lines")
    q = V.quarantine(t).select("q_time", "rule_name", F.col("orig_path").alias("path"), X.basename("q_path").alias("q_name"))
    sinks.write_alert_lines(q, out)
    return t.spark.read.text(out)


LOG_LINE = "'[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || level || '] ' || msg"


@query("s13_write_daily_log", f"WITH {V.LOGS} SELECT CAST(ts AS DATE) AS log_date, {LOG_LINE} AS value FROM logs")
def s13_write_daily_log(t: Tables):
    out = scratch(t, "daily-log")
    sinks.write_daily_log(V.logs(t), out)
    return t.spark.read.text(out).select("log_date", "value")


@query(
    "s14_compact_old_logs",
    f"""WITH {V.LOGS} SELECT CAST(ts AS DATE) AS log_date, {LOG_LINE} AS value FROM logs
    WHERE floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - ts) / 86400) BETWEEN 8 AND 29""",
)
def s14_compact_old_logs(t: Tables):
    out = scratch(t, "old-logs")
    sinks.compact_old_logs(V.logs(t), V.as_of(), out)
    return t.spark.read.text(out).select("log_date", "value")


@query("s14_compact_small_files", f"WITH {V.LOGS} SELECT CAST(ts AS DATE) AS log_date, count(*) AS n_lines, CAST(1 AS BIGINT) AS n_files FROM logs GROUP BY 1")
def s14_compact_small_files(t: Tables):
    """A log written in six runs has six small files a day, and one after they are joined."""
    out = scratch(t, "small-files")
    for i in range(6):
        sinks.write_daily_log(V.logs(t).where(F.col("event_id") % 6 == i), out)
    sinks.compact_small_files(t.spark, out, 64 << 20)
    rows = t.spark.read.text(out).select("log_date", F.col("_metadata.file_path").alias("file"))
    return rows.groupBy("log_date").agg(F.count("*").alias("n_lines"), F.count_distinct("file").alias("n_files"))


@query(
    "s13_look_up_days",
    f"""WITH {V.LOGS} SELECT CAST(ts AS DATE) AS log_date, level, count(*) AS n FROM logs
    WHERE CAST(ts AS DATE) IN (SELECT CAST(max(ts) AS DATE) FROM events WHERE event_type = 'error' GROUP BY user_id % 3) GROUP BY ALL""",
)
def s13_look_up_days(t: Tables):
    """Days found in another table prune the folders of a stored log when the plan runs."""
    out = scratch(t, "day-log")
    sinks.write_daily_log(V.logs(t), out)
    errors = V.events(t).where("event_type = 'error'").groupBy((F.col("user_id") % 3).alias("k")).agg(F.to_date(F.max("ts")).alias("day"))
    rows = readers.read_daily_logs(t.spark, out, errors.select("day"))
    return rows.groupBy("log_date", "level").agg(F.count("*").alias("n"))


def odd_alerts(t: Tables):
    ident, k = F.col("event_id").cast("string"), F.col("event_id") % 6
    shapes = [
        '{"timestamp": "2024-01-31 10:00:00", "rule": {"id": "%s", "lev', '{"rule": {"id": "%s", "level": "high"}}', '{"other": "%s"}',
        '{"rule": {"id": "%s", "level": 12, "groups": "yara"}}', '{"timestamp": "noon", "rule": {"id": "%s", "level": 3}}',
        '{"timestamp": "2024-01-31 10:00:00", "rule": {"id": "%s", "level": 7, "description": null, "groups": ["a", "b"]}, "more": [1]}',
    ]
    line = F.element_at(F.array(*[F.lit(s) for s in shapes]), (k + 1).cast("int"))
    return t.events.select("event_id", F.replace(line, F.lit("%s"), ident).alias("value"))


@query(
    "s3_alerts_of_any_shape",
    """SELECT event_id, CASE WHEN event_id % 6 NOT IN (0, 2) THEN CAST(event_id AS VARCHAR) END AS id,
      CASE event_id % 6 WHEN 3 THEN 12 WHEN 4 THEN 3 WHEN 5 THEN 7 END AS level, CASE WHEN event_id % 6 = 5 THEN 'a,b' END AS groups,
      CASE event_id % 6 WHEN 0 THEN 'broken line' WHEN 1 THEN 'wrong type: level' WHEN 2 THEN 'no rule' WHEN 3 THEN 'wrong type: groups'
        WHEN 4 THEN 'wrong type: timestamp' END AS reason FROM events""",
)
def s3_alerts_of_any_shape(t: Tables):
    r = F.col("rule")
    rows = readers.parse_alerts_of_any_shape(odd_alerts(t))
    return rows.select("event_id", r["id"].alias("id"), r["level"].alias("level"), F.array_join(r["groups"], ",").alias("groups"), "reason")


@query(
    "s15_snapshot_rules",
    f"WITH {V.CORPUS} SELECT '20240131_000000' AS snapshot, rule_no, rule_name, feed, md5(body) AS body_md5 FROM corpus",
)
def s15_snapshot_rules(t: Tables):
    out = scratch(t, "snapshot")
    sinks.snapshot_rules(V.corpus(t), out, V.as_of())
    saved = t.spark.read.option("basePath", out).schema(
        "rule_no BIGINT, rule_name STRING, feed STRING, body STRING, snapshot STRING"
    ).parquet(out)
    return saved.select("snapshot", "rule_no", "rule_name", "feed", F.md5("body").alias("body_md5"))
