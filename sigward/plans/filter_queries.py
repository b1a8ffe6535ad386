"""Filters, predicates, limits, sets and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigward import session
from sigward.functions import fixed
from sigward.operators import aggregates, chains, filters, limits, matching, retention, sets, windows
from sigward.plans import views as V
from sigward.plans.registry import ORACLES, Tables, query
from sigward.plans.source_queries import FILE_ENTRY, file_entry

NOT_UNDER = "NOT (path = '{0}' OR starts_with(path, '{0}/'))"
DIRS = ["/src1", "/src2/en", "/src3/fr/doc_3.txt"]


@query("f1_exclude_dirs", f"WITH {V.FILES} SELECT path FROM files WHERE " + " AND ".join(NOT_UNDER.format(d) for d in DIRS))
def f1_exclude_dirs(t: Tables):
    """/src1 goes, /src10 stays."""
    return filters.exclude_dirs(V.files(t), DIRS).select("path")


@query(
    "f2_exclude_names",
    f"""WITH {V.INVENTORY} SELECT doc_id, name FROM inventory
    WHERE name NOT GLOB 'daily_scan_alert_*.html' AND name NOT GLOB 'yara_scan_*.html' AND name NOT GLOB 'test_*.html'
      AND name NOT GLOB '*.yar' AND name NOT GLOB '*.yara' AND name <> 'agentid_row.txt'""".replace(
        "name NOT GLOB", "NOT name GLOB"
    ),
)
def f2_exclude_names(t: Tables):
    return filters.exclude_names(V.inventory(t)).select("doc_id", "name")


@query(
    "f3_max_depth",
    """SELECT doc_id, path FROM (
      SELECT doc_id, '/' || source || repeat('/d', CAST(doc_id % 5 AS INTEGER)) || '/f_' || doc_id AS path FROM documents)
    WHERE len(string_split(path, '/')) - 1 <= 3""",
)
def f3_max_depth(t: Tables):
    deep = F.expr("repeat('/d', cast(doc_id % 5 as int))")
    path = F.concat(F.lit("/"), "source", deep, F.lit("/f_"), F.col("doc_id").cast("string"))
    return filters.max_depth(t.documents.select("doc_id", path.alias("path")), "/", 3)


@query(
    "f4_valid_match_lines",
    """SELECT doc_id, 'Rule_' || source AS rule_name, '/tmp/' || lang || '_' || doc_id AS path
    FROM documents WHERE doc_id % 6 >= 3""",
)
def f4_valid_match_lines(t: Tables):
    k = F.col("doc_id") % 6
    good = F.format_string("Rule_%s /tmp/%s_%d", "source", "lang", "doc_id")
    line = (
        F.when(k == 0, "")
        .when(k == 1, "warning: slow rule x")
        .when(k == 2, "OneField")
        .when(k == 3, F.concat(good, F.lit("\\n")))
        .when(k == 4, F.concat(good, F.lit("\r")))
        .otherwise(F.concat(F.lit("  "), good, F.lit("   ")))
    )
    return filters.parse_matches(t.documents.select("doc_id", line.alias("value")))


SHIP_AGE = f"floor(epoch(TIMESTAMP '{V.SHIP_AS_OF}' - l_shipdate) / 86400)"


def ship_as_of():
    return F.lit(V.SHIP_AS_OF).cast("timestamp")


@query(
    "f5_age_filter",
    f"SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE {SHIP_AGE} > 30 AND {SHIP_AGE} < 90",
)
def f5_age_filter(t: Tables):
    old = retention.age_filter(t.lineitem, "l_shipdate", ship_as_of(), "+", 30)
    return retention.age_filter(old, "l_shipdate", ship_as_of(), "-", 90).select(
        "l_orderkey", "l_linenumber", "l_shipdate"
    )


@query(
    "f5_age_filter_minutes",
    """SELECT event_id FROM events WHERE TIMESTAMP '2024-01-31 00:00:00' - ts > INTERVAL 60 MINUTE
    AND TIMESTAMP '2024-01-31 00:00:00' - ts < INTERVAL 2880 MINUTE""",
)
def f5_age_filter_minutes(t: Tables):
    old = retention.age_filter(V.events(t), "ts", V.as_of(), "+", 60, "minutes")
    return retention.age_filter(old, "ts", V.as_of(), "-", 2880, "minutes").select("event_id")


@query("f6_on_date", f"SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) = DATE '{V.LAST_DAY}'")
def f6_on_date(t: Tables):
    return filters.on_date(t.events, V.LAST_DAY).select("event_id", "ts")


ANY_CHANGE = " OR ".join(f"contains(msg, {V.quote(w)})" for w in fixed.CHANGE_WORDS)


@query("f7_contains_any", f"WITH {V.LOGS} SELECT event_id, msg FROM logs WHERE {ANY_CHANGE}")
def f7_contains_any(t: Tables):
    return filters.contains_any(V.logs(t), "msg", fixed.CHANGE_WORDS).select("event_id", "msg")


@query("f8_contains_ci", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def f8_contains_ci(t: Tables):
    return filters.contains_ci(t.documents, "text", "LICENSE").select("doc_id")


NO_PLATFORM = " AND ".join(f"NOT contains({{0}}, '{w}')" for w in fixed.PLATFORM_TOKENS)
LINES = """doc_lines AS (SELECT doc_id, CAST(unnest(range(len(parts))) AS INTEGER) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""


@query("f9_platform_lines", f"WITH {LINES} SELECT doc_id, pos, line FROM doc_lines WHERE {NO_PLATFORM.format('line')}")
def f9_platform_lines(t: Tables):
    return filters.platform_lines(windows.document_lines(t.documents, "doc_id", "text"))


@query("f9_platform_rules", f"WITH {V.CORPUS} SELECT rule_no, rule_name FROM corpus WHERE {NO_PLATFORM.format('body')}")
def f9_platform_rules(t: Tables):
    return filters.platform_rules(V.corpus(t)).select("rule_no", "rule_name")


REASON = """CASE WHEN file_name LIKE 'Android@_%.yar' ESCAPE '@' THEN 'android'
  WHEN file_name IN ('domain.yar', 'base64.yar', 'url.yar', 'base64_gz.yar') THEN 'generic'
  WHEN file_name IN ('packers_index.yar', 'maldocs_index.yar', 'index_w_mobile.yar')
    AND contains(head, 'include "./') THEN 'index' END"""


@query("f10_deny_rules_active", f"WITH {V.CORPUS} SELECT rule_no, file_name FROM corpus WHERE {REASON} IS NULL")
def f10_deny_rules_active(t: Tables):
    active, _ = filters.deny_rules(V.corpus(t).withColumn("body", F.col("text")))
    return active.select("rule_no", "file_name")


@query(
    "f10_deny_rules_disabled",
    f"WITH {V.CORPUS} SELECT rule_no, file_name, {REASON} AS reason FROM corpus WHERE {REASON} IS NOT NULL",
)
def f10_deny_rules_disabled(t: Tables):
    _, disabled = filters.deny_rules(V.corpus(t).withColumn("body", F.col("text")))
    return disabled.select("rule_no", "file_name", "reason")


UPDATED = f"""{V.CORPUS}, flat AS (SELECT * FROM corpus QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY priority, rule_no) = 1),
named AS (SELECT * FROM flat WHERE {REASON} IS NULL
  QUALIFY row_number() OVER (PARTITION BY rule_name ORDER BY priority, file_name, rule_no) = 1),
merged AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY regexp_replace(regexp_replace(
    regexp_replace(head || body, '^rule\\s+\\w+\\s*', ''), '\\s+', ' ', 'g'), '^ | $', '', 'g')
  ORDER BY priority, file_name, rule_no) = 1)"""


@query("c1_update_rules", f"WITH {UPDATED} SELECT rule_no, rule_name, feed, file_name FROM merged")
def c1_update_rules(t: Tables):
    merged, _, _ = chains.update_rules(V.corpus(t).withColumn("body", F.col("text")))
    return merged.select("rule_no", "rule_name", "feed", "file_name")


@query(
    "c1_update_rules_counts",
    f"""WITH {UPDATED} SELECT b AS before, a AS after, b - a AS removed
    FROM (SELECT count(*) AS b FROM corpus), (SELECT count(*) AS a FROM merged)""",
)
def c1_update_rules_counts(t: Tables):
    return chains.update_rules(V.corpus(t).withColumn("body", F.col("text")))[2]


@query("c1_update_rules_observed", ORACLES["c1_update_rules_counts"])
def c1_update_rules_observed(t: Tables):
    """The counts of the job that stores the merged rules."""
    rules = V.corpus(t).withColumn("body", F.col("text"))
    return chains.write_updated_rules(rules, session.scratch_dir(t.spark, "merged-rules"))


THREATS_BY_SOURCE = f"""{V.MATCHES}, counts AS (
  SELECT source, count(m.path) AS threats, count(DISTINCT m.path) AS quarantined
  FROM files f LEFT JOIN matches m USING (path) GROUP BY source)"""


def threats_by_source(t: Tables):
    source = F.get(F.split("path", "/"), F.lit(1)).alias("source")
    counts = V.matches(t).groupBy(source).agg(
        F.count(F.lit(1)).alias("threats"), F.count_distinct("path").alias("quarantined")
    )
    zero = F.lit(0)
    return t.documents.select("source").distinct().join(counts, "source", "left").select(
        "source", F.coalesce("threats", zero).alias("threats"), F.coalesce("quarantined", zero).alias("quarantined")
    )


@query(
    "f11_threshold_level",
    f"""WITH {THREATS_BY_SOURCE} SELECT source, threats,
      CASE WHEN threats > 10 THEN 'critical' WHEN threats > 5 THEN 'warning' ELSE 'clean' END AS level FROM counts""",
)
def f11_threshold_level(t: Tables):
    return threats_by_source(t).select("source", "threats", filters.threshold_level("threats").alias("level"))


ALERT_TEXT = """CASE WHEN k % 3 = 0 THEN 'YARA: Threat detected - R' || k || ' - File: /host/' || host || ' - Quarantined: q'
  WHEN k % 3 = 1 THEN 'YARA: started' ELSE 'Threat detected by other' END"""


def alert_texts(t: Tables):
    k = F.col("k")
    text = (
        F.when(k % 3 == 0, F.format_string("YARA: Threat detected - R%d - File: /host/%d - Quarantined: q", k, "host"))
        .when(k % 3 == 1, "YARA: started")
        .otherwise("Threat detected by other")
    )
    return V.logs(t).select("event_id", text.alias("value"))


@query(
    "f12_alert_level",
    f"""WITH {V.LOGS} SELECT event_id, CASE k % 3 WHEN 0 THEN 12 WHEN 1 THEN 0 END AS level,
      CASE k % 3 WHEN 0 THEN 'malware' END AS grp FROM logs""",
)
def f12_alert_level(t: Tables):
    return alert_texts(t).select(
        "event_id", filters.alert_level("value").alias("level"), filters.alert_group("value").alias("grp")
    )


SEVERITY = "list_extract(['critical', 'high', 'medium', 'low', 'none'], CAST(doc_id % 5 + 1 AS BIGINT))"


@query(
    "f13_severity_route",
    f"""SELECT doc_id, {SEVERITY} AS severity, CASE doc_id % 5 WHEN 0 THEN 'quarantine,kill,block,mail'
      WHEN 1 THEN 'quarantine,alert' WHEN 2 THEN 'alert,log' WHEN 3 THEN 'log' ELSE '' END AS actions FROM documents""",
)
def f13_severity_route(t: Tables):
    names = F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low", "none")])
    rows = t.documents.select("doc_id", F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")).alias("severity"))
    return filters.severity_route(rows).withColumn("actions", F.array_join("actions", ","))


@query(
    "f14_report_class",
    f"""WITH {THREATS_BY_SOURCE} SELECT source, CASE WHEN threats > 8 THEN 'threats'
      WHEN quarantined > 0 THEN 'quarantine' ELSE 'clean' END AS report_class FROM counts""",
)
def f14_report_class(t: Tables):
    """Sources with up to eight matches count as handled, so that all three classes occur."""
    new = F.when(F.col("threats") > 8, F.col("threats")).otherwise(0)
    return threats_by_source(t).select("source", filters.report_class(new, "quarantined").alias("report_class"))


ISSUES = " UNION ALL ".join(
    ["SELECT host, 'Service not active' AS issue FROM snapshots WHERE NOT service_active"]
    + [
        f"SELECT host, '{c} not running' FROM snapshots WHERE {c}_kb IS NULL UNION ALL "
        f"SELECT host, '{c} memory exceeded' FROM snapshots WHERE {c}_kb // 1024 > 3500"
        for c in fixed.COMPONENTS
    ]
    + ["SELECT host, 'Too many processes: ' || process_count FROM snapshots WHERE process_count > 100"]
)


@query("f15_resource_breach", f"WITH {V.SNAPSHOTS} {ISSUES}")
def f15_resource_breach(t: Tables):
    return filters.issues(V.snapshots(t))


# ---- limits


@query("l1_first_n", f"WITH {V.FILES} SELECT path, size_bytes FROM files ORDER BY path LIMIT 100")
def l1_first_n(t: Tables):
    return limits.first_n(V.files(t).select("path", "size_bytes"), 100)


@query(
    "l2_recent_quarantine",
    f"WITH {V.MATCHES}, {V.QUARANTINE} SELECT q_path, rule_name FROM quarantine ORDER BY q_path DESC LIMIT 20",
)
def l2_recent_quarantine(t: Tables):
    return limits.recent_quarantine(V.quarantine(t).select("q_path", "rule_name"))


@query(
    "l3_recent_changes",
    f"""WITH {FILE_ENTRY} SELECT path, make_timestamp(mtime * 1000000) AS ts FROM file_entry
    ORDER BY mtime DESC, path LIMIT 5""",
)
def l3_recent_changes(t: Tables):
    return limits.recent_changes(file_entry(t)).select("path", V.ntz("ts").alias("ts"))


@query(
    "l3_changed_since",
    f"WITH {FILE_ENTRY} SELECT count(*) AS changed FROM file_entry WHERE mtime > 1706659200 - 6 * 3600",
)
def l3_changed_since(t: Tables):
    return aggregates.changed_since(file_entry(t), V.as_of(), 6)


@query("l4_remaining_note", f"WITH {V.MATCHES} SELECT greatest(count(*) - 10, 0) AS remaining FROM matches")
def l4_remaining_note(t: Tables):
    return limits.remaining_note(V.matches(t))


@query("l5_newest_listing", f"WITH {V.FILES} SELECT name, mtime FROM files ORDER BY mtime DESC, path LIMIT 3")
def l5_newest_listing(t: Tables):
    return limits.newest_listing(V.files(t)).select("name", V.ntz("mtime").alias("mtime"))


@query(
    "l6_oldest",
    f"""WITH {V.MATCHES}, {V.QUARANTINE} SELECT q_time, orig_path AS path FROM quarantine
    ORDER BY q_time, orig_path LIMIT 1""",
)
def l6_oldest(t: Tables):
    q = V.quarantine(t).select("q_time", F.col("orig_path").alias("path"))
    return limits.oldest(q).select(V.ntz("q_time").alias("q_time"), "path")


# ---- sets


@query("u1_union_feeds", f"WITH {V.CORPUS} SELECT feed, rule_no, rule_name FROM corpus")
def u1_union_feeds(t: Tables):
    rules = V.corpus(t).select("rule_no", "rule_name", F.col("feed").alias("origin"))
    odd = F.substr("origin", F.lit(4)).cast("int") % 2
    halves = {"even": rules.where(odd == 0), "odd": rules.where(odd == 1)}
    return sets.union_feeds(halves).select(F.col("origin").alias("feed"), "rule_no", "rule_name")


@query("u2_union_scan_results", f"WITH {V.MATCHES} SELECT rule_name, path FROM matches")
def u2_union_scan_results(t: Tables):
    """One scan per root (language), results appended."""
    files, rules, strings = V.files(t), V.active_fixture(t), V.fixture_strings(t)
    english = F.col("lang") == "en"
    parts = [matching.scan(files.where(w), rules, strings) for w in (english, ~english)]
    return sets.union_scan_results(parts)


@query(
    "u3_union_restart_sources",
    f"""WITH {V.RESTARTS} SELECT host, event_id, CASE WHEN event_id % 2 = 0 THEN 'service' ELSE 'cron' END AS source
    FROM restarts""",
)
def u3_union_restart_sources(t: Tables):
    r = V.restarts(t).select("host", "event_id")
    even = F.col("event_id") % 2 == 0
    return sets.union_restart_sources(r.where(even), r.where(~even))


@query(
    "u4_rules_removed",
    f"""WITH {LINES}, before AS (SELECT line, count(*) AS n FROM doc_lines GROUP BY line)
    SELECT line, CAST(n - 1 AS BIGINT) AS copies FROM before WHERE n > 1""",
)
def u4_rules_removed(t: Tables):
    """What line de-duplication takes away, counted per line."""
    lines = windows.document_lines(t.documents, "doc_id", "text").select("line")
    return sets.rules_removed(lines, lines.distinct())


# ---- retention


@query(
    "r1_expire_counts",
    f"""SELECT count(*) AS before, count(*) FILTER ({SHIP_AGE} > 30) AS removed,
      count(*) FILTER ({SHIP_AGE} <= 30) AS remaining FROM lineitem""",
)
def r1_expire_counts(t: Tables):
    return retention.expire(t.lineitem, "l_shipdate", ship_as_of())[2]


@query("r1_expire_kept", f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE {SHIP_AGE} <= 30")
def r1_expire_kept(t: Tables):
    return retention.expire(t.lineitem, "l_shipdate", ship_as_of())[0].select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "r1_expire_stored",
    f"""WITH {V.LOGS} SELECT CAST(ts AS DATE) AS day, event_id, ts FROM logs
    WHERE floor(epoch(TIMESTAMP '2024-01-31 09:30:00' - ts) / 86400) <= 20""",
)
def r1_expire_stored(t: Tables):
    """A stored table after its expired rows are taken out; the limit falls within a day."""
    path = session.scratch_dir(t.spark, "stored-logs")
    rows = V.logs(t).select("event_id", "ts", F.to_date("ts").alias("day"))
    rows.hint("rebalance", "day").write.partitionBy("day").parquet(path)
    retention.expire_stored(t.spark, path, "ts", F.lit("2024-01-31 09:30:00").cast("timestamp"), 20)
    return t.spark.read.parquet(path).select("day", "event_id", V.ntz("ts").alias("ts"))


@query(
    "r2_tier",
    f"""SELECT tier, count(*) AS n, min(l_shipdate) AS first_day FROM (
      SELECT l_shipdate, CASE WHEN {SHIP_AGE} > 30 THEN 'expired' WHEN {SHIP_AGE} > 7 AND {SHIP_AGE} < 30 THEN 'compress'
        WHEN {SHIP_AGE} = 30 THEN 'boundary' ELSE 'hot' END AS tier FROM lineitem) GROUP BY tier""",
)
def r2_tier(t: Tables):
    tiers = retention.tier(t.lineitem.select("l_shipdate"), "l_shipdate", ship_as_of())
    return tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("first_day"))


# ---- before / after counts of an update


@query(
    "a9_before_after",
    f"""WITH {LINES} SELECT count(*) AS before, count(DISTINCT line) AS after,
      count(*) - count(DISTINCT line) AS removed FROM doc_lines""",
)
def a9_before_after(t: Tables):
    lines = windows.document_lines(t.documents, "doc_id", "text").select("line")
    return aggregates.before_after(lines, lines.distinct())
