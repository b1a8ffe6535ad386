"""Security data derived from the given tables: files, rules, logs, alerts, restarts, metrics, hosts.

Each view has the Spark form (a function of the tables) and the SQL form (a common table expression of the same
name), so that a query and its twin start from the same rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigward import session
from sigward.functions import fixed
from sigward.functions import scalars as X
from sigward.operators import filters, matching
from sigward.plans.registry import Tables
from sigward.sources import readers, sinks

AS_OF = "2024-01-31 00:00:00"
LAST_DAY = "2024-01-30"
SHIP_AS_OF = "2001-11-04 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def ntz(c):
    """Results carry times without zone."""
    return X.col(c).cast("timestamp_ntz")


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(name: str, columns: list[str], rows) -> str:
    """A common table expression over literal rows."""
    lit = lambda v: "NULL" if v is None else quote(v) if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


def case(column: str, pairs, default: str, like: str = "{}") -> str:
    """CASE with one branch per (pattern, value)."""
    whens = " ".join(f"WHEN {column} LIKE {quote(like.format(p))} THEN {quote(v)}" for p, v in pairs)
    return f"CASE {whens} ELSE {default} END"


# ---- files


def files(t: Tables) -> DataFrame:
    d = session.spread_small(t.documents)
    ident = F.col("doc_id").cast("string")
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/doc_"), ident, F.lit(".txt"))
    mtime = as_of() - F.make_dt_interval((F.col("doc_id") % 60).cast("int"))
    cols = readers.file_columns(path, "text", F.octet_length("text"), mtime)
    return d.select("doc_id", "source", "lang", *cols)


FILES = """files AS (
  SELECT doc_id, source, lang, '/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS path,
    'doc_' || doc_id || '.txt' AS name, '/' || source || '/' || lang AS dir,
    CAST(strlen(text) AS BIGINT) AS size_bytes,
    TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(doc_id % 60 AS INTEGER)) AS mtime, text AS content
  FROM documents)"""


def inventory(t: Tables) -> DataFrame:
    """Files with the names and places that the exclusion filters look at."""
    k = F.col("doc_id") % 10
    ident = F.col("doc_id").cast("string")
    name = (
        F.when(k == 0, F.concat(F.lit("daily_scan_alert_"), ident, F.lit(".html")))
        .when(k == 1, F.concat(F.lit("test_"), ident, F.lit(".html")))
        .when(k == 2, F.concat(F.lit("rule_"), ident, F.lit(".yar")))
        .when(k == 3, F.lit("agentid_row.txt"))
        .when(k == 4, F.concat(F.lit("yara_scan_"), ident, F.lit(".htm")))
        .otherwise(F.concat(F.lit("doc_"), ident, F.lit(".txt")))
    )
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), name)
    cols = readers.file_columns(path, "text", F.octet_length("text"), as_of())
    return t.documents.select("doc_id", *cols)


INVENTORY = """inventory AS (
  SELECT doc_id, '/' || source || '/' || lang || '/' || name AS path, name FROM (
    SELECT *, CASE doc_id % 10 WHEN 0 THEN 'daily_scan_alert_' || doc_id || '.html'
      WHEN 1 THEN 'test_' || doc_id || '.html' WHEN 2 THEN 'rule_' || doc_id || '.yar'
      WHEN 3 THEN 'agentid_row.txt' WHEN 4 THEN 'yara_scan_' || doc_id || '.htm'
      ELSE 'doc_' || doc_id || '.txt' END AS name FROM documents))"""


def url_path(url="url"):
    """Path part of a URL, without query and fragment."""
    return F.regexp_extract(X.col(url), r"^https?://[^/]+(/[^?#]*)", 1)


URL_PATH = r"regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)"


# ---- rules

# Rule fixture over tokens of the documents: name, condition, strings as (id, kind, pattern).
FIXTURE = [
    ("Linux_Trojan_Worthless", "$a", [("$a", "text", "worthless")]),
    (
        "Linux_Backdoor_Pair",
        "2 of them",
        [("$a", "text", "worthless"), ("$b", "text", "stupid"), ("$c", "text", "idiot")],
    ),
    (
        "Linux_Hacktool_License",
        "any of them",
        [("$a", "text", "License"), ("$b", "text", "GNU"), ("$c", "text", "MIT")],
    ),
    ("Linux_Exploit_Token", "$a", [("$a", "text", "token = ")]),
    ("Linux_Webshell_Script", "2 of them", [("$a", "text", "<script"), ("$b", "text", "<!--")]),
    ("Linux_Rootkit_Mail", "$a", [("$a", "text", "@mail")]),
    ("Linux_Ransomware_Hex", "$a", [("$a", "hex", "{77 6F 72 74 68 6C 65 73 73}")]),
    ("Android_Dropped", "$a", [("$a", "text", "the")]),
    ("Overlap", "2 of them", [("$a", "text", "less"), ("$b", "text", "worthless")]),
]


def needed(condition: str) -> int:
    return int(condition.split()[0]) if condition[0].isdigit() else 1


def local_table(t: Tables, columns: list[str], rows) -> DataFrame:
    """A few literal rows as a local relation: the driver can read them back without a job."""
    numbers = {"min_hits": pa.int32()}
    schema = pa.schema([(c, numbers.get(c, pa.string())) for c in columns])
    arrays = [pa.array(list(values), type=schema.field(c).type) for c, values in zip(columns, zip(*rows))]
    return t.spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))


def fixture_rules(t: Tables) -> DataFrame:
    rows = [(n, f"{n}.yar", "", c, needed(c), c if c.startswith("$") else None) for n, c, _ in FIXTURE]
    return local_table(t, ["rule_name", "file_name", "body", "condition", "min_hits", "only_id"], rows)


def fixture_strings(t: Tables) -> DataFrame:
    rows = [(n, i, k, p) for n, _, strings in FIXTURE for i, k, p in strings]
    return local_table(t, ["rule_name", "string_id", "kind", "pattern"], rows)


def text_of(kind: str, pattern: str) -> str:
    return bytes.fromhex(pattern.strip("{}")).decode() if kind == "hex" else pattern


RULES = values(
    "rules", ["rule_name", "min_hits", "only_id"],
    [(n, needed(c), c if c.startswith("$") else None) for n, c, _ in FIXTURE],
)
STRINGS = values(
    "rule_strings", ["rule_name", "string_id", "kind", "needle"],
    [(n, i, k, text_of(k, p)) for n, _, strings in FIXTURE for i, k, p in strings],
)


def hits_sql(source: str = "files") -> str:
    return f"""hits AS (SELECT f.path, s.rule_name, s.string_id FROM {source} f JOIN rule_strings s
  ON contains(f.content, s.needle))"""


# Deny-listed rules (Android_ prefix) never reach the scan.
MATCHES_OF_HITS = """matches AS (SELECT h.rule_name, h.path FROM hits h JOIN rules r USING (rule_name)
  WHERE h.rule_name NOT LIKE 'Android@_%' ESCAPE '@'
  GROUP BY h.rule_name, h.path, r.min_hits, r.only_id
  HAVING CASE WHEN r.only_id IS NOT NULL THEN bool_or(h.string_id = r.only_id)
    ELSE count(DISTINCT h.string_id) >= r.min_hits END)"""
MATCHES = ", ".join([FILES, RULES, STRINGS, hits_sql(), MATCHES_OF_HITS])


def active_fixture(t: Tables) -> DataFrame:
    active, _ = filters.deny_rules(fixture_rules(t))
    return active


def matches(t: Tables) -> DataFrame:
    return matching.scan(files(t), active_fixture(t), fixture_strings(t))


def item_strings(t: Tables) -> DataFrame:
    """One single-string rule per benchmark passage."""
    return t.benchmark.select(
        F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("rule_name"),
        F.lit("$a").alias("string_id"),
        F.lit("text").alias("kind"),
        F.col("text").alias("pattern"),
    )


ITEM_STRINGS = "rule_strings AS (SELECT 'item_' || item_id AS rule_name, '$a' AS string_id, text AS needle FROM benchmark)"

# Name stems of the derived corpus; each document becomes one rule of a feed (its source).
STEMS = [
    "Linux_Trojan_Agent",
    "Linux_Exploit_CVE",
    "Linux_Cryptominer_Pool",
    "Linux_Ransomware_Lock",
    "Linux_Rootkit_Hide",
    "Linux_Backdoor_Shell",
    "Linux_Webshell_Php",
    "Linux_Hacktool_Scan",
    "MAL_XZ_Backdoor",
    "EXPL_PwnKit",
    "BOT_Mirai",
    "Attack_SSH",
    "APT_Group",
    "Android_Dropper",
    "crime_malware",
    "Generic_Windows",
]
FILE_NAMES = ["domain.yar", "base64.yar", "packers_index.yar"]


def corpus(t: Tables) -> DataFrame:
    """rule_no, rule_name, feed, priority, file_name, first_line, body, active: one rule per document.

    Rule names repeat every 16 x 40 documents across feeds; some files carry deny-listed names.
    """
    n = F.col("doc_id")
    stem = F.element_at(F.array(*[F.lit(s) for s in STEMS]), ((n % 16) + 1).cast("int"))
    name = F.concat(stem, F.lit("_"), (n % 640).cast("string"))
    k = n % 25
    file_name = F.when(k == 0, FILE_NAMES[0]).when(k == 1, FILE_NAMES[1]).when(k == 2, FILE_NAMES[2]).otherwise(
        F.concat(name, F.lit(".yar"))
    )
    line = F.translate(F.substring_index("text", "\n", 1), '"\\', "")
    kind = n % 7
    condition = (
        F.when(kind == 0, "2 of them").when(kind == 1, "$b").when(kind == 2, "$zz").when(kind == 3, "filesize < 1KB")
        .otherwise("any of them")
    )
    head = F.when(k == 2, 'include "./packers.yar"\n').otherwise('import "elf"\n')
    body = F.concat(
        F.lit("rule "), name, F.lit(' {\n    meta:\n        description = "'), F.col("source"),
        F.lit('"\n        severity = "high"\n    strings:\n        $a = "'), line,
        F.lit('"\n        $b = {6D 61 6C}\n    condition:\n        '), condition, F.lit("\n}"),
    )
    return session.spread_small(t.documents).select(
        n.alias("rule_no"),
        name.alias("rule_name"),
        F.col("source").alias("feed"),
        F.substr("source", F.lit(4)).cast("int").alias("priority"),
        file_name.alias("file_name"),
        line.alias("first_line"),
        condition.alias("condition"),
        body.alias("body"),
        F.concat(head, body).alias("text"),
    )


CORPUS = """corpus AS (
  SELECT *, 'rule ' || rule_name || ' {' || chr(10) || '    meta:' || chr(10) || '        description = "' || feed
    || '"' || chr(10) || '        severity = "high"' || chr(10) || '    strings:' || chr(10) || '        $a = "'
    || first_line || '"' || chr(10) || '        $b = {6D 61 6C}' || chr(10) || '    condition:' || chr(10)
    || '        ' || condition || chr(10) || '}' AS body,
    CASE WHEN rule_no % 25 = 2 THEN 'include "./packers.yar"' ELSE 'import "elf"' END || chr(10) AS head
  FROM (SELECT doc_id AS rule_no, name AS rule_name, source AS feed, CAST(substr(source, 4) AS INTEGER) AS priority,
      CASE doc_id % 25 WHEN 0 THEN 'domain.yar' WHEN 1 THEN 'base64.yar' WHEN 2 THEN 'packers_index.yar'
        ELSE name || '.yar' END AS file_name,
      replace(replace(split_part(text, chr(10), 1), '"', ''), chr(92), '') AS first_line,
      CASE doc_id % 7 WHEN 0 THEN '2 of them' WHEN 1 THEN '$b' WHEN 2 THEN '$zz' WHEN 3 THEN 'filesize < 1KB'
        ELSE 'any of them' END AS condition
    FROM (SELECT *, list_extract([STEMS], CAST(doc_id % 16 + 1 AS BIGINT)) || '_' || (doc_id % 640) AS name
      FROM documents)))""".replace("STEMS", ", ".join(quote(s) for s in STEMS))


def parsed_corpus(t: Tables) -> DataFrame:
    parsed = readers.parse_rules(corpus(t), "text").drop("rule_no")
    return parsed


# ---- logs, alerts, restarts

LOG_TEXT = [
    ("error", "threat_detected", "THREAT DETECTED: rule R%d matched"),
    ("view", "scan_started", "Active response triggered for: /host/%d"),
    ("click", "file_modified", "Integrity checksum changed for /host/%d"),
    ("signup", "file_added", "New file added /host/%d"),
    ("purchase", "file_quarantined", "File quarantined: item.%d"),
]


def events(t: Tables) -> DataFrame:
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


def k_of(props="props"):
    return F.get_json_object(props, "$.k").cast("bigint")


def logs(t: Tables) -> DataFrame:
    """ts, level, action, msg, log_file, line_no, host: one line per event."""
    e = events(t)
    pick = lambda i: F.create_map(*[x for r in LOG_TEXT for x in (F.lit(r[0]), F.lit(r[i]))])[F.col("event_type")]
    msg = F.replace(pick(2), F.lit("%d"), k_of().cast("string"))
    level = F.when(F.col("event_type") == "error", "WARNING").otherwise("INFO")
    return e.select(
        "event_id", "ts", level.alias("level"), pick(1).alias("action"), msg.alias("msg"),
        F.concat(F.lit("host_"), F.col("user_id").cast("string")).alias("log_file"),
        F.col("event_id").alias("line_no"), F.col("user_id").alias("host"), k_of().alias("k"),
    )


LOGS = """logs AS (
  SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 'WARNING' ELSE 'INFO' END AS level,
    CASE event_type ACTIONS END AS action, CASE event_type MSGS END AS msg,
    'host_' || user_id AS log_file, event_id AS line_no, user_id AS host, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))""".replace(
    "ACTIONS", " ".join(f"WHEN '{e}' THEN '{a}'" for e, a, _ in LOG_TEXT)
).replace("MSGS", " ".join(f"WHEN '{e}' THEN replace('{m}', '%d', CAST(k AS VARCHAR))" for e, _, m in LOG_TEXT))


def alert_json(t: Tables) -> DataFrame:
    """Alerts as JSON lines, rendered from error events."""
    k = k_of()
    groups = F.when(k % 2 == 0, F.array(F.lit("yara"))).otherwise(F.array(F.lit("other")))
    rule = F.struct(
        k.cast("string").alias("id"), F.lit(12).alias("level"),
        F.concat(F.lit("rule "), k.cast("string")).alias("description"), groups.alias("groups"),
    )
    e = events(t).where("event_type = 'error'")
    return e.select(F.to_json(F.struct(F.col("ts").alias("timestamp"), rule.alias("rule")),
                              {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value"))


def alerts(t: Tables) -> DataFrame:
    return readers.parse_alerts(alert_json(t))


ALERTS = """alerts AS (
  SELECT ts, 'rule ' || k AS description, k, CASE WHEN k % 2 = 0 THEN 'yara' ELSE 'other' END AS grp
  FROM (SELECT ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'error'))"""


def restarts(t: Tables) -> DataFrame:
    e = events(t).where("event_type = 'error'")
    return e.select((F.col("user_id") % 4).alias("host"), "ts", "event_id")


RESTARTS = """restarts AS (SELECT user_id % 4 AS host, ts, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec
  FROM events WHERE event_type = 'error')"""


def metrics(t: Tables) -> DataFrame:
    """cpu, mem, disk, detections and changes per host, out of the event values."""
    capped = lambda c: F.least(F.round(c, 1), F.lit(100.0))
    value = F.col("value").cast("decimal(18,2)")
    of = lambda kind: F.when(F.col("event_type") == kind, value)
    return t.events.groupBy(F.col("user_id").alias("host")).agg(
        capped(F.coalesce(F.max(of("error")), F.lit(0)).cast("double")).alias("cpu"),
        capped(F.coalesce(F.max(of("view")), F.lit(0)).cast("double")).alias("mem"),
        capped(F.coalesce(F.max(of("click")), F.lit(0)).cast("double")).alias("disk"),
        F.count_if(F.col("event_type") == "error").alias("detections"),
        (F.count_if(F.col("event_type").isin("click", "signup")) * 4).alias("changes"),
    )


METRICS = """metrics AS (
  SELECT user_id AS host,
    least(round(coalesce(max(CASE WHEN event_type = 'error' THEN value END), 0), 1), 100.0) AS cpu,
    least(round(coalesce(max(CASE WHEN event_type = 'view' THEN value END), 0), 1), 100.0) AS mem,
    least(round(coalesce(max(CASE WHEN event_type = 'click' THEN value END), 0), 1), 100.0) AS disk,
    count(*) FILTER (event_type = 'error') AS detections,
    4 * count(*) FILTER (event_type IN ('click', 'signup')) AS changes
  FROM events GROUP BY user_id)"""


def snapshots(t: Tables) -> DataFrame:
    """Process snapshots of the watchdog: one per event, component memory derived from its value."""
    e = t.events
    kb = (F.col("value").cast("decimal(18,2)") * 40000).cast("bigint")
    component = lambda i: F.when((F.col("event_id") + i) % 11 != 0, kb + i * 1024)
    return e.select(
        F.col("event_id").alias("host"),
        (F.col("event_id") % 13 != 0).alias("service_active"),
        (F.col("event_id") % 110).alias("process_count"),
        *[component(i).alias(f"{name}_kb") for i, name in enumerate(fixed.COMPONENTS)],
    )


SNAPSHOTS = "snapshots AS (SELECT event_id AS host, event_id % 13 <> 0 AS service_active, event_id % 110 AS process_count, " + (
    ", ".join(
        f"CASE WHEN (event_id + {i}) % 11 <> 0 THEN CAST(CAST(value AS DECIMAL(18,2)) * 40000 AS BIGINT) + {i * 1024} END AS {n}_kb"
        for i, n in enumerate(fixed.COMPONENTS)
    )
) + " FROM events)"


def fleet_hosts(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("host"))


def quarantine(t: Tables) -> DataFrame:
    """Quarantine rows of all matched files; the time is the change time of the file."""
    found = matching.matched_files(files(t), active_fixture(t), fixture_strings(t))
    items = found.withColumn("rule_name", F.try_element_at("rule_names", F.lit(-1))).withColumn("item_id", F.col("doc_id"))
    return sinks.quarantine_rows(items, "mtime")


QUARANTINE = """rule_of AS (SELECT path, max(rule_name) AS rule_name FROM matches GROUP BY path),
quarantine AS (
  SELECT strftime(f.mtime, '%Y%m%d') || '/' || f.name || '.quarantine.' || strftime(f.mtime, '%H%M%S') || '_'
      || f.doc_id AS q_path, f.path AS orig_path, r.rule_name, f.mtime AS q_time, sha256(f.content) AS sha256,
    f.size_bytes, f.content, CAST(f.mtime AS DATE) AS q_date, f.doc_id, f.name
  FROM files f JOIN rule_of r USING (path))"""
