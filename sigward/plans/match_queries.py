"""Signature matching and what joins on to it."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigward import session
from sigward.functions import fixed
from sigward.functions import scalars as X
from sigward.operators import aggregates, chains, filters, joins, matching
from sigward.plans import views as V
from sigward.plans.filter_queries import alert_texts
from sigward.plans.registry import Tables, query
from sigward.plans.source_queries import FILE_ENTRY, MONITORED, directories_xml, file_entry
from sigward.sources import readers, sinks

def pick(names, ident="doc_id"):
    array = F.array(*[F.lit(n) for n in names])
    return F.element_at(array, (F.col(ident) % len(names) + 1).cast("int"))


def pick_sql(names, ident="doc_id"):
    return f"list_extract([{', '.join(V.quote(n) for n in names)}], CAST({ident} % {len(names)} + 1 AS BIGINT))"



HITS = ", ".join([V.FILES, V.STRINGS, V.hits_sql()])
HIT = ["path", "rule_name", "string_id"]
ITEM_HITS = f"""WITH {V.FILES}, {V.ITEM_STRINGS}, {V.hits_sql()} SELECT path, rule_name, string_id FROM hits"""


@query("m1_match_strings", f"WITH {HITS} SELECT path, rule_name, string_id FROM hits")
def m1_match_strings(t: Tables):
    return matching.match_strings(V.files(t), V.fixture_strings(t)).select(*HIT)


@query("m1_match_strings_items", ITEM_HITS)
def m1_match_strings_items(t: Tables):
    """Every benchmark passage as a rule; the way is chosen by the number of passages."""
    return matching.match_strings(V.files(t), V.item_strings(t)).select(*HIT)


@query("m2_match_hex", f"WITH {HITS} SELECT path, rule_name, string_id FROM hits WHERE rule_name = 'Linux_Ransomware_Hex'")
def m2_match_hex(t: Tables):
    return matching.match_hex(V.files(t), V.fixture_strings(t)).select(*HIT)


@query("m2_match_hex_items", ITEM_HITS)
def m2_match_hex_items(t: Tables):
    """Benchmark passages written as hex strings and matched on bytes."""
    as_hex = F.concat(F.lit("{"), F.regexp_replace(F.hex(F.encode("pattern", "UTF-8")), "(..)", "$1 "), F.lit("}"))
    strings = V.item_strings(t).withColumn("kind", F.lit("hex")).withColumn("pattern", as_hex)
    files = V.files(t).withColumn("content", F.encode("content", "UTF-8"))
    return matching.match_hex(files, strings).select(*HIT)


@query("m3_eval_condition", f"WITH {V.MATCHES} SELECT rule_name, path FROM matches")
def m3_eval_condition(t: Tables):
    hits = matching.match_strings(V.files(t), V.fixture_strings(t))
    return matching.eval_conditions(hits, V.active_fixture(t))


@query("m4_scan", f"WITH {V.MATCHES} SELECT rule_name, path FROM matches")
def m4_scan(t: Tables):
    return V.matches(t)


WEB = f"""files AS (SELECT {V.URL_PATH} || '#' || page_id AS path, html AS content FROM pages)"""


@query(
    "m4_scan_pages",
    f"""WITH {WEB}, {V.RULES}, {V.STRINGS}, {V.hits_sql()}, {V.MATCHES_OF_HITS} SELECT rule_name, path FROM matches""",
)
def m4_scan_pages(t: Tables):
    path = F.concat(V.url_path(), F.lit("#"), F.col("page_id").cast("string"))
    files = t.pages.select(path.alias("path"), X.basename(path).alias("name"), F.col("html").alias("content"))
    return matching.scan(files, V.active_fixture(t), V.fixture_strings(t))


TAILS = [" shell_exec(1)", " exec(1)", " eval(base64_decode(x", fixed.BASE_RULES[0][2][0][1], ""]


@query(
    "m4_scan_base_rules",
    """SELECT CASE doc_id % 5 WHEN 0 THEN 'Webshell_Generic' WHEN 2 THEN 'Suspicious_Base64_Shell' ELSE 'EICAR_Test_File'
      END AS rule_name, '/doc_' || doc_id AS path FROM documents WHERE doc_id % 5 IN (0, 2, 3)""",
)
def m4_scan_base_rules(t: Tables):
    """Documents with the markers of the base rules put behind their texts."""
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    files = t.documents.select(
        F.concat(F.lit("/"), name).alias("path"), name.alias("name"), F.concat("text", pick(TAILS)).alias("content")
    )
    return matching.scan(files, *readers.base_rules(t.spark))


@query(
    "m5_quick_scan",
    f"""WITH {V.FILES}, near AS (SELECT * FROM files WHERE NOT starts_with(path, '/src1/') ORDER BY path LIMIT 100),
    {V.RULES}, {V.STRINGS}, {V.hits_sql('near')}, {V.MATCHES_OF_HITS} SELECT rule_name, path FROM matches""",
)
def m5_quick_scan(t: Tables):
    return matching.quick_scan(V.files(t), V.active_fixture(t), V.fixture_strings(t), "/", excluded_dirs=["/src1"])


@query("m6_match_strings_indexed", ITEM_HITS)
def m6_match_strings_indexed(t: Tables):
    return matching.match_strings_indexed(V.files(t), V.item_strings(t)).select(*HIT)


# More strings than the literal plan takes: one-token strings (two of each passage's words run together are left out, as
# a token may hold others), hex strings of another passage, a string id that two rules share, and a path that comes twice.
MANY = f"""{V.FILES}, words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{{5,}}')) AS w FROM benchmark)"""


def many_words(t: Tables):
    return t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("w")).distinct()


@query(
    "m6_match_tokens",
    f"""WITH {MANY} SELECT path, 'word' AS rule_name, '$' || w AS string_id FROM files JOIN words ON contains(content, w)""",
)
def m6_match_tokens(t: Tables):
    """Every longer word of the passages as a string of its own: all are bare tokens."""
    strings = many_words(t).select(
        F.lit("word").alias("rule_name"), F.concat(F.lit("$"), "w").alias("string_id"), F.lit("text").alias("kind"), F.col("w").alias("pattern")
    )
    return matching.match_strings(V.files(t), strings).select(*HIT)


@query(
    "m2_match_hex_tokens",
    f"""WITH {MANY} SELECT path, 'word' AS rule_name, '$' || w AS string_id FROM files JOIN words ON contains(content, ' ' || w)""",
)
def m2_match_hex_tokens(t: Tables):
    """The same words behind a blank, as hex strings."""
    as_hex = F.concat(F.lit("{20 "), F.regexp_replace(F.hex(F.encode("w", "UTF-8")), "(..)", "$1 "), F.lit("}"))
    strings = many_words(t).select(F.lit("word").alias("rule_name"), F.concat(F.lit("$"), "w").alias("string_id"), F.lit("hex").alias("kind"), as_hex.alias("pattern"))
    return matching.match_hex(V.files(t), strings).select(*HIT)


@query(
    "m4_scan_two_feeds",
    f"""WITH {MANY}, twice AS (SELECT path, content FROM files UNION ALL SELECT path, lower(content) FROM files),
    rows AS (SELECT row_number() OVER () AS r, * FROM twice)
    SELECT 'Two' AS rule_name, path FROM (SELECT r, path, f, w FROM rows JOIN (SELECT w, f FROM words, (VALUES ('a'), ('b')) v(f)
        WHERE (f = 'a') = (length(w) % 2 = 0)) ON contains(content, w)) GROUP BY r, path, f HAVING count(DISTINCT w) >= 5""",
)
def m4_scan_two_feeds(t: Tables):
    """Two feeds have a rule of the same name with other strings; every path comes twice with other contents."""
    feed = F.when(F.length("w") % 2 == 0, "a").otherwise("b")
    strings = many_words(t).select(
        feed.alias("rule_id"), F.lit("Two").alias("rule_name"), F.concat(F.lit("$"), "w").alias("string_id"), F.lit("text").alias("kind"), F.col("w").alias("pattern")
    )
    rules = t.spark.createDataFrame([("a", "Two", 5, None), ("b", "Two", 5, None)], "rule_id STRING, rule_name STRING, min_hits INT, only_id STRING")
    files = V.files(t)
    twice = files.unionByName(files.withColumn("content", F.lower("content")))
    return matching.scan(twice, rules, strings, [], [])


@query("g2_rule_matcher", ITEM_HITS)
def g2_rule_matcher(t: Tables):
    """The passages as rules: a rule set is measured once and the scan with it evaluates conditions. A rule has one string here."""
    strings = V.item_strings(t)
    rules = strings.select("rule_name", F.lit(1).alias("min_hits"), F.lit("$a").alias("only_id"))
    return matching.scan(V.files(t), matching.rule_set(rules, strings), None, [], []).select("path", "rule_name", F.lit("$a").alias("string_id"))


# A rule for each first letter of the longer words, and each file twice with other contents under one path.
LETTERS = f"""{MANY}, strings AS (SELECT 'Letter_' || lower(left(w, 1)) AS rule_name, w FROM words),
    rows AS (SELECT row_number() OVER () AS r, * FROM (SELECT path, content FROM files UNION ALL SELECT path, lower(content) FROM files)),
    fired AS (SELECT r, rule_name FROM rows JOIN strings ON contains(content, w) GROUP BY r, rule_name HAVING count(DISTINCT w) >= 4),
    matched AS (SELECT path, content, (SELECT string_agg(rule_name, ',' ORDER BY rule_name) FROM fired f WHERE f.r = rows.r) AS rules FROM rows WHERE r IN (SELECT r FROM fired))"""


def letter_rules(t: Tables):
    """(rules, strings) of some hundred strings."""
    strings = many_words(t).select(
        F.concat(F.lit("Letter_"), F.lower(F.left("w", F.lit(1)))).alias("rule_name"), F.concat(F.lit("$"), "w").alias("string_id"), F.lit("text").alias("kind"), F.col("w").alias("pattern")
    )
    rules = strings.select("rule_name").distinct().select("rule_name", F.lit(4).alias("min_hits"), F.lit(None).cast("string").alias("only_id"))
    return rules, strings


def files_twice(t: Tables):
    files = V.files(t)
    return files.unionByName(files.withColumn("content", F.lower("content")))


@query("m4_matched_files_many", f"WITH {LETTERS} SELECT path, rules, sha256(content) AS sha256 FROM matched")
def m4_matched_files_many(t: Tables):
    """Contents of the files that match one of many strings, behind an exchange."""
    files = files_twice(t)
    found = matching.matched_files(files.repartition(session.shuffles(t.spark)), *letter_rules(t))
    return found.select("path", F.array_join("rule_names", ",").alias("rules"), X.sha256_hex("content").alias("sha256"))


@query(
    "g3_scan_large_files",
    f"""WITH {V.MATCHES}, w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{{5,}}')) AS w FROM benchmark),
    fired AS (SELECT path, 'Letter_' || lower(left(w, 1)) AS rule_name, w FROM files JOIN w ON contains(content, w))
    SELECT rule_name, path FROM matches UNION ALL SELECT rule_name, path FROM fired GROUP BY rule_name, path HAVING count(DISTINCT w) >= 4""",
)
def g3_scan_large_files(t: Tables):
    """Files of more than 4 kB are cut into pieces of 1 kB that all tasks share; few strings and many."""
    cut = {"large_bytes": 4096, "piece_bytes": 1024}
    few = matching.scan(V.files(t), V.active_fixture(t), V.fixture_strings(t), [], [], **cut)
    return few.unionByName(matching.scan(V.files(t), *letter_rules(t), [], [], **cut))


WORD_RULE = 'rule %s {\n    strings:\n        $a = "%s"\n    condition:\n        %s\n}'


@query(
    "c3_quarantine_by_written_rules",
    f"""WITH {MANY} SELECT path AS orig_path, string_agg('Word_' || w, ',' ORDER BY 'Word_' || w) AS rules, any_value(sha256(content)) AS sha256
    FROM files JOIN words ON contains(content, w) WHERE length(w) <> 7 AND left(w, 1) NOT IN ('a', 'A') GROUP BY path""",
)
def c3_quarantine_by_written_rules(t: Tables):
    """Rule files are written, read, checked, cleaned of deny-listed and broken rules, scanned with, and the matched files stored."""
    base = session.scratch_dir(t.spark, "written-rules")
    denied = F.lower(F.left("w", F.lit(1))) == "a"
    name = F.concat(F.when(denied, "Android_").otherwise("Word_"), "w")
    condition = F.when(F.length("w") == 7, "$zz").otherwise("$a")
    text = F.format_string(WORD_RULE, name, F.col("w"), condition)
    feed = F.when(F.length("w") % 2 == 0, "even").otherwise("odd")
    many_words(t).select(text.alias("value"), feed.alias("feed")).write.partitionBy("feed").text(f"{base}/rules")
    # Deny-lists go by file name; each rule stands for a file of its own.
    rules = readers.read_rules(t.spark, f"{base}/rules", name_glob="*.txt").withColumn("file_name", F.concat("rule_name", F.lit(".yar")))
    files = V.files(t).withColumn("item_id", F.col("doc_id"))
    chains.quarantine_matches(files, rules, "mtime", f"{base}/quarantine")
    stored = t.spark.read.parquet(f"{base}/quarantine")
    return stored.select("orig_path", F.array_join("rule_names", ",").alias("rules"), "sha256")


@query(
    "m7_fleet_scan",
    """WITH counts AS (SELECT user_id AS host, count(*) AS n FROM events WHERE event_type = 'error' AND value > 60
      GROUP BY 1), answered AS (SELECT DISTINCT user_id AS host, user_id % 17 <> 0 AS installed FROM events)
    SELECT c_custkey AS host, CASE WHEN installed IS NULL THEN 'failed' WHEN NOT installed THEN 'not installed'
        WHEN coalesce(n, 0) > 0 THEN 'threats' ELSE 'clean' END AS status,
      CASE WHEN installed THEN coalesce(n, 0) END AS threats
    FROM customer LEFT JOIN answered ON host = c_custkey LEFT JOIN counts ON counts.host = c_custkey""",
)
def m7_fleet_scan(t: Tables):
    return fleet(t)


def fleet(t: Tables):
    e = t.events.withColumn("host", F.col("user_id"))
    threats = e.where("event_type = 'error' AND value > 60").select("host")
    reports = e.select("host", (F.col("host") % 17 != 0).alias("installed"))
    return matching.fleet_scan(V.fleet_hosts(t), reports, threats)


@query(
    "m8_marker_check",
    """SELECT doc_id, CASE WHEN contains(text, 'worthless') THEN 'Insult' ELSE 'Licence text' END AS marker
    FROM documents WHERE contains(text, 'worthless') OR contains(text, 'License')""",
)
def m8_marker_check(t: Tables):
    docs = t.documents.select("doc_id", F.col("text").alias("content"))
    markers = [("worthless", "Insult"), ("License", "Licence text")]
    return matching.marker_check(docs, markers).select("doc_id", "marker")


@query(
    "m8_marker_check_default",
    """SELECT doc_id, CASE WHEN contains(t, 'STANDARD-ANTIVIRUS-TEST-FILE') THEN 'EICAR Test' ELSE 'Test Malware' END
      AS marker FROM (SELECT doc_id, text || CASE doc_id % 9 WHEN 0 THEN ' STANDARD-ANTIVIRUS-TEST-FILE'
        WHEN 1 THEN ' MALWARE_TEST_STRING' ELSE '' END AS t FROM documents)
    WHERE contains(t, 'STANDARD-ANTIVIRUS-TEST-FILE') OR contains(t, 'MALWARE_TEST_STRING')""",
)
def m8_marker_check_default(t: Tables):
    k = F.col("doc_id") % 9
    tail = F.when(k == 0, " STANDARD-ANTIVIRUS-TEST-FILE").when(k == 1, " MALWARE_TEST_STRING").otherwise("")
    docs = t.documents.select("doc_id", F.concat("text", tail).alias("content"))
    return matching.marker_check(docs).select("doc_id", "marker")


@query(
    "m9_validate_rules_broken",
    f"""WITH {V.CORPUS} SELECT rule_name, feed, CASE condition WHEN '$zz' THEN 'undeclared string'
      ELSE 'unknown condition' END AS problem FROM corpus WHERE condition IN ('$zz', 'filesize < 1KB')""",
)
def m9_validate_rules_broken(t: Tables):
    return matching.validate_rules(V.parsed_corpus(t))[1].select("rule_name", "feed", "problem")


@query(
    "m9_validate_rules_working",
    f"""WITH {V.CORPUS} SELECT rule_name, feed, md5(body) AS body_md5 FROM corpus
    WHERE condition NOT IN ('$zz', 'filesize < 1KB')""",
)
def m9_validate_rules_working(t: Tables):
    return matching.validate_rules(V.parsed_corpus(t))[0].select("rule_name", "feed", F.md5("body").alias("body_md5"))


CUSTOM_RULE = """
rule Custom_Threat {
    meta:
        description = "Custom threat detection"
        severity = "critical"
    strings:
        $pattern1 = "stupid"
        $pattern2 = {69 64 69 6F 74}
    condition:
        any of them
}
"""


@query(
    "g1_user_rules",
    f"""WITH {V.MATCHES} SELECT rule_name, path FROM matches UNION ALL
    SELECT 'Custom_Threat', path FROM files WHERE contains(content, 'stupid') OR contains(content, 'idiot')""",
)
def g1_user_rules(t: Tables):
    """A custom rule text is parsed, appended to the corpus and scanned with."""
    text = t.spark.createDataFrame([(CUSTOM_RULE, "custom", "custom.yar")], "value STRING, feed STRING, file_name STRING")
    parsed = readers.parse_rules(text).drop("rule_no")
    rules, strings = matching.add_rules(V.active_fixture(t), V.fixture_strings(t), parsed)
    return matching.scan(V.files(t), rules, strings)


GUARD = 8192


@query(
    "g3_size_guard",
    f"""WITH {V.MATCHES} SELECT path, size_bytes, size_bytes > {GUARD} AS oversize, rule_name FROM matches JOIN files USING (path)""",
)
def g3_size_guard(t: Tables):
    files = matching.guard(V.files(t), GUARD)
    found = matching.matched_files(files, V.active_fixture(t), V.fixture_strings(t))
    return found.select("path", "size_bytes", "oversize", F.explode("rule_names").alias("rule_name"))


# ---- joins

NAMES = [n for n, _ in fixed.DISPLAY_NAMES] + ["EICAR_Test_File", "SUSP_An_EICAR_x", "Multi_EICAR_2", "Linux_Trojan_Agent"]
THREATS = [
    "Linux_Log_Cleaner_1", "Linux_Trojan_Mirai", "Linux_Cryptominer_x", "Ransomware_y", "CVE_Exploit", "XZ_Backdoor",
    "Rootkit_z", "Webshell_Generic", "CVE_XZ_util", "BOT_Mirai", "SSH_brute", "EXPL_PwnKit", "Other_Rule", "",
]


EXACT = " ".join(f"WHEN r = {V.quote(n)} THEN {V.quote(d)}" for n, d in fixed.DISPLAY_NAMES)
GLOBS = " ".join(f"WHEN r GLOB {V.quote(g)} THEN {V.quote(d)}" for g, d in fixed.DISPLAY_GLOBS)


@query(
    "j1_display_name",
    f"""SELECT doc_id, CASE {EXACT} ELSE r END AS daily, CASE {EXACT} {GLOBS} ELSE r END AS quick
    FROM (SELECT doc_id, {pick_sql(NAMES)} AS r FROM documents)""",
)
def j1_display_name(t: Tables):
    rows = t.documents.select("doc_id", pick(NAMES).alias("rule_name"))
    return rows.select(
        "doc_id", joins.display_name().alias("daily"), joins.display_name(globs=True).alias("quick")
    )


DESCRIPTION = (
    "CASE " + " ".join(f"WHEN contains(r, {V.quote(w)}) THEN {V.quote(d)}" for w, d in fixed.THREAT_DESCRIPTIONS)
    + f" ELSE {V.quote(fixed.DEFAULT_DESCRIPTION)} END"
)


@query(
    "j2_threat_description",
    f"SELECT doc_id, {DESCRIPTION} AS description FROM (SELECT doc_id, {pick_sql(THREATS)} AS r FROM documents)",
)
def j2_threat_description(t: Tables):
    rows = t.documents.select("doc_id", pick(THREATS).alias("rule_name"))
    return rows.select("doc_id", joins.threat_description().alias("description"))


def human_sql(b: str) -> str:
    unit = lambda p, u: (
        f"CASE WHEN ceil({b} / {1024.0**p} * 10) / 10 < 10 THEN printf('%.1f{u}', ceil({b} / {1024.0**p} * 10) / 10)"
        f" ELSE CAST(CAST(ceil({b} / {1024.0**p}) AS BIGINT) AS VARCHAR) || '{u}' END"
    )
    return (
        f"CASE WHEN {b} > {1023 * 1024**4} THEN {unit(5, 'P')} WHEN {b} > {1023 * 1024**3} THEN {unit(4, 'T')}"
        f" WHEN {b} > {1023 * 1024**2} THEN {unit(3, 'G')} WHEN {b} > 1023 * 1024 THEN {unit(2, 'M')}"
        f" WHEN {b} > 1023 THEN {unit(1, 'K')} ELSE CAST({b} AS VARCHAR) END"
    )


@query(
    "j3_quarantine_detail",
    f"""WITH {V.MATCHES}, {V.QUARANTINE}
    SELECT q_path, CASE WHEN doc_id % 3 <> 0 THEN orig_path ELSE split_part(name, '.', 1) END AS orig_path,
      CASE WHEN doc_id % 3 <> 0 THEN rule_name ELSE 'Unknown' END AS rule_name,
      strftime(q_time, '%Y-%m-%d %H:%M:%S') AS q_time, sha256[1:16] AS sha256_short, {human_sql('size_bytes')} AS size
    FROM quarantine""",
)
def j3_quarantine_detail(t: Tables):
    """Every third item has lost its sidecar."""
    q = V.quarantine(t).withColumn("name", X.basename("orig_path"))
    ident = F.regexp_extract("name", r"_(\d+)\.", 1).cast("bigint")
    side = readers.read_sidecar(q.where(ident % 3 != 0).select("q_path", sinks.sidecar_text().alias("text")))
    items = q.select("q_path", "name", F.col("q_time").alias("mtime"), "content", "size_bytes")
    return joins.quarantine_detail(items, side)


@query(
    "j4_attribute_detection",
    f"""WITH {V.MATCHES}, one AS (SELECT path, min(rule_name) AS rule_name FROM matches GROUP BY path)
    SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'Log_' || source WHEN one.rule_name IS NOT NULL THEN one.rule_name
      WHEN doc_id % 9 = 0 THEN 'EICAR Test' WHEN doc_id % 9 = 1 THEN 'Test Malware'
      WHEN doc_id % 8 = 0 THEN 'EICAR Test' ELSE 'Unknown' END AS detection
    FROM files LEFT JOIN one USING (path)""",
)
def j4_attribute_detection(t: Tables):
    files = V.files(t)
    k = F.col("doc_id") % 9
    tail = F.when(k == 0, " STANDARD-ANTIVIRUS-TEST-FILE").when(k == 1, " MALWARE_TEST_STRING").otherwise("")
    name = F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("My_Eicar_"), "name")).otherwise(F.col("name"))
    items = files.withColumn("content", F.concat("content", tail)).withColumn("name", name)
    log = files.where("doc_id % 10 = 0").select("path", F.concat(F.lit("Log_"), "source").alias("rule_name"))
    return joins.attribute_detection(items, log, V.matches(t)).select("doc_id", "detection")


@query(
    "j5_asof_detection",
    f"""WITH {V.LOGS}, e AS (SELECT event_id, host % 4 AS host, ts, action, msg, CAST(floor(epoch(ts)) AS BIGINT) AS sec
      FROM logs), d AS (SELECT host, sec, max(ROW(ts, event_id, msg)) AS f FROM e WHERE action = 'threat_detected'
      GROUP BY host, sec)
    SELECT i.event_id, i.host, f[2] AS detection_id, f[3] AS threat
    FROM (SELECT * FROM e WHERE action = 'file_quarantined') i ASOF LEFT JOIN d
      ON i.host = d.host AND i.sec >= d.sec""",
)
def j5_asof_detection(t: Tables):
    e = V.logs(t).select("event_id", (F.col("host") % 4).alias("host"), "ts", "action", F.col("msg").alias("threat"))
    items = e.where("action = 'file_quarantined'").select(F.col("event_id").alias("item"), "host", "ts")
    found = joins.asof_detection(items, e.where("action = 'threat_detected'"))
    return found.select(F.col("item").alias("event_id"), "host", F.col("event_id").alias("detection_id"), "threat")


DIRS = ["/en", "/fr", "/de", "/es", "/nothing"]


@query(
    "j6_dir_coverage",
    f"""WITH {FILE_ENTRY}, dirs(dir) AS (VALUES {', '.join(f"('{d}')" for d in DIRS)})
    SELECT dir, count(path) AS files FROM dirs LEFT JOIN file_entry ON path = dir OR starts_with(path, dir || '/')
    GROUP BY dir""",
)
def j6_dir_coverage(t: Tables):
    dirs = t.spark.createDataFrame([(d,) for d in DIRS], "dir STRING")
    return joins.dir_coverage(dirs, file_entry(t))


@query(
    "j6_dir_coverage_configured",
    f"""WITH {FILE_ENTRY}, {MONITORED}, dirs AS (SELECT DISTINCT dir FROM monitored)
    SELECT dir, count(path) AS files FROM dirs LEFT JOIN file_entry ON path = dir OR starts_with(path, dir || '/')
    GROUP BY dir""",
)
def j6_dir_coverage_configured(t: Tables):
    """The directories of the settings themselves, as many as there are pages."""
    rows = directories_xml(t).select(X.xml_body("value", "directories").alias("body"), F.lit("no").alias("realtime"))
    return joins.dir_coverage(readers.explode_monitored(rows).select("dir").distinct(), file_entry(t))


@query(
    "j7_still_present",
    f"WITH {V.MATCHES} SELECT rule_name, path FROM matches JOIN files USING (path) SEMI JOIN labels USING (doc_id)",
)
def j7_still_present(t: Tables):
    """Files that have a label are still there."""
    present = V.files(t).join(t.labels, "doc_id", "left_semi")
    return joins.still_present(V.matches(t), present)


@query(
    "j8_missing_required",
    f"""WITH {V.SNAPSHOTS}, hosts AS (SELECT DISTINCT user_id AS host FROM events), present AS ("""
    + " UNION ALL ".join(
        f"SELECT user_id AS host, '{c}' AS component FROM events JOIN snapshots ON host = event_id "
        f"WHERE {c}_kb IS NOT NULL AND value > 200" for c in fixed.COMPONENTS
    )
    + f""") SELECT host, component FROM hosts CROSS JOIN (SELECT unnest([{', '.join(f"'{c}'" for c in fixed.COMPONENTS)}])
      AS component) ANTI JOIN present USING (host, component)""",
)
def j8_missing_required(t: Tables):
    hosts = t.events.select(F.col("user_id").alias("host")).distinct()
    required = hosts.select("host", F.explode(F.array(*[F.lit(c) for c in fixed.COMPONENTS])).alias("component"))
    seen = V.snapshots(t).withColumnRenamed("host", "event_id")
    up = F.array_compact(F.array(*[F.when(F.col(f"{c}_kb").isNotNull(), c) for c in fixed.COMPONENTS]))
    strong = t.events.where("value > 200").select("event_id", F.col("user_id").alias("host"))
    present = strong.join(seen, "event_id").select("host", F.explode(up).alias("component"))
    return joins.missing_required(required, present, ["host", "component"])


RULE_TEXT = "rule_name || CASE rule_no % 4 WHEN 0 THEN '_CVE_2021_4034_Mirai' WHEN 1 THEN '_ssh_brute' ELSE '' END"
CATEGORY_ROWS = " UNION ALL ".join(
    f"SELECT rule_no, '{name}' AS category FROM named WHERE regexp_matches(n, {V.quote(p)})" for name, p in fixed.CATEGORIES
)


@query(
    "j9_rule_category",
    f"WITH {V.CORPUS}, named AS (SELECT rule_no, {RULE_TEXT} AS n FROM corpus) {CATEGORY_ROWS}",
)
def j9_rule_category(t: Tables):
    k = F.col("rule_no") % 4
    tail = F.when(k == 0, "_CVE_2021_4034_Mirai").when(k == 1, "_ssh_brute").otherwise("")
    rules = V.corpus(t).select("rule_no", F.concat("rule_name", tail).alias("rule_name"))
    return joins.rule_category(rules).select("rule_no", "category")


@query(
    "j10_decode_alert",
    f"""WITH {V.LOGS} SELECT event_id, 'R' || k AS threat_name, '/host/' || host AS file_path FROM logs WHERE k % 3 = 0""",
)
def j10_decode_alert(t: Tables):
    return joins.decode_alert(alert_texts(t)).select("event_id", "threat_name", "file_path")


@query(
    "j10_decode_alert_written",
    f"""WITH {V.MATCHES}, {V.QUARANTINE} SELECT rule_name AS threat_name, orig_path AS file_path, 12 AS level FROM quarantine""",
)
def j10_decode_alert_written(t: Tables):
    """The alert lines of all quarantined files, as they are written, are decoded again."""
    rows = V.quarantine(t).select("q_time", "rule_name", F.col("orig_path").alias("path"), X.basename("q_path").alias("q_name"))
    found = joins.decode_alert(sinks.alert_lines(rows))
    return found.select("threat_name", "file_path", filters.alert_level("value").alias("level"))


@query(
    "c2_threat_report",
    f"""WITH {V.MATCHES} SELECT r AS rule_name, CASE {EXACT} ELSE r END AS display_name, {DESCRIPTION} AS description, matches, files
    FROM (SELECT rule_name AS r, count(*) AS matches, count(DISTINCT path) AS files FROM matches GROUP BY 1)""",
)
def c2_threat_report(t: Tables):
    return aggregates.threat_report(V.matches(t))


@query(
    "j11_new_rules",
    f"""WITH {V.CORPUS} SELECT rule_no, rule_name FROM corpus WHERE priority % 2 = 1
      AND rule_name NOT IN (SELECT rule_name FROM corpus WHERE priority % 2 = 0 AND rule_no % 3 = 0)""",
)
def j11_new_rules(t: Tables):
    rules = V.corpus(t).select("rule_no", "rule_name", "priority")
    active = rules.where("priority % 2 = 0 AND rule_no % 3 = 0")
    return joins.new_rules(rules.where("priority % 2 = 1"), active).select("rule_no", "rule_name")


@query(
    "j12_version_check",
    """SELECT s_suppkey AS host, CASE WHEN s_nationkey = 0 THEN 'unreachable'
      WHEN s_suppkey % 3 <> 0 AND s_suppkey % 30 > 10 THEN 'ok' WHEN s_suppkey % 30 = 0 THEN 'no scripts'
      ELSE 'outdated' END AS status FROM supplier""",
)
def j12_version_check(t: Tables):
    s = t.supplier
    hosts = s.select(F.col("s_suppkey").alias("host"), F.lit(fixed.EXPECTED_VERSION).alias("expected_version"))
    version = F.when(F.col("s_suppkey") % 3 != 0, fixed.EXPECTED_VERSION).otherwise("13.6")
    reports = s.where("s_nationkey <> 0").select(
        F.col("s_suppkey").alias("host"), version.alias("main_version"), version.alias("common_version"),
        (F.col("s_suppkey") % 30).alias("scripts"),
    )
    return joins.version_check(hosts, reports)
