"""Scalar helpers, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigward.functions import fixed
from sigward.functions import scalars as X
from sigward.plans import views as V
from sigward.plans.match_queries import human_sql, pick, pick_sql
from sigward.plans.registry import Tables, query
from sigward.sources import sinks

WS = r"string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')"


@query("x1_split_fields", f"SELECT doc_id, {WS}[1] AS first, coalesce({WS}[40], '') AS fortieth FROM documents")
def x1_split_fields(t: Tables):
    c = X.split_fields
    return t.documents.select("doc_id", c("text", 1).alias("first"), c("text", 40).alias("fortieth"))


@query(
    "x2_clean_path",
    r"""SELECT doc_id, regexp_replace(replace(replace(text, chr(10), ''), chr(13), ''), '\s+$', '') AS cleaned
    FROM documents""",
)
def x2_clean_path(t: Tables):
    """A literal backslash-n is put behind every text first."""
    return t.documents.select("doc_id", X.clean_path(F.concat("text", F.lit("  \n\r\\n"))).alias("cleaned"))


@query(
    "x3_basename_dirname",
    """SELECT page_id, list_extract(string_split(url, '/'), -1) AS base, regexp_replace(url, '/[^/]*$', '') AS dir
    FROM pages""",
)
def x3_basename_dirname(t: Tables):
    return t.pages.select("page_id", X.basename("url").alias("base"), X.dirname("url").alias("dir"))


@query(
    "x4_truncate_label",
    """SELECT doc_id, CASE WHEN length(text) > 28 THEN text[1:25] || '...' ELSE text END AS label,
      CASE WHEN length(w) > 8 THEN w[1:5] || '...' ELSE w END AS short, text[1:80] AS head
    FROM (SELECT doc_id, text, split_part(text, ' ', 1) AS w FROM documents)""",
)
def x4_truncate_label(t: Tables):
    word = F.substring_index("text", " ", 1)
    return t.documents.select(
        "doc_id", X.truncate_label("text", 28, 25).alias("label"), X.truncate_label(word, 8, 5).alias("short"),
        F.substring("text", 1, 80).alias("head"),
    )


STORED = (
    "CASE doc_id % 4 WHEN 0 THEN 'a.sh.quarantine.143022_' || doc_id WHEN 1 THEN 'a.sh.1725000000.Rule_' || lang "
    "WHEN 2 THEN 'a.sh.Rule_' || lang || '.20250908_143022' ELSE 'plain_' || doc_id END"
)


def stored_name():
    k = F.col("doc_id") % 4
    return (
        F.when(k == 0, F.format_string("a.sh.quarantine.143022_%d", "doc_id"))
        .when(k == 1, F.format_string("a.sh.1725000000.Rule_%s", "lang"))
        .when(k == 2, F.format_string("a.sh.Rule_%s.20250908_143022", "lang"))
        .otherwise(F.format_string("plain_%d", "doc_id"))
    )


@query(
    "x5_penultimate_segment",
    f"""SELECT doc_id, CASE WHEN len(p) < 2 THEN n ELSE p[-2] END AS segment
    FROM (SELECT doc_id, n, string_split(n, '.') AS p FROM (SELECT doc_id, {STORED} AS n FROM documents))""",
)
def x5_penultimate_segment(t: Tables):
    return t.documents.select("doc_id", X.penultimate_segment(stored_name()).alias("segment"))


@query(
    "x6_quarantine_suffix",
    "SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'Rule_' || lang END AS suffix FROM documents",
)
def x6_quarantine_suffix(t: Tables):
    return t.documents.select("doc_id", X.quarantine_suffix(stored_name()).alias("suffix"))


@query(
    "x7_date_from_path",
    f"""SELECT doc_id, CASE WHEN d = '' THEN '2024-01-31' ELSE d[1:4] || '-' || d[5:6] || '-' || d[7:8] END AS day
    FROM (SELECT doc_id, regexp_extract({STORED}, '[0-9]{{8}}') AS d FROM documents)""",
)
def x7_date_from_path(t: Tables):
    return t.documents.select(
        "doc_id", X.date_from_path(stored_name(), V.as_of()).alias("day")
    )


@query(
    "x8_kv_value",
    r"""SELECT doc_id, regexp_replace(CASE WHEN instr(text, ':') > 0 THEN substr(text, instr(text, ':') + 1)
      ELSE text END, '^\s+|\s+$', '', 'g') AS val FROM documents""",
)
def x8_kv_value(t: Tables):
    return t.documents.select("doc_id", X.kv_value("text").alias("val"))


@query("x9_sha256", "SELECT doc_id, sha256(text) AS full_hash, sha256(text)[1:16] AS short_hash FROM documents")
def x9_sha256(t: Tables):
    return t.documents.select(
        "doc_id", X.sha256_hex("text").alias("full_hash"), X.sha256_short("text").alias("short_hash")
    )


@query(
    "x10_quarantine_name",
    """SELECT event_id, event_type || '.quarantine.' || strftime(ts, '%H%M%S') || '_' || event_id AS scan_name,
      event_type || '.' || CAST(floor(epoch(ts)) AS BIGINT) || '.Rule_' || user_id AS response_name FROM events""",
)
def x10_quarantine_name(t: Tables):
    rule = F.concat(F.lit("Rule_"), F.col("user_id").cast("string"))
    return V.events(t).select(
        "event_id", X.quarantine_name("event_type", "ts", "event_id").alias("scan_name"),
        X.quarantine_name_epoch("event_type", "ts", rule).alias("response_name"),
    )


@query("x11_html_escape", "SELECT page_id, replace(replace(html, '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def x11_html_escape(t: Tables):
    return t.pages.select("page_id", X.html_escape("html").alias("escaped"))


@query(
    "x12_digits_only",
    """SELECT c_custkey, CAST(regexp_replace(c_name, '[^0-9]', '', 'g') AS BIGINT) AS n,
      coalesce(TRY_CAST(nullif(regexp_replace(c_mktsegment, '[^0-9]', '', 'g'), '') AS BIGINT), 0) AS zero FROM customer""",
)
def x12_digits_only(t: Tables):
    return t.customer.select(
        "c_custkey", X.digits_only("c_name").alias("n"), X.digits_only("c_mktsegment").alias("zero")
    )


@query(
    "x13_glob_match",
    """SELECT p_partkey, p_type GLOB 'S*' AS starts, p_type GLOB '*MO' AS ends, p_type GLOB '*AR*' AS within,
      p_type GLOB '?[MT]*' AS shape, p_name GLOB '*e* ?o*' AS both_words, p_type = 'PROMO' AS whole FROM part""",
)
def x13_glob_match(t: Tables):
    g = X.glob_match
    return t.part.select(
        "p_partkey", g("p_type", "S*").alias("starts"), g("p_type", "*MO").alias("ends"),
        g("p_type", "*AR*").alias("within"), g("p_type", "?[MT]*").alias("shape"),
        g("p_name", "*e* ?o*").alias("both_words"), g("p_type", "PROMO").alias("whole"),
    )


@query(
    "x14_display_status",
    """SELECT event_id, CASE WHEN value > 60 THEN 'warning' ELSE 'ok' END AS two,
      CASE WHEN value > 80 THEN 'danger' WHEN value > 60 THEN 'warning' ELSE 'ok' END AS three FROM events""",
)
def x14_display_status(t: Tables):
    return t.events.select(
        "event_id", X.display_status("value", 60).alias("two"), X.display_status("value", 60, 80).alias("three")
    )


@query(
    "x15_default_value",
    """SELECT event_id, CASE event_id % 3 WHEN 2 THEN props ELSE 'none' END AS v FROM events""",
)
def x15_default_value(t: Tables):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, "").when(k == 2, F.col("props"))
    return t.events.select("event_id", X.default_value(raw, "none").alias("v"))


@query(
    "x16_extract_between",
    f"""WITH {V.LOGS} SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp,
      CASE WHEN action = 'threat_detected' THEN 'rule R' || k || ' matched' END AS threat,
      CASE WHEN action = 'threat_detected' THEN 'R' || k END AS rule FROM logs""",
)
def x16_extract_between(t: Tables):
    lines = V.logs(t).select("event_id", sinks.log_line().alias("line"))
    return lines.select(
        "event_id", X.extract_between("line", "[", "]").alias("stamp"),
        X.extract_between("line", "THREAT DETECTED: ").alias("threat"),
        X.extract_between("line", "THREAT DETECTED: rule ", " matched").alias("rule"),
    )


ITEMS = r"list_filter(list_transform(string_split(text, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query("x17_list_to_array", f"SELECT doc_id, len({ITEMS}) AS n, {ITEMS}[1] AS first FROM documents")
def x17_list_to_array(t: Tables):
    items = X.list_to_array("text", ",")
    return t.documents.select(
        "doc_id", F.size(items).cast("bigint").alias("n"), F.get(items, F.lit(0)).alias("first")
    )


@query("x18_array_to_list", f"SELECT doc_id, array_to_string({ITEMS}, '|') AS list FROM documents")
def x18_array_to_list(t: Tables):
    return t.documents.select("doc_id", X.array_to_list(X.list_to_array("text", ","), "|").alias("list"))


LOOKUP = ["EICAR_Test_File", "Webshell_Generic", "Unknown_Rule"]


@query(
    "x19_map_lookup",
    f"""SELECT doc_id, CASE r WHEN 'EICAR_Test_File' THEN 'EICAR Test' WHEN 'Webshell_Generic' THEN 'Webshell' END AS found
    FROM (SELECT doc_id, {pick_sql(LOOKUP)} AS r FROM documents)""",
)
def x19_map_lookup(t: Tables):
    table = X.literal_map(fixed.FRIENDLY_NAMES)
    return t.documents.select("doc_id", X.map_lookup(table, pick(LOOKUP)).alias("found"))


@query(
    "x20_json_field",
    """SELECT event_id, json_extract_string(props, '$.k') AS k,
      CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 AS is_yara FROM events""",
)
def x20_json_field(t: Tables):
    k = V.k_of()
    groups = F.when(k % 2 == 0, '["syscheck", "yara"]').otherwise('["syscheck"]')
    doc = F.concat(F.lit('{"rule": {"groups": '), groups, F.lit("}}"))
    return t.events.select(
        "event_id", X.json_field("props", "$.k").alias("k"),
        X.json_array_has(doc, "$.rule.groups", "yara").alias("is_yara"),
    )


@query(
    "x21_xml",
    """SELECT page_id, nullif(regexp_extract(html, 'lang="([^"]*)"', 1), '') AS lang,
      nullif(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), '') AS title FROM pages""",
)
def x21_xml(t: Tables):
    return t.pages.select("page_id", X.xml_attr("html", "lang").alias("lang"), X.xml_body("html", "title").alias("title"))


@query(
    "x22_dates",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) - 7 AS week_before, strftime(o_orderdate, '%b %d') AS label,
      strftime(o_orderdate, '%Y%m%d') AS compact FROM orders""",
)
def x22_dates(t: Tables):
    return t.orders.select(
        "o_orderkey", X.days_ago("o_orderdate", 7).alias("week_before"), X.date_fmt("o_orderdate", "MMM dd").alias("label"),
        X.date_fmt("o_orderdate", "yyyyMMdd").alias("compact"),
    )


@query(
    "x23_epoch",
    "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, date_trunc('second', ts) AS back FROM events",
)
def x23_epoch(t: Tables):
    sec = X.to_epoch("ts")
    return t.events.select("event_id", sec.alias("sec"), V.ntz(X.from_epoch(sec)).alias("back"))


@query("x24_minutes_to_reset", "SELECT event_id, CAST(60 - minute(ts) % 60 AS INTEGER) AS minutes FROM events")
def x24_minutes_to_reset(t: Tables):
    return t.events.select("event_id", X.minutes_to_reset("ts").alias("minutes"))


@query(
    "x25_int_div",
    """SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) // 1024 AS kb,
      -(CAST(trunc(o_totalprice) AS BIGINT) // 1024) AS negative FROM orders""",
)
def x25_int_div(t: Tables):
    whole = F.col("o_totalprice").cast("bigint")
    return t.orders.select(
        "o_orderkey", X.int_div(whole, F.lit(1024)).alias("kb"), X.int_div(-whole, F.lit(1024)).alias("negative")
    )


VERSIONS = ["13.7", "14", "14.0.1", "v13", "13.", ""]


@query(
    "x26_version_format_ok",
    f"""SELECT s_suppkey, regexp_matches(v, '^[0-9]+(\\.[0-9]+)?$') AS ok
    FROM (SELECT s_suppkey, {pick_sql(VERSIONS, 's_suppkey')} AS v FROM supplier)""",
)
def x26_version_format_ok(t: Tables):
    return t.supplier.select("s_suppkey", X.version_format_ok(pick(VERSIONS, "s_suppkey")).alias("ok"))


@query("x27_strip_ansi", f"WITH {V.LOGS} SELECT event_id, '[' || level || '] ' || msg AS line FROM logs")
def x27_strip_ansi(t: Tables):
    coloured = F.concat(F.lit("\x1b[1;33m["), "level", F.lit("]\x1b[0m "), "msg")
    return V.logs(t).select("event_id", X.strip_ansi(coloured).alias("line"))


@query(
    "x28_pad",
    """SELECT p_partkey, CASE WHEN length(p_name) < 12 THEN rpad(p_name, 12, ' ') ELSE p_name END AS left_aligned,
      CASE WHEN length(p_brand) < 10 THEN lpad(p_brand, 10, ' ') ELSE p_brand END AS right_aligned FROM part""",
)
def x28_pad(t: Tables):
    return t.part.select(
        "p_partkey", X.pad("p_name", 12).alias("left_aligned"), X.pad("p_brand", 10, "left").alias("right_aligned")
    )


FRIENDLY = [n for n, _ in fixed.FRIENDLY_NAMES] + ["Other_Rule"]


@query(
    "x29_friendly_threat",
    "SELECT doc_id, CASE r "
    + " ".join(f"WHEN {V.quote(n)} THEN {V.quote(d)}" for n, d in fixed.FRIENDLY_NAMES)
    + f" ELSE r END AS name FROM (SELECT doc_id, {pick_sql(FRIENDLY)} AS r FROM documents)",
)
def x29_friendly_threat(t: Tables):
    return t.documents.select("doc_id", X.friendly_threat(pick(FRIENDLY)).alias("name"))


BYTES = "(n_chars * (CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 977 WHEN 2 THEN 1000003 ELSE 3 END))"


@query("x30_human_size", f"SELECT doc_id, {human_sql('b')} AS size FROM (SELECT doc_id, {BYTES} AS b FROM documents)")
def x30_human_size(t: Tables):
    k = F.col("doc_id") % 4
    scaled = F.col("n_chars") * F.when(k == 0, 1).when(k == 1, 977).when(k == 2, 1000003).otherwise(3)
    return t.documents.select("doc_id", scaled.alias("b")).select("doc_id", X.human_size("b").alias("size"))
