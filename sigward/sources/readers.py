"""Readers: files, logs, alerts, directory settings, rules, integrity rows, sidecars and state lines."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigward.functions import fixed
from sigward.functions import scalars as X

ALERT_SCHEMA = (
    "timestamp TIMESTAMP, rule STRUCT<id: STRING, level: INT, description: STRING, groups: ARRAY<STRING>>"
)
FILE_ENTRY_SCHEMA = "path STRING, mtime BIGINT"
LOG_PATTERN = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] (?:\[([A-Z]+)\] )?(.*)$"
AGENT_PATTERN = r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) (.*)$"
RULE_HEADER = r"(?:(?:private|global)\s+)*rule\s+\w+"
RULE_PATTERN = rf"(?ms)^[ \t]*({RULE_HEADER}.*?)(?=^[ \t]*{RULE_HEADER}|\z)"
MODIFIERS = r"(?:[ \t]+(?:nocase|wide|ascii|fullword|private|xor|base64wide|base64)\b(?:\([^)]*\))?)*"
STRING_PATTERN = (
    r'(?m)(?:^|[\s:])(\$\w*\s*=\s*(?:"[^"\\]*(?:\\.[^"\\]*)*+"|\{[^}]*\}|/(?:[^/\\\n]|\\.)++/[is]*)' + MODIFIERS + ")"
)
COMMENTS = r"//[^\n]*|(?s)/\*.*?\*/"
META_PATTERN = r'(?m)^\s*[A-Za-z]\w*\s*=\s*"[^"]*"'


# ---- files


def file_columns(path, content, size, mtime) -> list[Column]:
    path = X.col(path)
    return [
        path.alias("path"),
        X.basename(path).alias("name"),
        X.dirname(path).alias("dir"),
        X.col(size).cast("bigint").alias("size_bytes"),
        X.col(mtime).alias("mtime"),
        X.col(content).alias("content"),
    ]


EMPTY_FILES = "path STRING, name STRING, dir STRING, size_bytes BIGINT, mtime TIMESTAMP, content BINARY"


def scan_files(spark: SparkSession, roots: list[str], name_glob: str | None = None) -> DataFrame:
    """Recursive inventory of several roots; missing roots are skipped.

    `content` stays binary and is read only by plans that use it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    found = []
    for root in roots:
        try:
            found.append(reader.load(root))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    if not found:
        return spark.createDataFrame([], EMPTY_FILES)
    path = F.regexp_replace("path", r"^file:/+", "/")
    files = reduce(DataFrame.unionByName, found)
    return files.select(*file_columns(path, "content", "length", "modificationTime"))


# ---- logs


def parse_log_lines(df: DataFrame, line="value") -> DataFrame:
    """Adds ts, level and msg to lines `[ts] [LEVEL] msg`, `[ts] msg` or `YYYY/MM/DD hh:mm:ss msg`.

    Colour codes are removed first. Lines of another shape keep the whole text as msg.
    """
    text = X.strip_ansi(line)
    stamp = F.regexp_extract(text, LOG_PATTERN, 1)
    agent = F.regexp_extract(text, AGENT_PATTERN, 1)
    return df.withColumns(
        {
            "ts": F.coalesce(
                F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")),
                F.try_to_timestamp(agent, F.lit("yyyy/MM/dd HH:mm:ss")),
            ),
            "level": F.nullif(F.regexp_extract(text, LOG_PATTERN, 2), F.lit("")),
            "msg": F.when(stamp != "", F.regexp_extract(text, LOG_PATTERN, 3))
            .when(agent != "", F.regexp_extract(text, AGENT_PATTERN, 2))
            .otherwise(text),
        }
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """ts, level, msg, log_file, line_no of all log files below `path`.

    Files are read line by line in parallel splits. `line_no` is the start of the split plus the row within it, so
    it grows with the position of a line in its file; it orders lines and is not dense across splits.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    row_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = raw.select(
        "value",
        F.regexp_replace("_metadata.file_path", r"^file:/+", "/").alias("log_file"),
        (F.col("_metadata.file_block_start") + row_in_task).alias("line_no"),
    )
    return parse_log_lines(lines).select("ts", "level", "msg", "log_file", "line_no")


def read_daily_logs(spark: SparkSession, path: str, days: DataFrame | None = None, day: str = "log_date") -> DataFrame:
    """ts, level, msg and the day of a log stored in a folder for each day; with `days` (one date column), of those days only.

    The days are joined by the folder's column, so folders of other days are not opened when the plan runs.
    """
    lines = spark.read.text(path)
    if days is not None:
        lines = lines.join(days.toDF(day).distinct(), day, "left_semi")
    return parse_log_lines(lines).select("ts", "level", "msg", day)


# ---- alerts


def parse_alerts(df: DataFrame, line="value") -> DataFrame:
    return df.withColumn("a", F.from_json(line, ALERT_SCHEMA)).select("*", "a.timestamp", "a.rule").drop("a", line)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts, one JSON document per line, with the nested rule struct."""
    return spark.read.schema(ALERT_SCHEMA).json(path)


ALERT_FIELDS = {"id": "string", "level": "int", "description": "string", "groups": "array<string>"}


def parse_alerts_of_any_shape(df: DataFrame, line="value") -> DataFrame:
    """Adds timestamp, rule and `reason`: why a line is no alert as expected, null for one that is.

    A line that is no JSON is a `broken line`, one without a rule object has `no rule`, and one whose rule or time cannot be read as its type
    has a `wrong type` in the field that is named; the fields that can be read are there all the same.
    """
    v = F.col("_alert")
    at = lambda path, kind: F.try_variant_get(v, path, kind)
    wrong = [F.when(at(f"$.rule.{c}", "variant").isNotNull() & at(f"$.rule.{c}", kind).isNull() & (at(f"$.rule.{c}", "string") != "null"), f"wrong type: {c}") for c, kind in ALERT_FIELDS.items()]
    time = F.try_to_timestamp(at("$.timestamp", "string"))
    wrong.append(F.when(at("$.timestamp", "variant").isNotNull() & time.isNull(), "wrong type: timestamp"))
    reason = F.when(v.isNull(), "broken line").when(at("$.rule", "variant").isNull() | ~F.startswith(F.schema_of_variant(at("$.rule", "variant")), F.lit("OBJECT")), "no rule").otherwise(F.coalesce(*wrong))
    rule = F.struct(*[at(f"$.rule.{c}", kind).alias(c) for c, kind in ALERT_FIELDS.items()])
    parsed = df.withColumn("_alert", F.try_parse_json(F.col(line)))
    return parsed.withColumns({"timestamp": time, "rule": rule, "reason": reason}).drop("_alert")


# ---- monitored directories


def explode_monitored(df: DataFrame, body="body", realtime="realtime") -> DataFrame:
    """One row per directory of a comma list with its mode."""
    mode = F.when(F.lower(X.col(realtime)) == "yes", "realtime").otherwise("scheduled")
    return df.select(mode.alias("mode"), F.explode(X.list_to_array(body, ",")).alias("dir")).select("dir", "mode")


def read_monitored_dirs(spark: SparkSession, path: str) -> DataFrame:
    """`<directories realtime="yes">a,b</directories>` elements of the agent settings."""
    schema = "_VALUE STRING, _realtime STRING"
    rows = spark.read.format("xml").option("rowTag", "directories").schema(schema).load(path)
    return explode_monitored(rows, "_VALUE", "_realtime")


# ---- rules


def min_hits(condition) -> Column:
    """Distinct strings a condition asks for; null for a condition of another kind."""
    c = X.strip(condition)
    return (
        F.when(c == "any of them", F.lit(1))
        .when(c.rlike(r"^[1-9][0-9]* of them$"), F.regexp_extract(c, r"^([0-9]+)", 1).try_cast("int"))
        .when(c.rlike(r"^\$\w+$"), F.lit(1))
        .cast("int")
    )


def only_string(condition) -> Column:
    """The one string id named by a `$id` condition, else null."""
    return F.nullif(F.regexp_extract(X.strip(condition), r"^(\$\w+)$", 1), F.lit(""))


def parse_rules(df: DataFrame, text="value", feed="feed", file_name="file_name") -> DataFrame:
    """One row per rule of each rule text: rule_name, feed, file_name, body, meta, condition, min_hits, strings."""
    found = df.select(
        X.col(feed).alias("feed"),
        X.col(file_name).alias("file_name"),
        F.posexplode(F.regexp_extract_all(X.col(text), F.lit(RULE_PATTERN), F.lit(1))).alias("rule_no", "body"),
    )
    # A rule ends at the first brace that begins a line, else at the last brace before the next rule.
    ends = F.when(F.col("body").rlike(r"\n\}"), F.regexp_extract("body", r"(?s)^(.*?\n\})", 1)).otherwise(
        F.regexp_extract("body", r"(?s)^(.*\})", 1)
    )
    found = found.withColumn("body", F.coalesce(F.nullif(ends, F.lit("")), X.strip("body")))
    # Section names begin a line; in a rule without such lines they may stand anywhere.
    lined = F.col("body").rlike(r"\n\s*condition\s*:")
    section = lambda many, one: F.when(lined, F.regexp_extract("body", many, 1)).otherwise(F.regexp_extract("body", one, 1))
    meta_part = section(
        r"(?s)\n\s*meta\s*:(.*?)\n\s*(?:strings|condition)\s*:", r"(?s)[\s{]meta\s*:(.*?)[\s\"}](?:strings|condition)\s*:"
    )
    string_part = section(r"(?s)\n\s*strings\s*:(.*?)\n\s*condition\s*:", r"(?s)[\s{]strings\s*:(.*?)(?:\scondition\s*:|\}$)")
    string_part = F.regexp_replace(string_part, r"(?m)^\s*//[^\n]*$", "")
    condition_part = section(r"(?s)\n\s*condition\s*:(.*)\}$", r"(?s)[\s{]condition\s*:(.*)\}$")
    entry = lambda line: F.struct(
        strip_key(line).alias("key"), F.regexp_extract(line, r'=\s*"(.*)"$', 1).alias("value")
    )
    metas = F.transform(F.regexp_extract_all(meta_part, F.lit(META_PATTERN), F.lit(0)), entry)
    strings = F.transform(F.regexp_extract_all(string_part, F.lit(STRING_PATTERN), F.lit(1)), declared_string)
    condition = F.nullif(X.strip(F.regexp_replace(condition_part, COMMENTS, "")), F.lit(""))
    return found.select(
        F.concat_ws("/", "feed", "file_name", F.col("rule_no").cast("string")).alias("rule_id"),
        F.regexp_extract("body", r"^(?:(?:private|global)\s+)*rule\s+(\w+)", 1).alias("rule_name"),
        "feed",
        "file_name",
        "rule_no",
        "body",
        F.map_from_entries(metas).alias("meta"),
        condition.alias("condition"),
        min_hits(condition).alias("min_hits"),
        only_string(condition).alias("only_id"),
        strings.alias("strings"),
    )


def declared_string(line) -> Column:
    """string_id, kind, pattern and modifiers of a declared string, as written; kinds other than text and hex are kept as they are."""
    quoted = line.rlike(r'=\s*"')
    braces, slashes = F.regexp_extract(line, r"=\s*(\{[^}]*\})", 1), F.regexp_extract(line, r"=\s*(/.*/[is]*)", 1)
    plain_hex = braces.rlike(r"^\{[0-9A-Fa-f\s]*\}$")
    text = F.regexp_extract(line, r'(?s)=\s*"([^"\\]*(?:\\.[^"\\]*)*+)"', 1)
    after = F.regexp_extract(line, r'(?s)(?:"|\}|/[is]*)((?:[ \t]+[a-z0-9]+(?:\([^)]*\))?)*)$', 1)
    return F.struct(
        strip_key(line).alias("string_id"),
        F.when(quoted, "text").when(plain_hex, "hex").when(braces != "", "hex pattern").otherwise("regex").alias("kind"),
        F.when(quoted, unescape(text)).when(braces != "", braces).otherwise(slashes).alias("pattern"),
        F.filter(F.split(X.strip(after), r"\s+"), lambda w: w != "").alias("modifiers"),
    )


def strip_key(line) -> Column:
    return X.strip(F.substring_index(line, "=", 1))


def unescape(c) -> Column:
    """Quoted text with its escapes resolved; the backslash itself last, through a character no text holds."""
    mark = "\x00"
    c = F.replace(c, F.lit("\\\\"), F.lit(mark))
    for escaped, plain in (('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r")):
        c = F.replace(c, F.lit(escaped), F.lit(plain))
    return F.replace(c, F.lit(mark), F.lit("\\"))


def rule_strings(rules: DataFrame) -> DataFrame:
    """rule_name, string_id, kind, pattern and modifiers of parsed rules, with rule_id where the rules have it, so that strings meet their rule."""
    known = ["rule_id"] if "rule_id" in rules.columns else []
    return rules.select(*known, "rule_name", F.inline("strings"))


def base_rules(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The rules every corpus starts with: (rules, rule strings)."""
    rules = [(name, "base", "base_rules.yar", condition) for name, condition, _ in fixed.BASE_RULES]
    strings = [(name, ident, "text", text) for name, _, found in fixed.BASE_RULES for ident, text in found]
    table = spark.createDataFrame(rules, "rule_name STRING, feed STRING, file_name STRING, condition STRING")
    return (
        table.withColumns({"min_hits": min_hits("condition"), "only_id": only_string("condition")}),
        spark.createDataFrame(strings, "rule_name STRING, string_id STRING, kind STRING, pattern STRING"),
    )


def read_rules(
    spark: SparkSession, path: str, feed: str | None = None, name_glob: str = "*.{yar,yara}"
) -> DataFrame:
    """Rules of all rule files below `path`; the feed is the folder of a file unless given."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name_glob)
    raw = reader.text(path, wholetext=True)
    where = raw.select("value", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_name").alias("file_name"))
    name = F.lit(feed) if feed else X.basename(X.dirname("p"))
    return parse_rules(where.withColumn("feed", name))


# ---- integrity rows, sidecars, state lines, key files


def read_file_entry(spark: SparkSession, path: str) -> DataFrame:
    """path and mtime (epoch seconds) of the integrity database, exported as parquet."""
    return spark.read.schema(FILE_ENTRY_SCHEMA).parquet(path)


SIDECAR_FIELDS = [
    ("orig_path", "Original Path"),
    ("rule_name", "Detection Rule"),
    ("q_time", "Quarantine Time"),
    ("sha256", "SHA256"),
]


def read_sidecar(df: DataFrame, text="text") -> DataFrame:
    """Adds the fields of a `Key: value` text; a value may hold colons itself. Absent keys give null."""
    fields = {
        name: F.nullif(X.strip(F.regexp_extract(X.col(text), rf"(?m)^{key}:(.*)$", 1)), F.lit(""))
        for name, key in SIDECAR_FIELDS
    }
    return df.withColumns(fields)


def read_restart_state(df: DataFrame, line="value") -> DataFrame:
    """Adds ts for lines `epoch` or `epoch:n`; lines without a number are dropped."""
    epoch = F.get(F.split(X.strip(line), ":"), F.lit(0)).try_cast("bigint")
    return df.withColumn("ts", F.timestamp_seconds(epoch)).where(F.col("ts").isNotNull())


def first_column(df: DataFrame, text="value") -> DataFrame:
    """Adds the first field of the first line of a key file."""
    first_line = F.substring_index(X.col(text), "\n", 1)
    return df.withColumn("first_column", X.split_fields(first_line, 1))


def first_available(sources: list[tuple[int, DataFrame]]) -> DataFrame:
    """Rows of the non-empty source with the smallest priority number; a source after it is not read."""
    tagged = [df.withColumn("priority", F.lit(p)) for p, df in sorted(sources, key=lambda s: s[0])]
    return next((df for df in tagged if not df.isEmpty()), tagged[-1])


def keep_first_available(df: DataFrame, priority="priority") -> DataFrame:
    best = df.select(F.min(priority)).scalar()
    return df.where(F.col(priority) == best)
