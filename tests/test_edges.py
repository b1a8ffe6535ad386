"""Hand-made edge rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sigward import session
from sigward.functions import fixed
from sigward.functions import scalars as X
from sigward.operators import aggregates, filters, joins, matching, retention, windows
from sigward.sources import readers, sinks


def one(spark, value, fn, kind="STRING"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn("c").alias("r")).first()["r"]


@pytest.mark.parametrize(
    "fn, value, want",
    [
        (lambda c: X.split_fields(c, 2), "  rule\t/tmp/x  y", "/tmp/x"),
        (lambda c: X.split_fields(c, 5), "a b", ""),
        (X.clean_path, "/tmp/a\\n", "/tmp/a"),
        (X.clean_path, "/tmp/a\r\n  ", "/tmp/a"),
        (X.basename, "/a/b/c.txt", "c.txt"),
        (X.dirname, "/a/b/c.txt", "/a/b"),
        (lambda c: X.truncate_label(c, 16, 13), "Seventeen_letters", "Seventeen_let..."),
        (lambda c: X.truncate_label(c, 16, 13), "Sixteen__letters", "Sixteen__letters"),
        (X.penultimate_segment, "a.sh.Rule_X.20250908_143022", "Rule_X"),
        (X.penultimate_segment, "nodot", "nodot"),
        (X.quarantine_suffix, "a.sh.Rule_X.20250908_143022", "Rule_X"),
        (X.quarantine_suffix, "a.sh.quarantine.143022_5678", None),
        (X.quarantine_suffix, "a.sh.1725000000.Rule_X", None),
        (lambda c: X.date_from_path(c, F.lit("2024-01-31").cast("date")), "/q/20250908/x.20240101", "2025-09-08"),
        (lambda c: X.date_from_path(c, F.lit("2024-01-31").cast("date")), "/q/x", "2024-01-31"),
        (X.kv_value, "Original Path: /a:b ", "/a:b"),
        (X.digits_only, "12 rules, 3", 123),
        (X.digits_only, "none", 0),
        (lambda c: X.glob_match(c, "test_*.html"), "test_1.html", True),
        (lambda c: X.glob_match(c, "test_*.html"), "my_test_1.html", False),
        (lambda c: X.glob_match(c, "*.yar"), "a.yara", False),
        (lambda c: X.glob_match(c, "a[0-9]?"), "a7x", True),
        (lambda c: X.glob_match(c, "[!a]*"), "abc", False),
        (lambda c: X.default_value(c, "d"), "", "d"),
        (lambda c: X.extract_between(c, "[", "]"), "x [a] [b]", "a"),
        (lambda c: X.extract_between(c, "THREAT DETECTED: rule ", " matched"), "no marks", None),
        (lambda c: X.array_to_list(X.list_to_array(c, ","), "|"), " a, ,b ,", "a|b"),
        (lambda c: X.json_field(c, "$.updated_at"), '{"updated_at":"2024"}', "2024"),
        (lambda c: X.json_array_has(c, "$.rule.groups", "yara"), '{"rule":{"groups":["x","yara"]}}', True),
        (lambda c: X.json_array_has(c, "$.rule.groups", "yara"), "{}", False),
        (lambda c: X.xml_attr(c, "realtime"), '<directories realtime="yes">/etc</directories>', "yes"),
        (lambda c: X.xml_body(c, "directories"), '<directories realtime="yes">/etc</directories>', "/etc"),
        (X.strip_ansi, "\x1b[0;32m[INFO]\x1b[0m x", "[INFO] x"),
        (X.version_format_ok, "14.0.1", False),
        (lambda c: X.pad(c, 5), "ab", "ab   "),
        (lambda c: X.pad(c, 1), "ab", "ab"),
        (X.html_escape, "<a>&", "&lt;a&gt;&"),
        (joins.display_name, "IP", "IP Address Pattern"),
        (lambda c: joins.display_name(c, True), "SUSP_EICAR_x", "Suspected EICAR"),
        (joins.display_name, "EICAR_x", "EICAR_x"),
        (X.friendly_threat, "Webshell_Generic", "Webshell"),
        (filters.alert_level, "YARA: Threat detected - X - File: /a - Quarantined: q", 12),
        (filters.alert_level, "2024-01-30 01:02:03 YARA: Threat detected - X - File: /a - Quarantined: q", 12),
        (filters.alert_level, "YARA: hello", 0),
        (filters.alert_level, "Threat detected", None),
    ],
)
def test_scalar(spark, fn, value, want):
    assert one(spark, value, fn) == want


@pytest.mark.parametrize(
    "size, want",
    [(0, "0"), (1023, "1023"), (1024, "1.0K"), (1025, "1.1K"), (10240, "10K"), (10241, "11K"), (1047552, "1023K"),
     (1047553, "1.0M"), (5 * 1024**3, "5.0G"), (1023 * 1024**3, "1023G"), (5 * 1024**4, "5.0T"), (3 * 1024**5, "3.0P")],
)
def test_human_size(spark, size, want):
    assert one(spark, size, X.human_size, "BIGINT") == want


def test_int_div_cuts_towards_zero(spark):
    assert one(spark, -7, lambda c: X.int_div(c, F.lit(2)), "BIGINT") == -3
    assert one(spark, 2**62 + 1, lambda c: X.int_div(c, F.lit(1)), "BIGINT") == 2**62 + 1


def test_descriptions_take_the_first_word_that_fits(spark):
    texts = dict(fixed.THREAT_DESCRIPTIONS)
    assert one(spark, "XZ_Backdoor", joins.threat_description) == texts["Backdoor"]
    assert one(spark, "Trojan_Mirai", joins.threat_description) == texts["Trojan"]
    assert one(spark, "else", joins.threat_description) == fixed.DEFAULT_DESCRIPTION


def test_match_lines(spark):
    lines = ["", "warning: x", "OneField", "R /tmp/a\\n", "R /tmp/b\r", "  R   /tmp/c  "]
    got = filters.parse_matches(spark.createDataFrame([(x,) for x in lines], "value STRING")).collect()
    assert [tuple(r) for r in got] == [("R", "/tmp/a"), ("R", "/tmp/b"), ("R", "/tmp/c")]


def test_ages(spark):
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    ages = [0.99, 1.0, 7.0, 7.99, 8.0, 29.99, 30.0, 30.99, 31.0]
    rows = [(a, dt.datetime(2024, 1, 31) - dt.timedelta(days=a)) for a in ages]
    df = spark.createDataFrame(rows, "age DOUBLE, ts TIMESTAMP")
    tiers = {r["age"]: r["tier"] for r in retention.tier(df, "ts", as_of).collect()}
    assert tiers == {
        0.99: "hot", 1.0: "hot", 7.0: "hot", 7.99: "hot", 8.0: "compress", 29.99: "compress", 30.0: "boundary",
        30.99: "boundary", 31.0: "expired",
    }
    kept, gone, counts = retention.expire(df, "ts", as_of)
    assert [r["age"] for r in gone.collect()] == [31.0]
    assert tuple(counts.first()) == (9, 1, 8) and kept.count() == 8
    young = retention.age_filter(df, "ts", as_of, "-", 1)
    assert [r["age"] for r in young.collect()] == [0.99]


def test_minutes_are_not_floored(spark):
    as_of = F.lit("2024-01-31 01:00:01").cast("timestamp")
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31),), (dt.datetime(2024, 1, 31, 0, 0, 1),)], "ts TIMESTAMP")
    assert retention.age_filter(df, "ts", as_of, "+", 60, "minutes").count() == 1


def test_excluded_directory_keeps_its_sibling(spark):
    df = spark.createDataFrame([("/opt/yara",), ("/opt/yara/x",), ("/opt/yara2/x",)], "path STRING")
    assert [r["path"] for r in filters.exclude_dirs(df, ["/opt/yara"]).collect()] == ["/opt/yara2/x"]


def test_monitor_mode_and_xml(spark, tmp_path):
    xml = tmp_path / "agent.conf"
    xml.write_text(
        '<agent_config><syscheck><directories>/etc, /opt/yara</directories>'
        '<directories realtime="yes">/etc</directories></syscheck></agent_config>'
    )
    rows = readers.read_monitored_dirs(spark, str(xml))
    assert {tuple(r) for r in aggregates.monitor_mode(rows).collect()} == {("/etc", "realtime"), ("/opt/yara", "scheduled")}


def test_scores_at_their_bounds(spark):
    rows = [(80.0, 80.9, 80.0, 10), (81.0, 10.0, 10.0, 11), (81.0, 81.0, 0.0, 0), (99.0, 99.0, 99.0, 11)]
    df = spark.createDataFrame(rows, "cpu DOUBLE, mem DOUBLE, disk DOUBLE, detections BIGINT")
    got = [(r["score"], r["health"]) for r in aggregates.health_score(df).collect()]
    assert got == [(100, "EXCELLENT"), (70, "GOOD"), (60, "GOOD"), (30, "WARNING")]


RULES = r'''import "elf"
// a comment
rule First : tag {
    meta:
        description = "one"
    strings:
        $a = "quo\"ted \\ back\n"
        $b = {6D 61 6C}
    condition:
        2 of them
}
rule NoCondition {
    strings:
        $a = "x"
}
rule Undeclared {
    strings:
        $a = "x"
    condition:
        $b
}
'''


def test_rule_text(spark, tmp_path):
    feed = tmp_path / "feedx"
    feed.mkdir()
    (feed / "one.yar").write_text(RULES)
    (feed / "readme.md").write_text("rule Not {\n}")
    rules = readers.read_rules(spark, str(tmp_path)).orderBy("rule_no")
    rows = rules.collect()
    assert [r["rule_name"] for r in rows] == ["First", "NoCondition", "Undeclared"]
    assert rows[0]["feed"] == "feedx" and rows[0]["meta"] == {"description": "one"} and rows[0]["min_hits"] == 2
    strings = {r["string_id"]: (r["kind"], r["pattern"]) for r in readers.rule_strings(rules.limit(1)).collect()}
    assert strings == {"$a": ("text", 'quo"ted \\ back\n'), "$b": ("hex", "{6D 61 6C}")}
    working, broken = matching.validate_rules(rules)
    assert [r["rule_name"] for r in working.collect()] == ["First"]
    assert {(r["rule_name"], r["problem"]) for r in broken.collect()} == {
        ("NoCondition", "no condition"), ("Undeclared", "undeclared string"),
    }


def test_base_rules_count_overlaps(spark):
    r, s = readers.base_rules(spark)
    files = [("/a", "a", "shell_exec(1)"), ("/b", "b", "exec(1)"), ("/c", "c", fixed.BASE_RULES[0][2][0][1])]
    f = spark.createDataFrame(files, "path STRING, name STRING, content STRING")
    assert {tuple(x) for x in matching.scan(f, r, s).collect()} == {("Webshell_Generic", "/a"), ("EICAR_Test_File", "/c")}


def test_same_rule_in_two_feeds(spark):
    rows = [
        ("R", "f2", 2, "a.yar", 0, "rule R {\n  x\n}"), ("R", "f1", 1, "b.yar", 0, "rule R { x }"),
        ("S", "f3", 3, "c.yar", 0, "rule S {   x   }"),
    ]
    df = spark.createDataFrame(rows, "rule_name STRING, feed STRING, priority INT, file_name STRING, rule_no INT, body STRING")
    assert {(r["rule_name"], r["feed"]) for r in windows.dedupe_rules(df).collect()} == {("R", "f1"), ("S", "f3")}
    assert [r["feed"] for r in windows.dedupe_rules(df, "body").collect()] == ["f1"]


def test_scan_files_skips_missing_roots(spark, tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    (tmp_path / "a" / "deep" / "x.txt").write_bytes(b"\xff\xfeabc")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "y.bin").write_bytes(b"worthless")
    roots = [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "none")]
    files = readers.scan_files(spark, roots)
    assert {(r["name"], r["size_bytes"]) for r in files.collect()} == {("x.txt", 5), ("y.bin", 9)}
    assert readers.scan_files(spark, [str(tmp_path / "none")]).count() == 0
    strings = spark.createDataFrame(
        [("R", "$a", "text", "less"), ("H", "$h", "hex", "{FF FE}")],
        "rule_name STRING, string_id STRING, kind STRING, pattern STRING",
    )
    hits = {(r["path"].rsplit("/", 1)[1], r["rule_name"]) for r in matching.match_strings(files, strings).collect()}
    assert hits == {("y.bin", "R"), ("x.txt", "H")}


def test_log_order_within_large_files(spark, tmp_path):
    """Line numbers grow with the position, also when a file is read in several splits."""
    path = tmp_path / "app.log"
    path.write_text("".join(f"[2024-01-01 00:00:00] [INFO] line {i:05d}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        logs = readers.read_logs(spark, str(path))
        rows = logs.orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["msg"] for r in rows] == [f"line {i:05d}" for i in range(5000)]
    assert rows[0]["level"] == "INFO" and rows[0]["log_file"] == str(path)


def test_sidecar_round_trip_and_missing_keys(spark):
    row = spark.createDataFrame([("/a:b", "R", "x" * 64)], "orig_path STRING, rule_name STRING, sha256 STRING")
    text = row.select(sinks.sidecar_text(q_time=F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("text"))
    got = readers.read_sidecar(text).first()
    assert (got["orig_path"], got["rule_name"], got["q_time"]) == ("/a:b", "R", "2024-01-31 00:00:00")
    assert readers.read_sidecar(spark.createDataFrame([("SHA256: a",)], "text STRING")).first()["orig_path"] is None


def test_first_available_falls_through(spark):
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "v INT")
    got = readers.first_available([(1, df()), (2, df(5, 6)), (3, df(7))])
    assert sorted(r["v"] for r in got.collect()) == [5, 6]
    assert readers.first_available([(1, df()), (2, df())]).count() == 0


def test_guard_keeps_everything(spark):
    df = spark.createDataFrame([(1,), (10,), (11,)], "size_bytes BIGINT")
    assert sorted(tuple(r) for r in matching.guard(df, 10).collect()) == [(1, False), (10, False), (11, True)]


def test_same_path_and_same_id_are_judged_apart(spark, monkeypatch):
    files = spark.createDataFrame([("/a", "a", "foo"), ("/a", "a", "bar"), ("/b", "b", "bar")], "path STRING, name STRING, content STRING")
    rules = spark.createDataFrame([("R", 2, None), ("S", 1, None)], "rule_name STRING, min_hits INT, only_id STRING")
    strings = [(r, i, "text", p) for r in "RS" for i, p in (("$a", "foo"), ("$b", "bar"), ("$a", "baz"))]
    strings = spark.createDataFrame(strings, "rule_name STRING, string_id STRING, kind STRING, pattern STRING")
    want = [("S", "/a"), ("S", "/a"), ("S", "/b")]
    assert sorted(tuple(r) for r in matching.scan(files, rules, strings).collect()) == want
    twice = files.unionByName(files)
    assert sorted(tuple(r) for r in matching.scan(twice, rules, strings).collect()) == sorted(want * 2)
    by_hits = matching.eval_conditions(matching.match_strings(twice, strings), rules)
    assert sorted(tuple(r) for r in by_hits.collect()) == sorted(want * 2)
    monkeypatch.setattr(session, "LITERAL_STRINGS", 1)
    assert sorted(tuple(r) for r in matching.scan(files, rules, strings).collect()) == want
    assert sorted(tuple(r) for r in matching.scan(twice, rules, strings).collect()) == sorted(want * 2)
    by_hits = matching.eval_conditions(matching.match_strings(twice, strings), rules)
    assert sorted(tuple(r) for r in by_hits.collect()) == sorted(want * 2)
    same = strings.where("string_id = '$a'")
    assert sorted(r["path"] for r in matching.match_strings(files, same.where("rule_name = 'R'")).collect()) == ["/a"]


@pytest.mark.parametrize("glob", ["*", "?", "a*", "*a", "*a*", "a?b", "[ab]*", "[!a]?", "a.b", "a+(b)", "x{1}*", "**", "[a-c]b*d"])
def test_globs_equal_the_shell(glob):
    import fnmatch
    import itertools
    import re

    texts = ["".join(t) for n in range(5) for t in itertools.product("ab.d", repeat=n)] + ["a+(b)", "x{1}y", "a\nb"]
    want = re.compile(fnmatch.translate(glob))
    got = re.compile(X.glob_regex(glob))
    assert [t for t in texts if got.search(t)] == [t for t in texts if want.match(t)]


def test_digits_beyond_a_bigint_give_null(spark):
    assert one(spark, "9" * 25, X.digits_only) is None


@pytest.mark.parametrize(
    "condition, hits, ident",
    [("any of them", 1, None), ("3 of them", 3, None), (" $a ", 1, "$a"), ("0 of them", None, None), ("all of them", None, None)],
)
def test_conditions(spark, condition, hits, ident):
    assert one(spark, condition, readers.min_hits) == hits
    assert one(spark, condition, readers.only_string) == ident


def test_missing_content_and_unknown_conditions_never_match(spark):
    files = spark.createDataFrame([("/a", "a", None), ("/b", "b", "xy")], "path STRING, name STRING, content STRING")
    rules = spark.createDataFrame(
        [("R", 1, None), ("Unknown", None, None), ("Undeclared", 1, "$zz")], "rule_name STRING, min_hits INT, only_id STRING"
    )
    strings = spark.createDataFrame(
        [(n, "$a", "text", "x") for n in ("R", "Unknown", "Undeclared")],
        "rule_name STRING, string_id STRING, kind STRING, pattern STRING",
    )
    assert [tuple(r) for r in matching.scan(files, rules, strings).collect()] == [("R", "/b")]
    grouped = matching.eval_conditions(matching.match_strings_indexed(files, strings), rules)
    assert [tuple(r) for r in grouped.collect()] == [("R", "/b")]


def test_scratch_folder_follows_the_cluster(spark):

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or "/tmp/"
    first, second = session.scratch_dir(spark, "x"), session.scratch_dir(spark, "x")
    assert first.startswith(base) and first != second
    assert session.written(spark.range(5), "numbers").count() == 5


@pytest.mark.parametrize("glob, tail, want", [("a*b*c", "c", True), ("a*b*c", "d", False), ("*b*b*b*x*", "", False), ("*?b[ab]*b", "b", True)])
def test_globs_on_long_texts(spark, glob, tail, want):
    assert one(spark, "a" + "ba" * 10_000 + tail, lambda c: X.glob_match(c, glob)) is want


def test_first_available_reads_no_further(spark):
    broken = spark.range(1).select(F.raise_error(F.lit("was read")).cast("int").alias("v"))
    first = spark.createDataFrame([(1,)], "v INT")
    assert [r["v"] for r in readers.first_available([(2, broken), (1, first)]).collect()] == [1]


def test_scratch_folder_must_be_shared_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace


    conf = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        session.scratch_dir(SimpleNamespace(conf=conf, sparkContext=context), "x")


RULE_SHAPES = r'''
import "pe"
private rule Hidden : tag { strings: $a = "one" condition: $a }
rule Line { meta: author = "x" strings: $a = "a condition \" text" $b = { 6D 6C } condition: any of them }
rule Loose
{
    strings:
        // $gone = "commented out"
        $a = "shell" nocase wide
        $b = "plain" ascii
    condition:
        any of them // one is enough
}
rule Wild { strings: $h = { 6D ?? 6C } $t = "t" condition: any of them }
global private rule Pattern {
    strings:
        $r = /ev[ai]l\/x/i
        $t = "t"
    condition:
        1 of them /* or
        more */
}
rule Last {
    strings:
        $a = "z" private
    condition:
        $a
}
'''


def test_rules_of_all_shapes_are_kept(spark):
    text = spark.createDataFrame([(RULE_SHAPES, "f", "a.yar")], "value STRING, feed STRING, file_name STRING")
    parsed = readers.parse_rules(text)
    rows = {r["rule_name"]: r for r in parsed.collect()}
    assert list(rows) == ["Hidden", "Line", "Loose", "Wild", "Pattern", "Last"]
    assert len({r["rule_id"] for r in rows.values()}) == 6
    found = {n: [(s["string_id"], s["kind"], s["pattern"], s["modifiers"]) for s in r["strings"]] for n, r in rows.items()}
    assert found["Hidden"] == [("$a", "text", "one", [])]
    assert found["Line"] == [("$a", "text", 'a condition " text', []), ("$b", "hex", "{ 6D 6C }", [])]
    assert found["Loose"] == [("$a", "text", "shell", ["nocase", "wide"]), ("$b", "text", "plain", ["ascii"])]
    assert found["Wild"][0][1:3] == ("hex pattern", "{ 6D ?? 6C }") and found["Pattern"][0][1:3] == ("regex", "/ev[ai]l\\/x/i")
    assert [rows[n]["min_hits"] for n in rows] == [1] * 6
    working, broken = matching.validate_rules(parsed)
    assert sorted(r["rule_name"] for r in working.collect()) == ["Hidden", "Last", "Line"]
    assert {r["rule_name"]: r["problem"] for r in broken.collect()} == {"Loose": "unsupported modifier", "Wild": "unsupported string", "Pattern": "unsupported string"}
