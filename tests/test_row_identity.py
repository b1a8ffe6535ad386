"""Hits stay with their file row and their rule, whatever plan finds them and however rows are dealt out."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sigward import session
from sigward.operators import chains, filters, matching
from sigward.sources import readers

RULE_TEXT = 'rule One {\n    strings:\n        $a = "foo"\n    condition:\n        $a\n}\nrule Two {\n    strings:\n        $a = "bar"\n        $b = "foo"\n    condition:\n        2 of them\n}\n'


def table(spark, rows, n=7):
    schema = "path STRING, name STRING, item_id BIGINT, size_bytes BIGINT, content STRING"
    return spark.createDataFrame([(p, p[1:], i, len(c.encode()), c) for i, (p, c) in enumerate(rows)], schema).repartition(n)


def many_rules(spark, n=90):
    """Rules of one string each, some of which occur nowhere."""
    rules = spark.createDataFrame([(f"R{i}", 1, None) for i in range(n)], "rule_name STRING, min_hits INT, only_id STRING")
    strings = spark.createDataFrame([(f"R{i}", "$a", "text", f"mark-{i}.") for i in range(n)], "rule_name STRING, string_id STRING, kind STRING, pattern STRING")
    return rules, strings


def test_matched_files_are_those_that_match(spark):
    rng = random.Random(5)
    rows = [(f"/p{i % 40}", " ".join(rng.choice(["mark-%d." % rng.randrange(300), "word"]) for _ in range(6))) for i in range(400)]
    rows += rows[:25]
    rules, strings = many_rules(spark)
    want = sorted((p, hashlib.sha256(c.encode()).hexdigest(), sorted({f"R{i}" for i in range(90) if f"mark-{i}." in c})) for p, c in rows)
    want = [w for w in want if w[2]]
    for files in (table(spark, rows), table(spark, rows).repartition(3), table(spark, rows).orderBy(F.rand(4))):
        found = matching.matched_files(files, rules, strings)
        assert found.columns == [*files.columns, "rule_names"]
        assert sorted((r["path"], hashlib.sha256(r["content"].encode()).hexdigest(), r["rule_names"]) for r in found.collect()) == want


def test_a_source_may_bring_its_own_key(spark):
    files = table(spark, [("/a", "mark-1."), ("/a", "mark-1.")]).withColumn("file_key", F.col("item_id").cast("string"))
    rules, strings = many_rules(spark)
    found = matching.matched_files(files, rules, strings).collect()
    assert sorted(r["file_key"] for r in found) == ["0", "1"] and matching.scan(files, rules, strings).count() == 2


def test_rules_from_files_meet_their_strings(spark, tmp_path):
    (tmp_path / "feed1").mkdir()
    (tmp_path / "feed1" / "x.yar").write_text(RULE_TEXT)
    files = table(spark, [("/a", "foo"), ("/b", "bar foo"), ("/c", "")])
    working, _ = matching.validate_rules(readers.read_rules(spark, str(tmp_path)))
    active, _ = filters.deny_rules(working)
    want = [("One", "/a"), ("One", "/b"), ("Two", "/b")]
    assert sorted(tuple(r) for r in matching.scan(files, active, readers.rule_strings(active)).collect()) == want
    chains.quarantine_matches(files, readers.read_rules(spark, str(tmp_path)), F.lit("2024-01-31 00:00:00").cast("timestamp"), str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["orig_path"], r["rule_name"], r["rule_names"]) for r in stored) == [("/a", "One", ["One"]), ("/b", "Two", ["One", "Two"])]


def test_rule_ids_on_one_side_only_are_an_error(spark):
    rules, strings = many_rules(spark, 3)
    with pytest.raises(ValueError):
        matching.scan(table(spark, [("/a", "x")]), rules.withColumn("rule_id", F.lit("x")), strings)


def brute(rows, strings):
    return sorted((p, r, i) for p, c in rows for r, i, pat in strings if pat.encode() in c.encode())


@pytest.mark.parametrize("literal", [64, 2])
def test_pieces_of_large_files(spark, monkeypatch, literal):
    """Strings that lie across cuts, at the first and at the last byte, of all kinds of keys."""
    monkeypatch.setattr(session, "LITERAL_STRINGS", literal)
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abc _.-;é\n") for _ in range(n))
    strings = [("T", f"$s{i}", s) for i, s in enumerate(["needle in hay", "-;-", "ending", "_x_", "é;é", "q" * 90, "see xyz", "xyz see"])]
    rows = []
    for i in range(24):
        text = noise(rng.choice([0, 1, 63, 64, 65, 640, 5000]))
        for _ in range(4):
            at = rng.choice([0, len(text), 58, 60, 64, 127, rng.randrange(len(text) + 1)])
            text = text[:at] + rng.choice(strings)[2] + text[at:]
        rows.append((f"/f{i % 20}", text))
    rows += [("/big", noise(700_000) + "needle in hay" + noise(50)), ("/none", ""), rows[3], rows[3]]
    files, table_of = table(spark, rows), spark.createDataFrame([(r, i, "text", p) for r, i, p in strings], "rule_name STRING, string_id STRING, kind STRING, pattern STRING")
    found = matching.match_strings(files, table_of, large_bytes=64, piece_bytes=64)
    assert sorted((r["path"], r["rule_name"], r["string_id"]) for r in found.collect()) == brute(rows, strings)
    rules = spark.createDataFrame([("T", 2, None)], "rule_name STRING, min_hits INT, only_id STRING")
    want = sorted(p for p, c in rows if sum(pat in c for *_, pat in strings) >= 2)
    for how in ({}, {"large_bytes": 64, "piece_bytes": 100}, {"large_bytes": 10**9}):
        assert sorted(r["path"] for r in matching.scan(files, rules, table_of, [], [], **how).collect()) == want
    by_hits = matching.eval_conditions(found, rules)
    assert sorted(r["path"] for r in by_hits.collect()) == want


def test_a_large_file_is_shared_by_tasks(spark):
    content = b"x" * 30_000_000 + b"needle here" + b"y" * 10_000_000
    files = spark.createDataFrame([("/big", "big", len(content), content)], "path STRING, name STRING, size_bytes BIGINT, content BINARY")
    files = matching.with_file_key(files)
    parts = matching.pieces(files, 10, 1 << 20, True)
    counts = [r["n"] for r in parts.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(counts) == 39 and len(counts) >= 6
    strings = spark.createDataFrame([("R", "$a", "text", "needle here"), ("R", "$b", "text", "needle there")], "rule_name STRING, string_id STRING, kind STRING, pattern STRING")
    assert [r["string_id"] for r in matching.match_strings(files, strings, large_bytes=1 << 20).collect()] == ["$a"]


def test_stream_scan_needs_no_measuring_job_per_batch(spark):
    """A prepared rule set holds what scans need; matching with it plans without a job."""
    ready = matching.rule_set(*many_rules(spark))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "")
    matching.matched_files(table(spark, [("/a", "mark-1.")]), ready)
    jobs = tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs


def test_look_ups_by_the_rarest_token(spark):
    """Tokens of most files are not what strings are looked up by, where a sample has shown them; the hits are the same."""
    rng = random.Random(8)
    rows = [(f"/p{i}", " ".join(["commonest", "word%d" % rng.randrange(200), "commonest", "x%d" % rng.randrange(9)])) for i in range(300)]
    files = table(spark, rows)
    rules, strings = many_rules(spark, 90)
    strings = strings.withColumn("pattern", F.concat(F.lit(" "), F.regexp_replace("string_id", ".*", ""), F.lit("word"), F.regexp_extract("rule_name", "[0-9]+", 0), F.lit(" commonest ")))
    common = matching.common_tokens(files, 1.0, 5)
    assert common.first()["token"] == "commonest" and common.count() <= 5
    ready = matching.rule_set(rules, strings, common)
    assert {r["look_up"][:5] for r in ready.keys.strings.collect()} == {"wword"}
    plain = matching.rule_set(rules, strings)
    assert {r["look_up"] for r in plain.keys.strings.collect()} == {"wcommonest"}
    found = [sorted(tuple(r) for r in matching.scan(files, s, None, [], []).collect()) for s in (ready, plain)]
    assert found[0] == found[1] and len(found[0]) > 30
