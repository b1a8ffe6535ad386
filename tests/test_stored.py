"""Stored tables: expiry in place, compaction, counts of the writing job, pruned look-ups; files that arrive in a folder; odd alerts."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sigward.operators import chains, matching, retention
from sigward.sources import readers, sinks
from sigward.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def as_of():
    return F.lit("2024-01-31 09:30:00").cast("timestamp")


def snapshot(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


@pytest.fixture()
def stored(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(hours=i)) for i in range(30 * 24)] + [(9000 + i, None) for i in range(3)]
    df = spark.createDataFrame(rows, "event_id BIGINT, ts TIMESTAMP").withColumn("day", F.to_date("ts"))
    path = str(tmp_path / "stored")
    df.write.partitionBy("day").parquet(path)
    return df, path


def test_expiry_rewrites_only_days_that_lose_rows(spark, stored):
    df, path = stored
    before = snapshot(path)
    counts = {r["day"]: (r["before"], r["removed"], r["remaining"]) for r in retention.expire_stored(spark, path, "ts", as_of(), 20).collect()}
    limit = dt.datetime(2024, 1, 31, 9, 30) - dt.timedelta(days=21)
    kept = sorted(r["event_id"] for r in df.collect() if r["ts"] is None or r["ts"] > limit)
    assert sorted(r["event_id"] for r in spark.read.parquet(path).collect()) == kept
    assert counts[dt.date(2024, 1, 10)] == (24, 10, 14) and counts[dt.date(2024, 1, 9)] == (24, 24, 0) and len(counts) == 10
    after = snapshot(path)
    untouched = {f: t for f, t in before.items() if f"day=2024-01-{11}" <= f.split("/")[-2] or "HIVE" in f}
    assert untouched and all(after.get(f) == t for f, t in untouched.items())
    assert not any("day=2024-01-09" in f for f in after)


def test_expiry_may_be_repeated(spark, stored):
    _, path = stored
    retention.expire_stored(spark, path, "ts", as_of(), 20)
    first = snapshot(path)
    assert retention.expire_stored(spark, path, "ts", as_of(), 20).count() == 0 and snapshot(path) == first


def test_compaction_joins_small_files_and_leaves_large_days(spark, tmp_path):
    path = str(tmp_path / "log")
    lines = spark.range(3000).select(F.col("id").alias("n"), F.concat(F.lit("line "), F.format_string("%06d", "id")).alias("value"))
    for i in range(10):
        lines.where(F.col("n") % 10 == i).select("value", F.lit("2024-01-01").alias("log_date")).coalesce(1).write.mode("append").partitionBy("log_date").text(path)
    lines.select("value", F.lit("2024-01-02").alias("log_date")).coalesce(1).write.mode("append").partitionBy("log_date").text(path)
    before = snapshot(path)
    read = lambda: sorted(tuple(r) for r in spark.read.text(path).select("value", "log_date").collect())
    want = read()
    done = sinks.compact_small_files(spark, path, 20_000).collect()
    assert [(str(r["log_date"]), r["files"], r["small"], r["slots"]) for r in done] == [("2024-01-01", 10, 10, 2)]
    after = snapshot(path)
    assert read() == want and sum("log_date=2024-01-01" in f for f in after) in (1, 2)
    assert {f: t for f, t in before.items() if "2024-01-02" in f} == {f: t for f, t in after.items() if "2024-01-02" in f}
    # Lines of a file stay together and in order.
    for f in (f for f in after if "2024-01-01" in f):
        own = [int(x.split()[1]) for x in open(f)]
        starts = [i for i, (a, b) in enumerate(zip(own, own[1:])) if b != a + 10]
        assert len(starts) < 10
    assert sinks.compact_small_files(spark, path, 10).count() == 0


def test_counts_come_from_the_job_that_writes(spark, tmp_path):
    rows = [("R", "f1", 1, "a.yar", 0, "rule R {\n x\n}"), ("R", "f2", 2, "b.yar", 0, "rule R {\n y\n}"), ("S", "f2", 2, "Android_s.yar", 0, "rule S { z }")]
    rules = spark.createDataFrame(rows, "rule_name STRING, feed STRING, priority INT, file_name STRING, rule_no INT, body STRING")
    group = "count-and-write"
    spark.sparkContext.setJobGroup(group, "")
    counts = chains.write_updated_rules(rules, str(tmp_path / "merged"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tuple(counts.first()) == (3, 1, 2) and spark.read.parquet(str(tmp_path / "merged")).count() == 1


def test_days_of_a_table_prune_folders(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(300).select((F.lit(T0) + F.make_dt_interval(F.col("id").cast("int") % 30)).alias("ts"), F.lit("INFO").alias("level"), F.col("id").cast("string").alias("msg"))
    sinks.write_daily_log(rows, path)
    spark.range(5).select(F.lit("2024-01-03").cast("date").alias("d"), F.col("id").alias("k")).write.parquet(str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days")).where("k > 2").select("d")
    found = readers.read_daily_logs(spark, path, days)
    assert {str(r["log_date"]) for r in found.collect()} == {"2024-01-03"} and found.count() == 10
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()


RULES = 'rule_name STRING, min_hits INT, only_id STRING'
STRINGS = 'rule_name STRING, string_id STRING, kind STRING, pattern STRING'


@pytest.mark.parametrize("literal", [True, False])
def test_files_in_a_folder_are_scanned_once(spark, tmp_path, monkeypatch, literal):
    """Three runs of one job, with files that arrive in between; the second run is ended by a failure of its sink."""
    n = 3 if literal else 80
    rules = spark.createDataFrame([(f"R{i}", 1, None) for i in range(n)], RULES)
    strings = spark.createDataFrame([(f"R{i}", "$a", "text", f"mark{i}!") for i in range(n)], STRINGS)
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    contents = {}

    def arrive(names):
        for name in names:
            contents[name] = f"text mark{int(name[1:]) % 5}! end".encode()
            (source / name).write_bytes(contents[name])

    def run():
        files = jobs.watch_files(spark, str(source), str(tmp_path / "archive"), 2).withColumn("item_id", F.lit(0))
        jobs.stream_scan(files, rules, strings, out, str(tmp_path / "cp"), F.lit(T0)).awaitTermination()

    def fail(*_):
        raise OSError("no place left")

    arrive([f"f{i}" for i in range(5)])
    run()
    arrive([f"f{i}" for i in range(5, 8)])
    with monkeypatch.context() as broken:
        broken.setattr(sinks, "write_alert_lines", fail)
        with pytest.raises(StreamingQueryException):
            run()
    arrive(["f8", "f9"])
    run()
    files = spark.createDataFrame([(f"/{k}", k, v) for k, v in contents.items()], "path STRING, name STRING, content BINARY")
    want = sorted((r["rule_name"], r["path"][1:]) for r in matching.scan(files, rules, strings).collect())
    found = spark.read.schema("rule_name STRING, path STRING").parquet(f"{out}/matches").collect()
    assert sorted((r["rule_name"], r["path"].rsplit("/", 1)[1]) for r in found) == want and want


def test_alerts_of_any_shape(spark):
    lines = {
        '{"timestamp": "2024-01-31 10:00:00", "rule": {"id": "5", "level": 12, "groups": ["a"]}}': (None, "5", 12),
        "": ("broken line", None, None), "not json": ("broken line", None, None), '{"rule": ': ("broken line", None, None), "[1, 2]": ("no rule", None, None), "7": ("no rule", None, None),
        '{"rule": "text"}': ("no rule", None, None), '{"rule": null}': ("no rule", None, None), '{"rule": {}}': (None, None, None),
        '{"rule": {"id": 5, "level": "12"}}': (None, "5", 12), '{"rule": {"id": 5, "level": "twelve"}}': ("wrong type: level", "5", None),
        '{"rule": {"id": null, "level": null}}': (None, None, None), '{"timestamp": "x", "rule": {"level": 1}}': ("wrong type: timestamp", None, 1),
    }
    df = spark.createDataFrame([(x,) for x in lines] + [(None,)], "value STRING")
    found = {r["value"]: (r["reason"], r["rule"]["id"], r["rule"]["level"]) for r in readers.parse_alerts_of_any_shape(df).collect()}
    assert found == lines | {None: ("broken line", None, None)}
