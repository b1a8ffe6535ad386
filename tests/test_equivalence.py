"""Pairs of ways that must agree, and brute force on small fixtures, with keys that hold most of the rows."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigward import session
from sigward.operators import aggregates, filters, joins, matching, windows
from sigward.plans import views as V
from sigward.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def hit_rows(df):
    return sorted((r["path"], r["rule_name"], r["string_id"]) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gam", "delta", "eps", "zeta", "eta", "theta", "the", "of", "ü", "x{1}", "a.b"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "\n", ","]) for _ in range(n))
    files = [(f"/f{i}", f"f{i}", text(rng.randint(0, 60))) for i in range(60)]
    strings = []
    for i in range(150):
        source = rng.choice(files)[2] or "nothing here"
        a = rng.randint(0, max(len(source) - 1, 0))
        strings.append((f"r{i % 50}", f"$s{i}", "text", source[a : a + rng.randint(1, 40)] or "q"))
    strings += [("hex", "$h1", "hex", "{61 6C 70}"), ("hex", "$h2", "hex", "{FF FE}"), ("empty", "$e", "text", "")]
    f = spark.createDataFrame(files, "path STRING, name STRING, content STRING").cache()
    s = spark.createDataFrame(strings, "rule_name STRING, string_id STRING, kind STRING, pattern STRING").cache()
    brute = sorted(
        (p, r, i)
        for p, _, c in files
        for r, i, k, pat in strings
        if pat and (bytes.fromhex(pat.strip("{}")) if k == "hex" else pat.encode()) in c.encode()
    )
    return f, s, brute


def test_all_matching_ways_equal_brute_force(spark, corpus, monkeypatch):
    files, strings, brute = corpus
    assert brute
    assert hit_rows(matching.match_strings_indexed(files, strings)) == brute
    assert hit_rows(matching.match_literals(files, matching.prepared(strings).collect())) == brute
    assert hit_rows(matching.match_strings(files, strings)) == brute
    monkeypatch.setattr(session, "LITERAL_STRINGS", 3)
    assert hit_rows(matching.match_strings_indexed(files, strings)) == brute
    monkeypatch.setattr(session, "BROADCAST_BYTES", 4000)
    assert hit_rows(matching.match_strings_indexed(files, strings)) == brute


@pytest.mark.parametrize("n", [1, 64, 65, 5000])
def test_number_of_strings_does_not_change_hits(spark, n):
    rng = random.Random(n)
    alphabet = "ab_(.;é\n "
    word = lambda: "".join(rng.choices(alphabet, k=rng.randint(1, 6)))
    files = [(f"/p{i % 20}", f"p{i % 20}", "".join(word() for _ in range(rng.randint(0, 12)))) for i in range(30)]
    # Ids and names repeat, with other strings each time.
    strings = [(f"f{i % 3}", f"r{i % 7}", f"$s{i % 11}", "text", word()) for i in range(n)]
    f = spark.createDataFrame(files, "path STRING, name STRING, content STRING")
    s = spark.createDataFrame(strings, "rule_id STRING, rule_name STRING, string_id STRING, kind STRING, pattern STRING")
    brute = sorted(
        (p, r, i) for p, _, c in files for _, r, i in {(k, r, i) for k, r, i, _, pat in strings if pat in c}
    )
    assert hit_rows(matching.match_strings(f, s)) == brute
    assert hit_rows(matching.match_strings_indexed(f, s)) == brute
    plan = matching.match_strings_indexed(f, s)._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "CartesianProduct" not in plan


def test_matching_on_bytes(spark, corpus):
    files, strings, brute = corpus
    raw = files.withColumn("content", F.encode("content", "UTF-8"))
    assert hit_rows(matching.match_strings_indexed(raw, strings)) == brute
    assert hit_rows(matching.match_literals(raw, matching.prepared(strings).collect())) == brute


def test_scan_in_row_equals_grouped_scan(spark, corpus, monkeypatch):
    files, strings, _ = corpus
    names = [r["rule_name"] for r in strings.select("rule_name").distinct().collect()]
    rules = [(n, i % 3 + 1, None) if i % 4 else (n, 1, f"$s{i}") for i, n in enumerate(sorted(names))]
    rules = spark.createDataFrame(rules, "rule_name STRING, min_hits INT, only_id STRING")
    some = strings.where("string_id < '$s3'")
    pairs = lambda df: sorted((r["rule_name"], r["path"]) for r in df.collect())
    monkeypatch.setattr(session, "LITERAL_STRINGS", 1000)
    in_row = pairs(matching.scan(files, rules, some, [], []))
    monkeypatch.setattr(session, "LITERAL_STRINGS", 3)
    grouped = pairs(matching.scan(files, rules, some, [], []))
    assert in_row and in_row == grouped


def test_quick_scan_is_part_of_the_scan(tables):
    files, rules, strings = V.files(tables), V.active_fixture(tables), V.fixture_strings(tables)
    pairs = lambda df: {(r["rule_name"], r["path"]) for r in df.collect()}
    full = pairs(matching.scan(files, rules, strings))
    assert pairs(matching.quick_scan(files, rules, strings, "/")) <= full
    totals = aggregates.scan_totals(V.matches(tables)).first()
    assert totals["matches"] == len(full) and totals["matches"] >= totals["files"]


# ---- rate limits


def greedy(seconds, limit, window):
    accepted, out = [], []
    for i, s in enumerate(seconds):
        if sum(1 for a in accepted if a >= s - window) < limit:
            accepted.append(s)
            out.append(i)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 20000), max_size=80), st.integers(1, 3))
def test_jumping_limiter_equals_row_by_row(seconds, limit):
    import numpy as np

    seconds = sorted(seconds)
    assert windows.accept_positions(np.array(seconds, dtype="int64"), [], limit, 3600) == greedy(seconds, limit, 3600)


def restart_frame(spark, offsets_by_host):
    rows, ident = [], 0
    for host, offsets in offsets_by_host.items():
        for o in offsets:
            rows.append((host, T0 + dt.timedelta(seconds=o), ident))
            ident += 1
    return spark.createDataFrame(rows, "host BIGINT, ts TIMESTAMP, event_id BIGINT")


@pytest.fixture(scope="module")
def hot_host(spark):
    """One host with nine tenths of all events, many of them in the same second."""
    rng = random.Random(3)
    by_host = {0: [rng.randint(0, 3 * 86400) // 50 * 50 + rng.random() for _ in range(3000)]}
    by_host |= {h: [rng.randint(0, 3 * 86400) for _ in range(20)] for h in range(1, 15)}
    return by_host, restart_frame(spark, by_host).cache()


def expected_limit(df, limit):
    out = []
    rows = sorted(((r["host"], int(r["ts"].timestamp()), r["ts"], r["event_id"]) for r in df.collect()))
    for host in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == host]
        out += [mine[i][3] for i in greedy([r[1] for r in mine], limit, 3600)]
    return sorted(out)


def idents(df):
    return sorted(r["event_id"] for r in df.collect())


def test_limiters_equal_brute_force_on_a_hot_host(hot_host):
    _, df = hot_host
    assert idents(windows.limit_restarts(df)) == expected_limit(df, 2)
    assert idents(windows.suppress_alerts(df)) == expected_limit(df, 1)


def test_limiter_edges(spark):
    kept = lambda offsets, fn: [o for o in offsets if o in {
        (r["ts"] - T0).total_seconds() for r in fn(restart_frame(spark, {1: offsets})).collect()}]
    # Exactly 3,600 s back still counts; one second more does not.
    assert kept([0, 10, 3600], windows.limit_restarts) == [0, 10]
    assert kept([0, 10, 3601], windows.limit_restarts) == [0, 10, 3601]
    assert kept([0, 20, 40], windows.limit_restarts) == [0, 20]
    # A rejected one leaves no trace.
    assert kept([0, 20, 3000, 3660], windows.limit_restarts) == [0, 20, 3660]
    assert kept([0, 3600], windows.suppress_alerts) == [0]
    assert kept([0, 3601], windows.suppress_alerts) == [0, 3601]


def test_look_back_counts_equal_brute_force(hot_host):
    _, df = hot_host
    rows = [(r["host"], int(r["ts"].timestamp()), r["event_id"]) for r in df.collect()]
    by_host = {}
    for h, s, _ in rows:
        by_host.setdefault(h, []).append(s)
    want = {i: sum(1 for x in by_host[h] if s - 3600 <= x <= s) for h, s, i in rows}
    got = {r["event_id"]: r["restarts"] for r in windows.restarts_last_hour(df).collect()}
    assert got == want


def test_asof_equals_brute_force_both_ways(spark, hot_host):
    _, df = hot_host
    facts = df.where("event_id % 3 = 0").select("host", "ts", F.col("event_id").alias("fact_id"))
    items = df.where("event_id % 3 = 1")
    f = [(r["host"], int(r["ts"].timestamp()), r["ts"], r["fact_id"]) for r in facts.collect()]
    for forward in (False, True):
        got = {r["event_id"]: r["fact_id"] for r in windows.asof_join(items, facts, ["fact_id"], forward).collect()}
        want = {}
        for r in items.collect():
            s = int(r["ts"].timestamp())
            mine = [x for x in f if x[0] == r["host"] and (x[1] >= s if forward else x[1] <= s)]
            sec = (min if forward else max)((x[1] for x in mine), default=None)
            best = [x[2:] for x in mine if x[1] == sec]
            want[r["event_id"]] = (min if forward else max)(best)[1] if best else None
        assert got == want


def test_first_occurrence_with_nulls_and_extremes(spark):
    """Nulls come first and extreme values survive."""
    low, high = -(2**63), 2**63 - 1
    rows = [("a", 5, 3), ("a", None, 9), ("a", low, 1), ("b", high, -(2**31)), ("b", high, 2**31 - 1), ("c", 0, None), ("c", 0, 5), (None, 1, 1)]
    df = spark.createDataFrame(rows, "k STRING, d BIGINT, p INT")
    found = windows.dedupe_first(df, ["k"], ["d", "p"])
    want = {("a", None, 9), ("b", high, -(2**31)), ("c", 0, None), (None, 1, 1)}
    assert {tuple(r) for r in found.collect()} == want
    assert {tuple(r)[:3] for r in windows.dedupe_first(df.withColumn("x", F.lit(1)), ["k"], ["d", "p"]).collect()} == want


# ---- lists and coverage


def test_long_lists_are_split_and_whole(spark):
    rows = [("hot", f"/p{i}") for i in range(950)] + [("cold", "/a")]
    matches = spark.createDataFrame(rows, "rule_name STRING, path STRING")
    assert {tuple(r) for r in aggregates.files_per_rule(matches).collect()} == {(n, p, 950 if n == "hot" else 1) for n, p in rows}
    parts = aggregates.file_lists(matches, 10).collect()
    hot = [r for r in parts if r["rule_name"] == "hot"]
    assert len(hot) == 10 and max(r["n_files"] for r in hot) < 200
    assert sorted(p for r in hot for p in r["files"].split("|")) == sorted(p for n, p in rows if n == "hot")
    assert [r["files"] for r in parts if r["rule_name"] == "cold"] == ["/a"]
    assert aggregates.parts_needed(matches, 100) == 19 and aggregates.parts_needed(matches.limit(0)) == 1
    assert aggregates.file_lists(matches).count() == 2


def test_dir_coverage_keeps_siblings_and_empty_dirs_apart(spark):
    entries = [("/opt/tool/a",), ("/opt/tool",), ("/opt/tool2/b",), ("/etc/x/y/z",)]
    dirs = [("/opt/tool",), ("/opt/tool2",), ("/etc",), ("/none",)]
    got = joins.dir_coverage(spark.createDataFrame(dirs, "dir STRING"), spark.createDataFrame(entries, "path STRING"))
    assert {r["dir"]: r["files"] for r in got.collect()} == {"/opt/tool": 2, "/opt/tool2": 1, "/etc": 1, "/none": 0}


# ---- streams over several micro-batches


def stream_of(spark, df, path, parts=4):
    """The rows in time order, as `parts` files that arrive one per micro-batch."""
    rows = df.orderBy("ts", "event_id").collect()
    step = -(-len(rows) // parts)
    for i in range(parts):
        part = spark.createDataFrame(rows[i * step : (i + 1) * step], df.schema)
        part.coalesce(1).write.mode("append").parquet(path)
    return jobs.read_table_stream(spark, path, df.schema, 1)


def in_order_of(spark, df, path, parts, seed=1):
    """A stream of files, one for each trigger: parts of the events in order of time that overlap by less than half an hour."""
    span = df.agg(F.min("ts").cast("long").alias("a"), F.max("ts").cast("long").alias("b")).first()
    length = (span["b"] - span["a"] + 1801) / parts
    part = F.floor((F.col("ts").cast("long") + F.pmod(F.xxhash64("event_id"), F.lit(1800)) - span["a"]) / length)
    for i in range(parts):
        df.withColumn("_part", part).where(F.col("_part") == i).drop("_part").orderBy(F.rand(seed)).coalesce(1).write.mode("append").parquet(path)
    return jobs.read_table_stream(spark, path, df.schema, 1)


@pytest.mark.parametrize("name, limit", [("limit_restarts", 2), ("suppress_alerts", 1)])
def test_stream_limiter_equals_batch(spark, tmp_path, hot_host, name, limit):
    _, df = hot_host
    out = str(tmp_path / "out")
    stream = in_order_of(spark, df, str(tmp_path / "in"), 6)
    getattr(jobs, f"stream_{name}")(stream, out, str(tmp_path / "cp")).awaitTermination()
    jobs.finish_limit(spark, out, limit, 3600, df.schema)
    accepted = spark.read.option("basePath", f"{out}/accepted").parquet(f"{out}/accepted")
    assert idents(accepted) == idents(getattr(windows, name)(df))
    assert accepted.select("batch_id").distinct().count() >= 6
    assert spark.read.parquet(f"{out}/late").count() == 0


def test_stream_limiter_waits_for_earlier_events(spark, tmp_path):
    """An event that comes later but happened before is judged before; one that comes too late is kept apart."""
    out, source = str(tmp_path / "out"), str(tmp_path / "in")
    frames = [restart_frame(spark, {1: offsets}).withColumn("event_id", F.col("event_id") + 10 * i) for i, offsets in enumerate(([1000], [900], [4550, 9000], [300], [20000]))]
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(source)
    stream = jobs.read_table_stream(spark, source, frames[0].schema, 1)
    jobs.stream_suppress_alerts(stream, out, str(tmp_path / "cp")).awaitTermination()
    jobs.finish_limit(spark, out, 1, 3600, frames[0].schema)
    seconds = lambda name: sorted((r["ts"] - T0).total_seconds() for r in spark.read.parquet(f"{out}/{name}").select("ts").collect())
    assert seconds("accepted") == [900, 4550, 9000, 20000] and seconds("late") == [300]


def test_a_repeated_batch_leaves_the_same(spark, tmp_path):
    """A batch run again after its folders were written, as after a failure, changes nothing."""
    out = str(tmp_path / "out")
    events = restart_frame(spark, {1: [0, 10, 20, 4000, 9000], 2: [5, 6, 7]})
    for _ in range(2):
        for i, part in enumerate((events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"))):
            in_time, late = jobs.with_late(part, out, i, "1 day")
            jobs.leave(late, f"{out}/late", i)
            jobs.release_until(spark, in_time, out, i, 2, 3600, "1 day", events.schema)
    jobs.finish_limit(spark, out, 2, 3600, events.schema)
    assert idents(spark.read.parquet(f"{out}/accepted")) == idents(windows.limit_restarts(events))


def test_no_task_has_all_events_of_a_host(spark, hot_host):
    """What a host sends to one task is a bitmap for each slice of time."""
    _, df = hot_host
    rows = windows.second_bitmaps(df.unionByName(df).unionByName(df), 2, 3600).where("host = 0").collect()
    assert len(rows) <= 3 * 86400 * 2 / windows.BITMAP_BITS + 2 and {len(r["bits"]) for r in rows} == {4096}


def test_limiter_with_null_host_and_early_times(spark):
    rows = [(h, T0 - dt.timedelta(days=30000) + dt.timedelta(seconds=s), i) for i, (h, s) in enumerate((h, s) for h in (None, 1 << 60, (1 << 60) + 1) for s in (0, 0, 0, 5, 3601, 9000, 200_000))]
    df = spark.createDataFrame(rows, "host BIGINT, ts TIMESTAMP, event_id BIGINT")
    found = Counter(r["host"] for r in windows.limit_restarts(df).collect())
    assert found == {None: 5, 1 << 60: 5, (1 << 60) + 1: 5}


def test_stream_counts_over_batches(spark, tmp_path, hot_host):
    _, df = hot_host
    stream = stream_of(spark, df, str(tmp_path / "in"))
    jobs.run_to_folder(jobs.stream_daily_counts(stream), str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    out = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    got = {r["day"]: r["n"] for r in jobs.latest_rows(out, ["day"], ["n"]).collect()}
    want = {r["d"]: r["count"] for r in df.groupBy(F.to_date("ts").alias("d")).count().collect()}
    assert got == want


def test_stream_scan_over_batches(spark, tmp_path, tables):
    files = V.files(tables).withColumn("item_id", F.col("doc_id"))
    files.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_table_stream(spark, str(tmp_path / "in"), files.schema, 1)
    rules, strings = V.active_fixture(tables), V.fixture_strings(tables)
    out = str(tmp_path / "out")
    jobs.stream_scan(stream, rules, strings, out, str(tmp_path / "cp"), F.col("mtime")).awaitTermination()
    pairs = lambda df: sorted((r["rule_name"], r["path"]) for r in df.collect())
    assert pairs(spark.read.parquet(f"{out}/matches")) == pairs(V.matches(tables))
    assert spark.read.text(f"{out}/alerts").count() == V.matches(tables).select("path").distinct().count()
    lines = spark.read.text(f"{out}/alerts")
    assert joins.decode_alert(lines).count() == lines.count()
    assert {r["l"] for r in lines.select(filters.alert_level("value").alias("l")).collect()} == {12}
