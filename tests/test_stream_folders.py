"""Folders whose texts are cut into files of bounded size, and judged as a whole."""

from __future__ import annotations

import os
from collections import defaultdict

from pyspark.sql import functions as F

from sigward.operators import matching
from sigward.plans.stream_queries import in_folders
from sigward.streaming import jobs


def test_folders_are_cut_and_judged_whole(spark, tmp_path):
    words = {0: "worthless", 7: "stupid", 9: "x"}
    rows = [(i, f"{words.get(i, 'noise')} {'y' * 400}\nmore", None if i % 50 == 3 else "src1" if i < 60 else "src2", "en") for i in range(120)]
    docs = spark.createDataFrame(rows + rows[:3] + [(500, None, "src1", "en")], "doc_id BIGINT, text STRING, source STRING, lang STRING")
    base = str(tmp_path)
    in_folders(docs, f"{base}/in", 4096)
    sizes = defaultdict(list)
    for d, _, names in os.walk(f"{base}/in"):
        for n in names:
            if n.startswith("part-"):
                sizes[d.split("/part=")[0]].append(os.path.getsize(os.path.join(d, n)))
    assert len(sizes) == 3 and sum(map(len, sizes.values())) > 10 and max(max(s) for s in sizes.values()) < 4 * 4096
    files = jobs.watch_files(spark, f"{base}/in", max_files=3)
    strings = spark.createDataFrame([("Pair", "$a", "text", "worthless"), ("Pair", "$b", "text", "stupid")], "rule_name STRING, string_id STRING, kind STRING, pattern STRING")
    jobs.stream_hits(files, strings, f"{base}/hits", f"{base}/checkpoint").awaitTermination()
    hits = spark.read.schema("path STRING, rule_key STRING, rule_name STRING, string_id STRING").parquet(f"{base}/hits")
    assert hits.select("path").distinct().count() == 2  # the two strings stand in different files
    folders = hits.withColumn("path", F.regexp_extract("path", "(source=[^/]*)/", 1))
    rules = spark.createDataFrame([("Pair", 2, None)], "rule_name STRING, min_hits INT, only_id STRING")
    assert [tuple(r) for r in matching.eval_conditions(folders, rules).collect()] == [("Pair", "source=src1")]
