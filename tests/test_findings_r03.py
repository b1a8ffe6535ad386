"""Work that a review found in too few tasks."""

from __future__ import annotations

from sigward import session
from sigward.plans import registry


def test_many_strings_meet_files_in_all_partitions(spark, tables):
    """Files are dealt to as many tasks as a shuffle has, not to a fixed few."""
    plan = registry.QUERIES["m4_matched_files_many"](spark, tables.sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert f"RoundRobinPartitioning({session.shuffles(spark)})" in plan


def test_python_gets_batches_of_bounded_bytes(spark):
    """A task's Python worker holds a few megabytes of texts at a time, however many rows a batch may have."""
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    texts = spark.range(0, 60, 1, 1).selectExpr("repeat('x', 1000000) AS text")
    found = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 60_000_000 and max(found) < 20_000_000
