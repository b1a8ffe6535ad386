"""Cases that a review found: exchanges beyond the shortest pieces of a bin, and what near-copy join and line dedup send on their way."""

from __future__ import annotations

import contextlib
import io
import os
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from sigward import session
from sigward.llm import line_dedup, ngram_join, packing
from test_findings import brute_groups
from test_operators import make_rows, table, twin


def test_two_for_one_tries_all_pairs():
    """Only the two longest of 26 pieces make room for the piece of the other bin."""
    lengths = np.array([1] * 24 + [480, 491, 975])
    bins = packing.improve([list(range(26)), [26]], lengths, 1000)
    assert sorted(int(lengths[b].sum()) for b in bins) == [971, 999]


def test_pair_sums_are_those_of_all_pairs():
    size = [1, 1, 2, 5, 5, 7, 11, 11, 40]
    found = packing.pair_sums(list(range(9)), size, 50)
    assert set(found) == {size[i] + size[j] for i in range(9) for j in range(i)} - {51}
    assert all(i != j and size[i] + size[j] == n for n, (i, j) in found.items())


@pytest.mark.parametrize("share", [80, 90])
def test_sketches_are_bits_and_rule_out_no_link(share):
    rnd = np.random.default_rng(5)
    for n in (12, 40, 300, 2_000):
        one = rnd.integers(0, 1 << 63, n).astype(np.uint64)
        gone = ngram_join.differ(n, share)
        pairs = [np.sort(one), np.sort(one[gone:]), np.sort(np.concatenate([one, rnd.integers(0, 1 << 63, gone).astype(np.uint64)]))]
        sizes = np.array([len(p) for p in pairs])
        own, below = (ngram_join.sketches(np.concatenate(pairs), sizes, back, share) for back in (0, 1))
        kind = np.searchsorted(ngram_join.size_classes(int(sizes.max()), share), sizes, side="right") - 1
        larger = own[2] if kind[2] == kind[0] else below[2]
        assert ngram_join.places_apart(np.frombuffer(own[0], np.uint64), np.frombuffer(larger, np.uint64)) <= gone
        assert len(own[0]) <= 8 + ngram_join.differ(n * 2, share) // 2


def near_rows(seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    rows = make_rows(seed, 20)
    base = [f"v{rnd.randint(0, 10**6)}" for _ in range(300)]
    for i in range(30):
        own = base[: rnd.choice([9, 60, 280, 300])]
        for _ in range(rnd.randint(0, 3)):
            own[rnd.randrange(len(own))] = f"z{rnd.randint(0, 9)}"
        rows += [(5000 + i, " ".join(own), "en", "a"), (6000 + i, " ".join(own), "en", "b")]
    return rows


@pytest.mark.parametrize("most", [10**6, -1])
def test_copies_held_by_tasks_or_shuffled(spark, monkeypatch, tmp_path, most):
    """Either way the groups are those of brute force; the table of all keys is gone in the end."""
    monkeypatch.setattr(ngram_join, "BROADCAST_COPIES", most)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", most)
    monkeypatch.setattr(session, "scratch_dir", lambda _, name: f"{tmp_path}/{name}-{len(os.listdir(tmp_path))}")
    rows = near_rows(21)
    want = brute_groups(rows, 5, 80)
    found = ngram_join.ngram_join(table(spark, rows), 5, 80).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in found) == Counter((r[0], want.get(r[0])) for r in rows)
    kept = corpus_pipeline.keep_one_of_each_group(spark, table(spark, rows), "").select("doc_id", "text").collect()
    assert Counter(map(tuple, kept)) == Counter(r[:2] for r in rows if r[0] is None or want[r[0]] == r[0])
    assert not [d for d in os.listdir(tmp_path) if d.startswith("sets")]


def test_texts_are_not_shuffled_to_leave_near_copies_out(spark):
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        corpus_pipeline.keep_one_of_each_group(spark, table(spark, near_rows(22)).coalesce(1), "").explain()
    assert "BroadcastHashJoin" in plan.getvalue() and "SortMergeJoin" not in plan.getvalue()


@pytest.mark.parametrize("most", [10**6, -1])
def test_rows_of_all_lines_are_met_once(spark, monkeypatch, most):
    """Both kinds of templates come from the lines found in one pass; wide leaves may be held by tasks or shuffled."""
    monkeypatch.setattr(line_dedup, "BROADCAST_WIDE", most)
    port = lambda i: f"node alpha accepted a call from peer {'x' * (1 + i % 3)} on the outer port of hall seven"
    rows = [(i, f"own words of text {chr(97 + i)} only\n{port(i)}\nshort and the same line", "en", "a") for i in range(12)]
    gone = line_dedup.dropped(table(spark, rows))
    assert not [f for f in gone.inputFiles() if "/lines-" in f]
    assert {tuple(r) for r in gone.collect()} == {(i, place) for i in range(1, 12) for place in (1, 2)}
    columns = "doc_id, n_lines, n_dropped, kept_sha256"
    found = line_dedup.line_dedup(table(spark, rows)).select(*columns.split(", ")).collect()
    assert Counter(map(tuple, found)) == Counter(twin(rows, line_dedup.oracle(), columns))


@pytest.mark.parametrize("most", [10**6, -1])
def test_places_held_by_tasks_or_shuffled(spark, monkeypatch, most):
    """Texts go through no exchange where all places to drop fit into a task."""
    monkeypatch.setattr(line_dedup, "BROADCAST_PLACES", most)
    rows = make_rows(23, 30)
    columns = "doc_id, n_lines, n_dropped, kept_sha256"
    found = line_dedup.line_dedup(table(spark, rows)).select(*columns.split(", "))
    assert Counter(map(tuple, found.collect())) == Counter(twin(rows, line_dedup.oracle(), columns))
    assert any("/places-" in f for f in found.inputFiles())
