"""The pipeline's stages, each against brute force on what its predecessor left."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from sigward import session
from sigward.llm import language, line_dedup, mixing
from test_operators import brute_components, encoded, make_rows, table, twin

COLUMNS = ["doc_id", "text", "lang", "source"]


def as_rows(docs) -> list[tuple]:
    return [tuple(r) for r in docs.select(*COLUMNS).collect()]


def test_each_stage(spark):
    docs = table(spark, make_rows(9, 40))
    columns = docs.columns
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = session.written(stage(spark, before, ""), name)
        left[name] = (before, docs)
        assert docs.columns == columns or name == "packing"

    before, after = left["language_id"]
    kept = {r["doc_id"] for r in language.identify(language.document_evidence(before)).where("kept").collect()}
    assert Counter(r[:2] for r in as_rows(after)) == Counter(r[:2] for r in as_rows(before) if r[0] in kept)
    gone = {r[1] for r in as_rows(before) if r[0] not in kept}
    assert gone <= {None, "", " \n\t\n ", "1234 ### !!"}

    before, after = left["line_dedup"]
    want = Counter()
    for doc, _, dropped, digest in twin(as_rows(before), line_dedup.oracle(), "doc_id, n_lines, n_dropped, kept_sha256"):
        want[doc, digest] += 1
    found = Counter((r[0], hashlib.sha256(r[1].encode()).hexdigest()) for r in as_rows(after))
    assert not found - want
    empty = [hashlib.sha256(t.encode()).hexdigest() for t in ("", "\n", "\n\n", " ")]
    assert all(digest in empty or r in found for r in want for digest in [r[1]])

    before, after = left["ngram_join"]
    groups = brute_components(as_rows(before), corpus_pipeline.GRAM, corpus_pipeline.SHARE)
    assert Counter(as_rows(after)) == Counter(r for r in as_rows(before) if r[0] is None or groups[r[0]] == r[0])

    before, after = left["mixing"]
    want = Counter((r[0], r[1]) for r in twin(as_rows(before), mixing.oracle(), "doc_id, source"))
    assert Counter((r[0], r[3]) for r in as_rows(after)) == want and set(as_rows(after)) == set(as_rows(before))

    before, after = left["packing"]
    want = Counter()
    for doc, text, *_ in as_rows(before):
        ids = encoded("word_bpe_49k.json", text)
        for piece, at in enumerate(range(0, len(ids), 2048)):
            want[doc, piece, zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in after.collect()) == want


def test_no_documents(spark):
    docs = table(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = session.written(stage(spark, docs, ""), name)
        assert docs.count() == 0


def test_clashing_names(spark):
    """Columns named like those the stages work with pass through all stages that return documents."""
    names = ["_of", "_kept", "_lang", "_dropped", "row", "found", "kept", "of", "places", "lines", "dropped", "component_id", "_mix_tokens", "_mix_times", "_mix_place", "a.b"]
    docs = table(spark, make_rows(4, 20)).withColumns({c: F.lit(i) for i, c in enumerate(names)})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = session.written(stage(spark, docs, ""), name)
        if name != "packing":
            assert docs.columns == columns
            assert docs.select(*[f"`{c}`" for c in names]).distinct().collect() == [tuple(range(len(names)))]
    assert docs.count() > 0
