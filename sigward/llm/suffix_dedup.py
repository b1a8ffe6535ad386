"""Suffix-array dedup: repeated windows of THRESHOLD bytes, found by a radix sort of suffixes to that depth.

Suffixes are ordered only through THRESHOLD bytes and only where two may be equal, by digits from the most significant:

1. The first digit of a window is the smallest hash among its runs of GRAM bytes, a function of the window's bytes alone. It
   stays the same over a stretch of neighbouring windows, so a stretch, not a window, is sent: about one for 16 bytes,
   five bytes each, once for each slice of documents. Digits that only one document has are done with.
2. Of the stretches that are left, about a tenth, the bytes are sent, to the digit's bucket. There the windows are put in order by passes
   over their bytes, eight at a time from the most significant, until they differ or THRESHOLD bytes are read; equal groups are
   exactly the repeated windows, and each has its smallest doc_id.

A window that also starts in a document with a smaller doc_id is removed with all its bytes. Later copies of a whole text are
removed by its digest and take no part. Texts move once, dealt into slices by hash, and all passes read that shuffle.

Defined results: a null text is empty. Windows do not cross documents. Rows that share a doc_id do not remove each other's bytes.
Rows without a doc_id keep all bytes and remove none. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigward import session
from sigward.llm import common
from sigward.llm.ngram_join import A, mix

THRESHOLD = 50
GRAM = 20
SLICE_BYTES = 8 << 20
# Bytes of text for each bucket of digits.
BUCKET_BYTES = 24 << 20
# Bytes of a bucket's stretches that are sorted at a time.
TURN_BYTES = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each place, put together from hashes of runs of 1, 2, 4 ... bytes."""
    n = len(raw) - size + 1
    run, at, width, out = mix(raw.astype(np.uint64) + np.uint64(1)), 0, 1, None
    while True:
        if size & width:
            own = run[at : at + n]
            out = own.copy() if out is None else mix(out * A + own)
            at += width
        if 2 * width > size:
            return out
        run = mix(run[:-width] * A + run[width:])
        width *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def stretches(raw: np.ndarray, threshold: int = THRESHOLD, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """First digit of each stretch of windows and where the stretches start; the last start is the number of windows."""
    least = sliding_min(gram_hashes(raw, gram), threshold - gram + 1)
    change = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    return mix(least[change]), np.append(change, len(least))


def five_bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:7]).tobytes()


def from_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def in_order(table: pa.Table, side: pa.Table) -> tuple[list, list[bytes], list[bool]]:
    """doc_id, bytes and "takes part" of a slice's documents, in an order that every pass finds again."""
    table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("digest", "ascending")]))
    side = side.filter(pc.equal(side["kind"], "later"))
    later = set(zip(side["doc_id"].to_pylist(), side["payload"].to_pylist(), strict=True))
    ids = table["doc_id"].to_pylist()
    texts = [t.encode() for t in table["text"].to_pylist()]
    part = [d is not None and len(t) >= THRESHOLD and (d, g) not in later for d, t, g in zip(ids, texts, table["digest"].to_pylist(), strict=True)]
    return ids, texts, part


def first_digits(buckets: int, table: pa.Table, side: pa.Table) -> pa.Table:
    """The distinct first digits of a slice, by bucket, and whether two of its documents have it."""
    ids, texts, part = in_order(table, side)
    seen = [np.unique(stretches(np.frombuffer(t, dtype=np.uint8))[0]) for t, p in zip(texts, part, strict=True) if p]
    digits, counts = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    bucket = (digits % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    there, start = np.unique(bucket[order], return_index=True)
    ends = np.append(start[1:], len(order))[: len(start)]
    rows = [(five_bytes(digits[order[s:e]]), (counts[order[s:e]] > 1).astype(np.uint8).tobytes()) for s, e in zip(start, ends, strict=True)]
    number = table["slice"][0].as_py() if table.num_rows else 0
    return pa.table({"bucket": pa.array(there, pa.int64()), "slice": pa.array([number] * len(there), pa.int64()), "digits": pa.array([r[0] for r in rows], pa.binary()), "several": pa.array([r[1] for r in rows], pa.binary())})


def repeated_digits(table: pa.Table) -> pa.Table:
    """For each slice of a bucket, its digits that two documents have."""
    parts = [from_five(x) for x in table["digits"].to_pylist()]
    digits = np.concatenate(parts)
    weight = 1 + np.frombuffer(b"".join(table["several"].to_pylist()), dtype=np.uint8).astype(np.int64)
    _, inverse = np.unique(digits, return_inverse=True)
    keep = np.bincount(inverse, weight)[inverse] > 1
    ends = np.cumsum([len(p) for p in parts])
    bucket = table["bucket"][0].as_py()
    payload = [(p[keep[e - len(p) : e]] | np.uint64(bucket << 40)).astype("<u8").tobytes() for p, e in zip(parts, ends, strict=True)]
    n = table.num_rows
    return pa.table({"slice": table["slice"], "kind": pa.array(["digit"] * n), "doc_id": pa.nulls(n, pa.int64()), "payload": pa.array(payload, pa.binary())})


def left_stretches(buckets: int, table: pa.Table, side: pa.Table) -> pa.Table:
    """Bytes of the stretches whose first digit is repeated, by bucket."""
    ids, texts, part = in_order(table, side)
    known = np.frombuffer(b"".join(side.filter(pc.equal(side["kind"], "digit"))["payload"].to_pylist()), dtype="<u8")
    known = np.sort(known)
    found: dict[int, list] = {}
    for i, (text, p) in enumerate(zip(texts, part, strict=True)):
        if not p or not len(known):
            continue
        digits, starts = stretches(np.frombuffer(text, dtype=np.uint8))
        bucket = digits % np.uint64(buckets)
        code = bucket << np.uint64(40) | digits >> np.uint64(16) & np.uint64((1 << 40) - 1)
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        for k in np.flatnonzero(known[at] == code).tolist():
            s, e = int(starts[k]), int(starts[k + 1])
            found.setdefault(int(bucket[k]), []).append((ids[i], i, s, text[s : e - 1 + THRESHOLD], int(digits[k] >> np.uint64(56))))
    column = lambda rows, j, kind: np.array([r[j] for r in rows], dtype=kind).tobytes()
    number = table["slice"][0].as_py() if table.num_rows else 0
    rows = list(found.items())
    return pa.table({
        "bucket": pa.array([b for b, _ in rows], pa.int64()), "slice": pa.array([number] * len(rows), pa.int64()),
        "docs": pa.array([column(r, 0, "<i8") for _, r in rows], pa.binary()), "rows": pa.array([column(r, 1, "<i4") for _, r in rows], pa.binary()),
        "starts": pa.array([column(r, 2, "<i8") for _, r in rows], pa.binary()), "sizes": pa.array([np.array([len(x[3]) for x in r], dtype="<i4").tobytes() for _, r in rows], pa.binary()),
        "bytes": pa.array([b"".join(x[3] for x in r) for _, r in rows], pa.binary()), "digit": pa.array([column(r, 4, "u1") for _, r in rows], pa.binary()),
    })


def equal_groups(raw: np.ndarray, at: np.ndarray, depth: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the suffixes (starting at `at`) that are equal to another one through `depth` bytes, in order, and the number of their group.

    A pass for each eight bytes, from the most significant; a group is split by them, and suffixes that are alone are in their place and
    leave. Bytes are compared, so equal groups are exactly the repeated windows.
    """
    words = np.lib.stride_tricks.sliding_window_view(raw, 8)
    left, group = np.arange(len(at)), np.zeros(len(at), dtype=np.int64)
    for place in [*range(0, depth - 8, 8), depth - 8]:
        if not len(left):
            break
        digit = words[at[left] + place].view(">u8").ravel().astype(np.uint64)
        order = np.argsort(digit, kind="stable")
        order = order[np.argsort(group[order], kind="stable")]
        left, group, digit = left[order], group[order], digit[order]
        starts = np.append(True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1]))
        group = np.cumsum(starts) - 1
        several = np.bincount(group)[group] > 1
        left, group = left[several], group[several]
        group = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1 if len(group) else group
    return left, group


def repeated_windows(table: pa.Table) -> pa.Table:
    """For each slice of a bucket, the runs (document, first window, past the last) of windows with a smaller document.

    Stretches are sorted in turns of about TURN_BYTES by their digit's highest byte, as equal windows have one digit.
    """
    joined = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), dtype=kind)
    docs, rows, starts, sizes = joined("docs", "<i8"), joined("rows", "<i4"), joined("starts", "<i8"), joined("sizes", "<i4").astype(np.int64)
    raw, digit = joined("bytes", np.uint8), joined("digit", np.uint8).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    per_row = [len(x) // 8 for x in table["docs"].to_pylist()]
    turns = digit * min(256, len(raw) // TURN_BYTES + 1) >> 8
    found = [np.zeros((0, 4), dtype="<i8")]
    for turn in np.unique(turns).tolist():
        mine = np.flatnonzero(turns == turn)
        windows = sizes[mine] - THRESHOLD + 1
        owner = np.repeat(np.arange(len(mine)), windows)
        offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        same, group = equal_groups(raw, first[mine][owner] + offset)
        repeats = np.zeros(len(owner), dtype=bool)
        if len(same):
            doc = docs[mine][owner[same]]
            smallest = np.minimum.reduceat(doc, np.flatnonzero(np.append(True, group[1:] != group[:-1])))
            repeats[same] = smallest[group] < doc
        edge = np.append(True, owner[1:] != owner[:-1])
        begins = np.flatnonzero(repeats & (edge | ~np.append(False, repeats[:-1])))
        past = np.flatnonzero(repeats & (np.append(edge[1:], True) | ~np.append(repeats[1:], False)))
        own = mine[owner[begins]]
        found.append(np.stack([own, rows[own].astype("<i8"), starts[own] + offset[begins], starts[own] + offset[past] + 1], axis=1))
    runs = np.concatenate(found)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    bounds = np.searchsorted(runs[:, 0], np.concatenate([[0], np.cumsum(per_row)]))
    payload = [np.ascontiguousarray(runs[s:e, 1:]).tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
    n = table.num_rows
    return pa.table({"slice": table["slice"], "kind": pa.array(["run"] * n), "doc_id": pa.nulls(n, pa.int64()), "payload": pa.array(payload, pa.binary())})


def cut(table: pa.Table, side: pa.Table) -> pa.Table:
    """What stays of each document of a slice."""
    ids, texts, part = in_order(table, side)
    runs = np.frombuffer(b"".join(side.filter(pc.equal(side["kind"], "run"))["payload"].to_pylist()), dtype="<i8").reshape(-1, 3)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    bounds = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    later = set(zip(*(side.filter(pc.equal(side["kind"], "later"))[c].to_pylist() for c in ("doc_id", "payload")), strict=True))
    digests = sorted(zip(table["doc_id"].to_pylist(), table["digest"].to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    n_bytes, removed, spans, kept = [], [], [], []
    for i, text in enumerate(texts):
        own = runs[bounds[i] : bounds[i + 1]]
        n_bytes.append(len(text))
        if digests[i] in later and len(text) >= THRESHOLD:
            removed.append(len(text))
            spans.append(1)
            kept.append(b"")
            continue
        if not len(own):
            removed.append(0)
            spans.append(0)
            kept.append(text)
            continue
        change = np.zeros(len(text) + 1, dtype=np.int64)
        np.add.at(change, own[:, 1], 1)
        np.add.at(change, own[:, 2] - 1 + THRESHOLD, -1)
        gone = np.cumsum(change)[:-1] > 0
        removed.append(int(gone.sum()))
        spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
        kept.append(np.frombuffer(text, dtype=np.uint8)[~gone].tobytes())
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), "kept": pa.array(kept, pa.binary()),
    })


def suffix_dedup(docs: DataFrame, slice_bytes: int = SLICE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of each document."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    seen = session.written(base.select("doc_id", "digest", F.octet_length("text").alias("n")), "digests")
    total = seen.agg(F.sum("n").alias("n")).first()["n"] or 0
    least = common.shuffles(docs.sparkSession)
    slices, buckets = max(least, -(-total // slice_bytes)), max(least, -(-total // bucket_bytes))
    number = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(slices)).alias("slice")
    texts = base.select(number, "doc_id", "text", "digest").groupBy("slice")
    firsts = seen.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(F.col("digest").alias("of"), "first")
    later = seen.join(firsts, F.col("digest") == F.col("of")).where("doc_id > first").select("doc_id", "digest").distinct()
    later = session.written(later.select(number, F.lit("later").alias("kind"), "doc_id", F.col("digest").alias("payload")), "later")
    note = "slice long, kind string, doc_id long, payload binary"
    digits = texts.cogroup(later.groupBy("slice")).applyInArrow(partial(first_digits, buckets), "bucket long, slice long, digits binary, several binary")
    repeated = digits.groupBy("bucket").applyInArrow(repeated_digits, note)
    stretch = "bucket long, slice long, docs binary, rows binary, starts binary, sizes binary, bytes binary, digit binary"
    left = texts.cogroup(later.unionByName(repeated).groupBy("slice")).applyInArrow(partial(left_stretches, buckets), stretch)
    runs = left.groupBy("bucket").applyInArrow(repeated_windows, note)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return texts.cogroup(later.unionByName(runs).groupBy("slice")).applyInArrow(cut, out)
