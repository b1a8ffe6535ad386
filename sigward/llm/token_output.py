"""Token ids in binary files: frequency-ranked ids in byte-aligned variable-length coding.

An id is replaced by its rank among all ids of the corpus, the most frequent first, so that most take one byte. A rank
takes 1 to 4 bytes; two bits say how many. These bits stand apart, four ids to a control byte, before all data bytes, so
that a reader learns all lengths from one table look-up per control byte and gathers the data with numpy.

A segment is a self-contained byte string:
    "SVB1", number of documents, number of ids (two little-endian unsigned 64-bit integers),
    doc_id of each document (signed 64 bits), 1 where the doc_id is null (1 byte each), ids of each document (unsigned 64 bits),
    control bytes, data bytes.
Segments lie in a Parquet table (part, segment, start, payload), as Spark's writers can commit that from any executor to
any store. `start` counts the ids of the same part before the segment.

Defined results: a null or empty text has the end id alone. A null doc_id comes first. Rows that share a doc_id all
appear, ordered by their ids. An empty table gives no segment. Further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigward import session
from sigward.llm import common, tokens

MAGIC = b"SVB1"
SEGMENT_IDS = 1 << 20
RUN_BYTES = 16 << 20
# Bytes of the four ids of a control byte.
SIZES = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], dtype=np.int64)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers again: their sizes by table look-up, their bytes by position."""
    size = SIZES[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    start = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    out = np.zeros(n, dtype=np.uint32)
    for i in range(4):
        out |= np.where(size > i, raw[np.minimum(start + i, len(raw) - 1)].astype(np.uint32) << np.uint32(8 * i), np.uint32(0))
    return out


def write_segment(doc_ids: list[int | None], lengths: list[int], ranks: np.ndarray) -> bytes:
    head = np.array([len(doc_ids), len(ranks)], dtype="<u8").tobytes()
    ids = np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes()
    null = np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes()
    return MAGIC + head + ids + null + np.array(lengths, dtype="<u8").tobytes() + b"".join(pack(ranks))


def read_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, ranks."""
    if payload[:4] != MAGIC:
        raise ValueError("not a segment")
    n, total = (int(x) for x in np.frombuffer(payload, dtype="<u8", count=2, offset=4))
    at = 20
    ids = np.frombuffer(payload, dtype="<i8", count=n, offset=at)
    null = np.frombuffer(payload, dtype=np.uint8, count=n, offset=at + 8 * n)
    lengths = np.frombuffer(payload, dtype="<u8", count=n, offset=at + 9 * n).astype(np.int64)
    at += 17 * n
    control = -(-total // 4)
    ranks = unpack(payload[at : at + control], payload[at + control :], total)
    return [None if z else int(i) for i, z in zip(ids, null, strict=True)], lengths, ranks


def encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, n (ids without the end id) and the ids of each text, compressed; after them, for each task, a row with its counts of ids
    (`seen`: ids of 4 bytes and counts of 8, one behind the other), the end ids included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        make = tokens.encoder(path)
        squeeze = zstandard.ZstdCompressor(level=3).compress
        width = make.dtype.itemsize
        total = np.zeros(make.vocabulary, dtype=np.int64)
        names = ["doc_id", "n", "ids", "seen"]
        for batch in batches:
            for part in common.slices(iter([batch]), "text", RUN_BYTES):
                ids, counts = make.encode(part.column("text"))
                total += np.bincount(ids, minlength=make.vocabulary)
                total[end] += len(counts)
                ends = np.cumsum(counts)
                blobs = []
                for s, e in zip((ends - counts).tolist(), ends.tolist(), strict=True):
                    planes = ids[s:e].view(np.uint8).reshape(-1, width).T
                    blobs.append(squeeze(planes.tobytes()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary()), pa.nulls(len(blobs), pa.binary())], names)
        there = np.flatnonzero(total)
        seen = there.astype("<u4").tobytes() + total[there].astype("<u8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen], pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, ids binary, seen binary")


def expand(blob: bytes, dtype: np.dtype) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)


def rank_table(table: DataFrame, vocabulary: int) -> np.ndarray:
    """Ids by descending count over the whole corpus, from the tasks' counts; the table is as long as the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for blob in batch.column("seen").to_pylist():
                n = len(blob) // 12
                seen[np.frombuffer(blob, dtype="<u4", count=n)] += np.frombuffer(blob, dtype="<u8", offset=4 * n).astype(np.int64)
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(seen[there], pa.int64())], ["id", "n"])

    tasks = table.select("seen").where("seen IS NOT NULL")
    counts = tasks.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    full = np.zeros(vocabulary, dtype=np.int64)
    full[counts["id"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.int64)
    return np.argsort(-full, kind="stable").astype(np.uint32)


def write(docs: DataFrame, path: str, end: int, partitions: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """Writes the documents in ascending doc_id order; returns the table of segments as read back, and the rank table."""
    spark = docs.sparkSession
    make = tokens.encoder(path)
    dtype, vocabulary = make.dtype, make.vocabulary
    table = session.written(encoded(docs, path, end), "token-ids")
    by_rank = rank_table(table, vocabulary)
    ids = table.where("seen IS NULL").drop("seen")
    rank = np.empty(vocabulary, dtype=np.uint32)
    rank[by_rank] = np.arange(vocabulary, dtype=np.uint32)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start = TaskContext.get().partitionId(), 0, 0
        docs_in: list[int | None] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            payload = write_segment(docs_in, lengths, np.concatenate(parts))
            row = [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([start], pa.int64()), pa.array([sum(lengths)], pa.int64()), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["part", "segment", "start", "n_ids", "payload"])

        for batch in batches:
            for d, blob in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                docs_in.append(d)
                parts.append(rank[np.append(expand(blob.as_py(), dtype), dtype.type(end))])
                lengths.append(len(parts[-1]))
                if sum(lengths[-1:]) >= SEGMENT_IDS or len(lengths) % 64 == 0 and sum(lengths) >= SEGMENT_IDS:
                    yield flush()
                    number, start = number + 1, start + sum(lengths)
                    docs_in, lengths, parts = [], [], []
        if docs_in:
            yield flush()

    ordered = ids.repartitionByRange(partitions or common.shuffles(spark), "doc_id").sortWithinPartitions("doc_id", "n", "ids")
    out = ordered.mapInArrow(segments, "part int, segment long, start long, n_ids long, payload binary")
    return session.written(out, "token-files"), by_rank


def read(segments: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the segments alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, payload in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), batch.column("payload"), strict=True):
                doc_ids, lengths, ranks = read_segment(payload.as_py())
                raw, ends = by_rank[ranks].astype("<u4").tobytes(), np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"part": np.int32(part), "doc_id": pd.array(doc_ids, dtype="Int64"), "start": start + ends - lengths, "n_tokens": lengths, "ids_crc32": crc}), preserve_index=False)

    found = segments.select("part", "start", "payload").mapInArrow(rows, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    # A row for each part, of which there are as many as the writer had partitions.
    before = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return found.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, end: int = 0, partitions: int | None = None) -> DataFrame:
    """Writes the corpus and reads it back: a row for each document, as in `read`."""
    return read(*write(docs, path, end, partitions))
