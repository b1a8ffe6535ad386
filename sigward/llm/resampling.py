"""Resampling to a target distribution: importance weights of hashed word features, drawn by Gumbel noise.

Features are runs of one to NGRAM consecutive words, hashed into BUCKETS. A bucket's gain is a thousand times the logarithm of its
smoothed share of the target over its smoothed share of the corpus, rounded down. A document's weight is the mean gain of its features.

Weights are exact integer sums by bit slices: a document's bucket counts become planes of BUCKETS bits, plane i with bit i of
each count, and the gains become signed planes, two's complement. The sum of gains is the sum of 2^(i + j) times the number of bits
that plane i of the counts and plane j of the gains share, the sign plane counting negative.

The corpus is read twice, once for the counts of all documents and once for the weights; nothing but BUCKETS counts and
BUCKETS gains is kept in between. Checksums of words and of their runs are computed for all words of a run of texts at once.

The draw needs no sort of all rows. Documents are counted by score first. There are few scores at any size of the corpus: weights lie
between the least and the largest gain, at most 1000 * ln(features) apart from 0, and the noise of a 32-bit hash between -3,136 and
22,874. The counts tell the last score that is drawn and the rank at which each score starts, and rows are numbered within their score
by doc_id, in chunks of ids.

Defined results: a null or empty text has no features and weight 0, and is never drawn. Rows that share a doc_id are documents
each; they share their noise, and ties among them fall to the row with the larger weight, then in any order, as such rows are equal. A null
doc_id has the noise of an empty name and comes after all others of its score. An empty target gives gains from the corpus alone.
An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigward import session
from sigward.llm import common

BUCKETS = 10_000
NGRAM = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
RUN_BYTES = 4 << 20
# Texts whose counts stand in one dense table of BUCKETS columns.
BLOCK = 128
# Longer words are summed one by one.
TOGETHER = 32
BITS = 32
LANES = -(-BUCKETS // BITS)


# ---- checksums of words and of runs of words


def crc_table() -> np.ndarray:
    """The table of the reflected polynomial EDB88320, by its rule."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ c >> np.uint32(1), c >> np.uint32(1))
    return c


TABLE = crc_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case, starts, lengths, words of each text) of all words of the texts on end. Word bounds are ASCII, so bytes tell them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = LOWER[np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    held = np.concatenate([[False], IS_WORD[raw], [False]])
    first = held[1:-1] & ~held[:-2]
    last = held[1:-1] & ~held[2:]
    # A text's first and last bytes bound its words, whatever stands beside them.
    full = ends[:-1] < ends[1:]
    first[ends[:-1][full]] |= IS_WORD[raw[ends[:-1][full]]]
    last[ends[1:][full] - 1] |= IS_WORD[raw[ends[1:][full] - 1]]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    at = np.searchsorted(starts, ends)
    return raw, starts, sizes, np.diff(at)


def crc_of_words(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksum of each word, a byte of all words at a time, longest words first."""
    out = np.zeros(len(starts), dtype=np.uint32)
    long = np.flatnonzero(sizes > TOGETHER)
    for i in long.tolist():
        out[i] = zlib.crc32(raw[starts[i] : starts[i] + sizes[i]].tobytes())
    order = np.argsort(-np.where(sizes > TOGETHER, 0, sizes), kind="stable")
    order = order[: len(order) - len(long)]
    n = np.searchsorted(-sizes[order], -np.arange(1, TOGETHER + 1), side="right")
    c = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    at = starts[order]
    for k in range(TOGETHER):
        m = n[k]
        if not m:
            break
        c[:m] = TABLE[(c[:m] ^ raw[at[:m] + k]) & np.uint32(255)] ^ c[:m] >> np.uint32(8)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


@lru_cache(maxsize=256)
def shift_tables(size: int) -> np.ndarray:
    """What `size` zero bytes make of a checksum, as a table for each of its four bytes; the map is linear, so doubling squares it."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    total, step = bits.copy(), TABLE[bits & np.uint32(255)] ^ bits >> np.uint32(8)
    apply = lambda m, v: np.bitwise_xor.reduce(np.where(v[:, None] & bits, m, np.uint32(0)), axis=1)
    while size:
        if size & 1:
            total = apply(step, total)
        step = apply(step, step)
        size >>= 1
    byte = np.arange(256, dtype=np.uint32)
    return np.stack([apply(total, byte << np.uint32(8 * i)) for i in range(4)])


def followed_by(crc: np.ndarray, more: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksums of texts put together, from those of the first ones and those and the sizes of the second ones."""
    out = np.empty(len(crc), dtype=np.uint32)
    order = np.argsort(sizes, kind="stable")
    values, first = np.unique(sizes[order], return_index=True)
    for size, part in zip(values.tolist(), np.split(order, first[1:]), strict=True) if len(order) else ():
        t, c = shift_tables(size), crc[part]
        out[part] = t[0][c & np.uint32(255)] ^ t[1][c >> np.uint32(8) & np.uint32(255)] ^ t[2][c >> np.uint32(16) & np.uint32(255)] ^ t[3][c >> np.uint32(24)]
    return out ^ more


def features(texts: pa.Array, ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket) of each feature of the texts, and the words of each text."""
    raw, starts, sizes, counts = words_of(texts)
    crc = crc_of_words(raw, starts, sizes)
    owner = np.repeat(np.arange(len(counts)), counts)
    owners, hashes, run = [owner], [crc], crc
    blank = np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32)
    for k in range(1, ngram):
        # A run of k words, a blank, and the word after it, where that is a word of the same text.
        fits = owner[k:] == owner[:-k]
        ahead = followed_by(run[: len(fits)], blank[: len(fits)], np.ones(len(fits), dtype=np.int64))
        run = followed_by(ahead, crc[k:], sizes[k:])
        owners.append(owner[k:][fits])
        hashes.append(run[fits])
    return np.concatenate(owners), (np.concatenate(hashes) % np.uint32(BUCKETS)).astype(np.int64), counts


# ---- counts and gains


def bucket_counts(texts: DataFrame, ngram: int = NGRAM) -> np.ndarray:
    """Features of all texts in each of the BUCKETS: a row for each task, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for part in common.slices(batches, "text", RUN_BYTES):
            total += np.bincount(features(part.column("text"), ngram)[1], minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    s_all, t_all = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


# ---- bit slices


def gain_planes(gains: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(value of a bit, plane) of the gains in two's complement; the last plane is the sign's and counts negative."""
    width = int(max(gains.max(initial=0), -1 - gains.min(initial=0))).bit_length()
    at = np.arange(BUCKETS)

    def plane(bits: np.ndarray) -> np.ndarray:
        return np.bincount(at // BITS, bits * (1 << at % BITS), LANES).astype(np.uint32)

    return [(1 << j, plane(gains >> j & 1)) for j in range(width)] + [(-(1 << width), plane((gains < 0).astype(np.int64)))]


def weight_sums(owner: np.ndarray, bucket: np.ndarray, n: int, gains: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Sum of the gains of the features of each of n texts, by planes of counts and of gains."""
    out = np.zeros(n, dtype=np.int64)
    edges = np.searchsorted(owner, np.arange(0, n + BLOCK, BLOCK))
    for i, start in enumerate(range(0, n, BLOCK)):
        many = min(BLOCK, n - start)
        own = slice(edges[i], edges[i + 1])
        counts = np.bincount((owner[own] - start) * BUCKETS + bucket[own], minlength=many * BUCKETS)
        held = np.flatnonzero(counts)
        counts = counts[held]
        text, place = np.divmod(held, BUCKETS)
        lane, bit = text * LANES + place // BITS, (1 << place % BITS).astype(np.float64)
        for k in range(int(counts.max(initial=0)).bit_length()):
            there = (counts >> k & 1).astype(bool)
            plane = np.bincount(lane[there], bit[there], many * LANES).astype(np.uint32).reshape(many, LANES)
            for value, gain in gains:
                out[start : start + many] += (value << k) * np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
    return out


def weighed(docs: DataFrame, gains: np.ndarray, ngram: int = NGRAM) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document."""
    planes = gain_planes(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", RUN_BYTES):
            owner, bucket, words = features(part.column("text"), ngram)
            order = np.argsort(owner, kind="stable")
            sums = weight_sums(owner[order], bucket[order], len(words), planes)
            n = np.bincount(owner, minlength=len(words))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words), pa.array(n), pa.array(sums // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


# ---- the draw


def noise(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise in thousandths, rounded down, from a hash of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Adds rank: 1, 2, 3 ... by falling score, then doc_id, for the share of the documents of `least_words` that is drawn."""
    fits = F.col("n_words") >= least_words
    # A row for each score, so one task may add them up.
    scores = scored.where(fits).groupBy("score").agg(F.count("*").alias("of_score"))
    falling = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    table = scores.select("score", F.coalesce(F.sum("of_score").over(falling), F.lit(0)).alias("before"), F.floor(F.sum("of_score").over(whole) * percent / 100).alias("drawn"))
    starts = session.written(table.where(F.col("before") < F.col("drawn")), "scores")
    kept = scored.where(fits).join(starts, "score")
    # Rows of one score by doc_id: chunks of ids are counted first, so that a score with most rows is not one group.
    chunk = F.coalesce(F.floor(F.col("doc_id") / CHUNK), F.lit(LAST))
    kept = kept.withColumn("chunk", chunk)
    sizes = kept.groupBy("score", "chunk").agg(F.count("*").alias("of_chunk"))
    earlier = Window.partitionBy("score").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("score", "chunk", F.coalesce(F.sum("of_chunk").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("score", "chunk").orderBy(F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), "row")
    placed = kept.withColumn("place", F.row_number().over(inside)).join(offsets, ["score", "chunk"])
    rank = F.col("before") + F.col("offset") + F.col("place")
    found = placed.select("row", F.when(rank <= F.col("drawn"), rank).alias("rank"))
    return scored.join(found, "row", "left")


# doc_ids of a chunk; rows of one score and chunk are numbered in one group.
CHUNK = 1 << 20
LAST = (1 << 63) - 1


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS, ngram: int = NGRAM) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where not drawn) of each document; `target` has texts."""
    gains = gains_of(bucket_counts(docs, ngram), bucket_counts(target, ngram))
    scored = weighed(docs, gains, ngram).select(F.monotonically_increasing_id().alias("row"), "*", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))
    return ranked(session.written(scored, "weights"), percent, least_words).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def sample(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The documents that are drawn, all columns. Rows that share a doc_id come together, rows without one do not come."""
    drawn = resample(docs, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    free = common.free_name("drawn", docs)
    return docs.join(drawn.withColumnRenamed("_drawn", free), docs["doc_id"] == F.col(free), "left_semi")


def oracle(percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS) -> str:
    upper = "".join(map(chr, range(65, 91)))
    return f"""
WITH {common.CRC32_SQL},
d_words AS (SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
b_words AS (SELECT row_number() OVER () AS id, coalesce(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM benchmark),
d_grams AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM d_words),
b_grams AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM b_words),
named AS (SELECT x, {common.crc32_sql("x")} % {BUCKETS} AS bucket FROM (SELECT x FROM d_grams UNION SELECT x FROM b_grams), crc_table),
held AS (SELECT id, bucket, count(*) AS n FROM d_grams JOIN named USING (x) GROUP BY ALL),
corpus AS (SELECT bucket, sum(n) AS s FROM held GROUP BY bucket), target AS (SELECT bucket, count(*) AS t FROM b_grams JOIN named USING (x) GROUP BY bucket),
sums AS (SELECT coalesce((SELECT sum(s) FROM corpus), 0)::DOUBLE AS s_all, coalesce((SELECT sum(t) FROM target), 0)::DOUBLE AS t_all),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT AS gain
  FROM corpus LEFT JOIN target USING (bucket), sums),
weights AS (SELECT id, sum(n) AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM held JOIN gains USING (bucket) GROUP BY id),
hashes AS (SELECT id, doc_id, len(w) AS n_words, ('0x' || left(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT::DOUBLE AS h FROM d_words),
scored AS (SELECT id, doc_id, n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM hashes LEFT JOIN weights USING (id)),
ordered AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight DESC) AS rank, {percent} * count(*) OVER () // 100 AS drawn FROM scored WHERE n_words >= {least_words})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM scored LEFT JOIN ordered USING (id)"""
