"""Packing of documents into sequences of a fixed number of tokens, improved by swaps.

A document longer than a sequence is cut into full pieces, which need no search, and a rest. Rests and short documents
are placed by best fit, longest first; a local search then works on the bins that are not full. It exchanges one piece
for one, two for one, or moves a piece, always such that the sum of squared fills grows, until no exchange helps; small
bins run empty on the way. Texts stay where they are: a row for each piece travels, without ids.

Pieces are dealt by a hash into blocks of about `BLOCK` pieces that are packed apart, so no task grows with the corpus.
What a block leaves underfull, a few bins of tens of thousands of pieces, is packed once more with that of other blocks.

Defined results: a null or empty text is its end id alone. Rows that share a doc_id are packed each. An empty table
gives no rows. Further columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigward import session
from sigward.llm import common, tokens

CAPACITY = 2048
BLOCK = 20_000
RUN_BYTES = 4 << 20
# A block's rest is packed again with others where its bins are less full than this share.
REPACK_BELOW = 0.98
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """A row for each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = tokens.encoder(path)
        for batch in batches:
            for part in common.slices(iter([batch]), "text", RUN_BYTES):
                ids, counts = tokens.with_end(*make.encode(part.column("text")), end)
                raw, base = ids.tobytes(), np.cumsum(counts) - counts
                n = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, counts[row] - start)
                at = base[row] + start
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Indexes of the pieces of each bin: longest first, each into the fullest bin that takes it."""
    open_bins: dict[int, list[int]] = defaultdict(list)
    gaps: list[int] = []
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(gaps, n)
        if at == len(gaps):
            bins.append([i])
            b, gap = len(bins) - 1, capacity
        else:
            gap = gaps[at]
            b = open_bins[gap].pop()
            if not open_bins[gap]:
                gaps.pop(at)
            bins[b].append(i)
        if gap - n:
            if not open_bins[gap - n]:
                insort(gaps, gap - n)
            open_bins[gap - n].append(b)
    return bins


def pair_sums(own: list[int], size: list[int], capacity: int) -> dict[int, tuple[int, int]]:
    """A pair of pieces for each sum below the capacity that two pieces of a bin have. Distinct lengths of a bin are few: k of them fill k * k / 2."""
    by_size: dict[int, list[int]] = {}
    for i in own:
        by_size.setdefault(size[i], []).append(i)
    kinds = sorted(by_size)
    out: dict[int, tuple[int, int]] = {}
    for at, low in enumerate(kinds):
        if len(by_size[low]) > 1 and 2 * low < capacity:
            out.setdefault(2 * low, (by_size[low][0], by_size[low][1]))
        for high in kinds[at + 1 :]:
            if low + high >= capacity:
                break
            out.setdefault(low + high, (by_size[low][0], by_size[high][0]))
    return out


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Moves and exchanges between underfull bins that raise the sum of squared fills, until none is found."""
    size = lengths.tolist()
    fill = {b: sum(size[i] for i in own) for b, own in enumerate(bins)}
    under = {b for b in fill if fill[b] < capacity}
    place = {i: b for b in under for i in bins[b]}
    by_size: dict[int, set[int]] = defaultdict(set)
    for i in place:
        by_size[size[i]].add(i)
    sizes = sorted(by_size)

    def take(i: int) -> None:
        by_size[size[i]].discard(i)
        if not by_size[size[i]]:
            sizes.pop(bisect_left(sizes, size[i]))

    def put(i: int) -> None:
        if not by_size[size[i]]:
            insort(sizes, size[i])
        by_size[size[i]].add(i)

    def largest(low: int, high: int, bin_: int, below: int) -> int | None:
        """The longest piece of low < length <= high in another bin that is at most as full as `below`."""
        at = bisect_right(sizes, high) - 1
        while at >= 0 and sizes[at] > low:
            for i in by_size[sizes[at]]:
                if place[i] != bin_ and fill[place[i]] <= below:
                    return i
            at -= 1
        return None

    def shift(i: int, to: int) -> None:
        old = place[i]
        bins[old].remove(i)
        bins[to].append(i)
        place[i] = to
        fill[old] -= size[i]
        fill[to] += size[i]

    def close(b: int) -> None:
        """A full bin takes no further part; an empty one is gone."""
        if b in under and (fill[b] == capacity or not bins[b]):
            under.discard(b)
            for i in bins[b]:
                take(i)
                del place[i]

    again = True
    while again:
        again = False
        for b in sorted(under, key=lambda b: -fill[b]):
            while b in under and fill[b] < capacity:
                gap = capacity - fill[b]
                # Move: the longest piece that fits, out of a bin that is not fuller.
                i = largest(0, gap, b, fill[b])
                if i is not None:
                    other = place[i]
                    shift(i, b)
                    close(other)
                    close(b)
                    again = True
                    continue
                # One for one: a longer piece of a bin that is not fuller, as long as the gap allows; the fullest use of the gap first.
                best: tuple[int, int, int | None, int] | None = None
                own = sorted(bins[b], key=lambda i: size[i])
                for x in own:
                    y = largest(size[x], size[x] + gap, b, fill[b])
                    if y is not None and (best is None or size[y] - size[x] > best[0]):
                        best = (size[y] - size[x], x, None, y)
                        if best[0] == gap:
                            break
                # Two for one: two pieces of this bin for a longer one. Pairs of one sum are alike, so all pairs are tried by trying all sums.
                if best is None or best[0] < gap:
                    for both, (x, x2) in pair_sums(own, size, capacity).items():
                        y = largest(both, both + gap, b, fill[b])
                        if y is not None and (best is None or size[y] - both > best[0]):
                            best = (size[y] - both, x, x2, y)
                            if best[0] == gap:
                                break
                if best is None:
                    break
                _, x, x2, y = best
                other = place[y]
                shift(y, b)
                shift(x, other)
                if x2 is not None:
                    shift(x2, other)
                close(b)
                close(other)
                again = True
    return [own for own in bins if own]


def packed(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    return improve(best_fit(lengths, capacity), lengths, capacity)


def pack_blocks(rows: DataFrame, blocks: int, capacity: int) -> DataFrame:
    """Packs each of the column `block`: adds bin, offset and fill."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True]).reset_index(drop=True)
        lengths = part["length"].to_numpy(dtype=np.int64)
        bin_, offset, fill = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        for b, own in enumerate(packed(lengths, capacity)):
            at = np.cumsum(lengths[own]) - lengths[own]
            bin_[own], offset[own], fill[own] = b, at, lengths[own].sum()
        return part.assign(bin=bin_, offset=offset, fill=fill)

    return rows.groupBy("block").applyInPandas(one, f"block long, {PIECE}, bin long, offset long, fill long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, block: int = BLOCK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    cut = session.written(pieces(docs, path, capacity, end), "pieces")
    full, rest = cut.where(F.col("length") == capacity), cut.where(F.col("length") < capacity)
    blocks = -(-rest.count() // block) or 1
    first = session.written(pack_blocks(rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks))), blocks, capacity), "packed")
    poor = F.col("fill") < F.lit(int(REPACK_BELOW * capacity))
    left = first.where(poor)
    # The rests of many blocks make a block again; each leaves few bins, so a block of rests stays small.
    groups = -(-left.count() // block) or 1
    second = pack_blocks(left.select(F.pmod("block", F.lit(groups)).alias("block"), *[c.split()[0] for c in PIECE.split(", ")]), groups, capacity)
    columns = [c.split()[0] for c in PIECE.split(", ")]
    # Full pieces, first and second packing have numbers of their own: 0, 1, 2 modulo 3.
    number = lambda kind: (F.col("block") * (1 << 24) + F.col("bin")) * 3 + kind
    alone = full.select(*columns, (F.monotonically_increasing_id() * 3).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = [x.select(*columns, number(k).alias("sequence_id"), "offset") for k, x in ((1, first.where(~poor)), (2, second))]
    return alone.unionByName(parts[0]).unionByName(parts[1])
