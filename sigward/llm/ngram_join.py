"""N-gram Jaccard join: a size-aware heavy-light join of the documents' shingle sets.

Two sets with a likeness of `share` hundredths or more differ by few elements: a ninth of the smaller set at most for 90, a quarter for 80.

Small sets enumerate fixed-size subsets: every set left by so few deletions is a key, and a key of s elements that sets of n and m
share proves an overlap of s. The set of fewest elements under a key is linked with all that any set there is linked
with, so a key gives a row for each set and no pairs.

Large sets are met through inverted lists. Where each set would scan the lists of all corpus, lists are first cut into families. Elements
are dealt by hash into more parts than sets of that size can differ by, so linked sets agree in a whole part, and the
parts' contents are keys. Under a key, sets are held against each other by sketches: elements dealt into PLACES times as many places as sets
can differ by, one bit for each place, which tells odd numbers of elements from even ones. Linked sets differ in no more places than they may in
elements, so a pair that differs in more is no link, and families, the components of the pairs left, hold all links. Chance agreement in one part joins no families. Within one, a set
scans the inverted lists of its elements and counts overlaps exactly, until all sets that have not scanned are in one component.
To hold few sets against each other, each set first meets the smallest set of the key it has most keys in common with; then only keys whose
sets are not in one component are walked, and keys of the same sets once. More than FAMILY sets under a key or in a family are scanned in pairs of blocks.
The table of all keys goes as soon as the keys that sets share are written.

The boundary between small and large is the one of the least cost: subsets to enumerate against parts and elements to
send, summed over the sizes there are.

Sets that are equal are one set from the start. Defined results: a document without words (null, empty) has no shingles
and is linked with nothing. Rows that share a doc_id are one document for links, each with its own n_shingles; a null
doc_id has no links and a null component. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigward import session
from sigward.llm import common, graph

GRAM = 3
# 100 * intersection >= 90 * union.
SHARE, OF = 90, 100
SPARE = 1
MOST_SMALL = 30
FAMILY = 4_000
# Documents of families found by a hash join against this many ids at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
# Copies of sets that every task may hold (40 bytes each); more are met by a shuffle.
BROADCAST_COPIES = 400_000
# Places of a sketch for each element that sets may differ by, in whole words of 64 bits.
PLACES, WORD = 4, 64
RUN_BYTES = 8 << 20
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def differ(n: int, share: int = SHARE) -> int:
    """Elements by which a set of n, and one at least as large that it is linked with, differ at most."""
    return n * (OF - share) // share


def smallest_large(share: int = SHARE) -> int:
    """Smaller sets are linked with equal ones only."""
    return -(-share // (OF - share))


def shingle_sets(texts: pa.Array, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts on end, ascending within each; their number for each text."""
    import xxhash

    words, counts = common.words(texts)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()), dtype=np.uint64, count=len(words.dictionary))
    h = hashes[words.indices.to_numpy(zero_copy_only=False)]
    rolled = np.zeros(max(len(h) - gram + 1, 0), dtype=np.uint64)
    for k in range(gram):
        rolled = mix(rolled + np.full(1, A) * np.uint64(k + 1)) + h[k : len(h) - gram + 1 + k]
    rolled = mix(rolled)
    out, sizes, at = [], np.zeros(len(counts), dtype=np.int64), 0
    for i, n in enumerate(counts.tolist()):
        if n >= gram:
            own = np.unique(rolled[at : at + n - gram + 1])
        elif n:
            one = np.zeros(1, dtype=np.uint64)
            for x in h[at : at + n]:
                one = mix(one * B + x)
            own = mix(one + C * np.uint64(n))
        else:
            own = rolled[:0]
        out.append(own)
        sizes[i] = len(own)
        at += n
    return (np.concatenate(out) if out else rolled[:0]), sizes


def size_classes(most: int, share: int = SHARE) -> np.ndarray:
    """Starts of size classes: of linked sets, the larger is in the class of the smaller or in the next."""
    starts = [smallest_large(share)]
    while starts[-1] <= most:
        starts.append(starts[-1] * OF // share + 1)
    return np.array([*starts, starts[-1] * OF // share + 1], dtype=np.int64)


def part_keys(sets: np.ndarray, sizes: np.ndarray, share: int = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the parts of each set of smallest_large elements or more, and their number for each set."""
    starts = size_classes(int(sizes.max(initial=0)), share)
    own = np.searchsorted(starts, sizes, side="right") - 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keys, owners = [], []
    for back in (0, 1):
        scheme = own - back
        fits = scheme >= 0
        parts = np.where(fits, differ(starts[np.maximum(scheme, 0) + 1] - 1, share) + 1 + SPARE, 1)
        base = np.cumsum(parts) - parts
        held = fits[owner]
        of = owner[held]
        element = sets[held]
        place = base[of] + ((mix(element * C) >> np.uint64(33)).astype(np.int64) % parts[of])
        order = np.argsort(place, kind="stable")
        there, first = np.unique(place[order], return_index=True)
        if not len(there):
            continue
        content = np.add.reduceat(mix(element[order] + B), first)
        doc = of[order][first]
        # The lowest byte of a key tells the size class it was made for.
        tag = lambda k, d: (k << np.uint64(8)) | (scheme[d] & 255).astype(np.uint64)
        # A part without elements says nothing, unless a set has more of them than parts to spare.
        filled = np.bincount(doc, minlength=len(sizes))
        bare = np.flatnonzero(fits & (parts - filled > SPARE))
        label = lambda d, p: mix(scheme[d].astype(np.uint64) * A + p.astype(np.uint64))
        keys.append(tag(mix(content + label(doc, there - base[doc])), doc))
        owners.append(doc)
        for d in bare:
            empty = np.setdiff1d(np.arange(parts[d]), there[doc == d] - base[d])
            keys.append(tag(mix(label(np.full(len(empty), d), empty)), np.full(len(empty), d)))
            owners.append(np.full(len(empty), d))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    all_keys, all_owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(all_owners, kind="stable")
    return all_keys[order], np.bincount(all_owners, minlength=len(sizes))


def sketches(sets: np.ndarray, sizes: np.ndarray, back: int, share: int = SHARE) -> list[bytes]:
    """For each set a bit for each place of its size class (back = 0) or of the class below (back = 1); empty where there is no such class."""
    starts = size_classes(int(sizes.max(initial=0)), share)
    scheme = np.searchsorted(starts, sizes, side="right") - 1 - back
    places = np.where(scheme >= 0, -(-PLACES * differ(starts[np.maximum(scheme, 0) + 1] - 1, share) // WORD) * WORD, 0)
    ends = np.cumsum(places)
    owner = np.repeat(np.arange(len(sizes)), np.where(places > 0, sizes, 0))
    element = sets[np.repeat(places > 0, sizes)]
    at = (ends - places)[owner] + ((mix(element * A) >> np.uint64(33)).astype(np.int64) % np.maximum(places, 1)[owner])
    held = np.bincount(at, minlength=int(ends[-1]) if len(ends) else 0)
    flat = np.packbits((held & 1).astype(np.uint8))
    return [flat[(e - n) // 8 : e // 8].tobytes() for e, n in zip(ends.tolist(), places.tolist(), strict=True)]


def places_apart(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Places in which sketches (words of bits in the last dimension) differ."""
    return np.bitwise_count(one ^ other).sum(axis=-1, dtype=np.int64)


def ragged(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values.view(np.int64)))


def described(docs: DataFrame, gram: int = GRAM, share: int = SHARE) -> DataFrame:
    """doc_id, n, two sums that tell sets apart, the part keys and sketches of larger sets and the elements of smaller ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(iter([batch]), "text", RUN_BYTES):
                sets, sizes = shingle_sets(part.column("text"), gram)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(sets + k))]) for k in (A, B)]
                one, two = ((s[ends[1:]] - s[ends[:-1]]).view(np.int64) for s in sums)
                keys, n_keys = part_keys(sets, sizes, share)
                small = sizes <= MOST_SMALL
                few = ragged(sets[np.repeat(small, sizes)], np.where(small, sizes, 0))
                own, below = (pa.array(sketches(sets, sizes, back, share), pa.binary()) for back in (0, 1))
                kind = np.searchsorted(size_classes(int(sizes.max(initial=0)), share), sizes, side="right") - 1
                columns = [part.column("doc_id"), pa.array(sizes), pa.array(one), pa.array(two), ragged(keys, n_keys), few, pa.array(kind, pa.int32()), own, below]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "f1", "f2", "keys", "elements", "kind", "own", "below"])

    schema = "doc_id long, n long, f1 long, f2 long, keys array<long>, elements array<long>, kind int, own binary, below binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def subsets_of(n: int, share: int = SHARE) -> int:
    """Subsets left by up to differ(n) deletions."""
    out, term = 1, 1
    for k in range(1, differ(n, share) + 1):
        term = term * (n - k + 1) // k
        out += term
    return out


def boundary(sizes: list[tuple[int, int]], share: int = SHARE) -> int:
    """The size from which sets are large, of the least cost over (size, number of sets) pairs."""

    def cost(x: int) -> int:
        small = sum(c * subsets_of(n, share) for n, c in sizes if n <= (x - 1) * OF // share)
        large = sum(c * (2 * (differ(n, share) + 1 + SPARE) + n) for n, c in sizes if n >= x)
        return small + large

    # The sets next above a boundary are small too, and elements are kept of sets up to MOST_SMALL.
    return min((x for x in range(smallest_large(share), MOST_SMALL * share // OF + 1)), key=cost)


def small_links(sets: DataFrame, share: int = SHARE) -> DataFrame:
    """Edges (a, b) between small sets that share a subset large enough for both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key, size, n = [], [], [], []
            for d, elements in zip(batch.column("doc_id").to_pylist(), batch.column("elements"), strict=True):
                own = mix(elements.values.to_numpy().view(np.uint64))
                for gone in range(differ(len(own), share) + 1):
                    for out in combinations(range(len(own)), gone):
                        left = own.sum(dtype=np.uint64) if not out else np.delete(own, out).sum(dtype=np.uint64)
                        doc.append(d)
                        key.append(left)
                        size.append(len(own) - gone)
                        n.append(len(own))
            keys = np.array(key, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(keys), pa.array(size, pa.int32()), pa.array(n, pa.int32())], ["doc_id", "key", "size", "n"])

    keys = session.written(sets.select("doc_id", "elements").mapInArrow(run, "doc_id long, key long, size int, n int"), "subsets")
    hubs = keys.groupBy("key", "size").agg(F.min_by("doc_id", "n").alias("hub"), F.min("n").alias("hub_n"), F.count("*").alias("c")).where("c > 1")
    linked = F.lit(OF) * F.col("size") >= F.lit(share) * (F.col("n") + F.col("hub_n") - F.col("size"))
    return keys.join(hubs, ["key", "size"]).where(linked & (F.col("doc_id") != F.col("hub"))).select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))


def scan(sizes: np.ndarray, elements: np.ndarray, share: int = SHARE) -> np.ndarray:
    """Component (smallest index) of each set, by exact overlaps: sets scan inverted lists until those left are one component."""
    g = len(sizes)
    owner = np.repeat(np.arange(g), sizes)
    _, inverse, df = np.unique(elements, return_inverse=True, return_counts=True)
    held = df[inverse] > 1
    inverse, owner = inverse[held], owner[held]
    by_list = np.argsort(inverse, kind="stable")
    lists = owner[by_list]
    starts = np.searchsorted(inverse[by_list], np.arange(len(df) + 1))
    by_set = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=g))])
    component = np.arange(g)
    waiting = np.ones(g, dtype=bool)
    reach = np.bincount(owner, df[inverse], g)
    while True:
        left = np.flatnonzero(waiting)
        if not len(left):
            break
        values, first, counts = np.unique(component[left], return_index=True, return_counts=True)
        if len(values) == 1:
            break
        # The largest component waits as long as it can; of all others, the set with the longest lists scans first.
        others = left[component[left] != values[np.argmax(counts)]] if counts.max() > 1 else left
        x = others[np.argmax(reach[others])]
        waiting[x] = False
        mine = inverse[by_set[x] : by_set[x + 1]]
        n = starts[mine + 1] - starts[mine]
        at = np.repeat(starts[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(lists[at], minlength=g)
        linked = np.flatnonzero(OF * both >= share * (sizes + sizes[x] - both))
        labels = np.unique(np.append(component[linked], component[x]))
        if len(labels) > 1:
            component[np.isin(component, labels)] = labels[0]
    return component


def family_links(members: DataFrame, share: int = SHARE) -> DataFrame:
    """Edges within each block of a family of (block, doc_id, elements)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id").reset_index(drop=True)
        parts = [np.frombuffer(x, dtype=np.uint64) for x in rows["elements"]]
        found = scan(np.array([len(p) for p in parts], dtype=np.int64), np.concatenate(parts), share)
        ids = rows["doc_id"].to_numpy()
        return pd.DataFrame({"a": ids, "b": ids[found]}).query("a != b")

    return members.groupBy("block").applyInPandas(one, "a long, b long")


def elements_of(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """block and the elements of each document, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(iter([batch]), "text", RUN_BYTES):
                sets, sizes = shingle_sets(part.column("text"), gram)
                ends = np.cumsum(sizes)
                blobs = [sets[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("blocks"), pa.array(blobs, pa.binary())], ["doc_id", "blocks", "elements"])

    return docs.mapInArrow(run, "doc_id long, blocks array<string>, elements binary").select("doc_id", F.explode("blocks").alias("block"), "elements")


def in_blocks(members: DataFrame, group: str, node: str, size: str) -> DataFrame:
    """The members with `blocks`: a group of `size` members is cut into blocks of FAMILY, and each pair of blocks is one to scan."""
    parts = F.ceil(F.col(size) / FAMILY).cast("int")
    own = F.pmod(F.xxhash64(node), parts).cast("int")
    pair = lambda i: F.concat_ws(":", F.col(group).cast("string"), F.least(i, own).cast("string"), F.greatest(i, own).cast("string"))
    return members.withColumn("blocks", F.transform(F.sequence(F.lit(0), parts - 1), pair))


def plausible_pairs(pairs: DataFrame, share: int = SHARE) -> DataFrame:
    """The pairs (a, b) whose sketches do not rule out a link; a_ and b_ mark the columns n, own and below of either set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for one in batch.select(["a_n", "a_own", "a_below", "b_n", "b_own", "b_below"]).to_pylist():
                (n, own, _), (m, larger, below) = sorted([(one["a_n"], one["a_own"], one["a_below"]), (one["b_n"], one["b_own"], one["b_below"])])
                starts = size_classes(m, share)
                apart = np.diff(np.searchsorted(starts, [n, m], side="right"))[0]
                other = larger if apart == 0 else below
                gap = apart > 1 or places_apart(np.frombuffer(own, np.uint64), np.frombuffer(other, np.uint64)) > differ(n, share)
                held.append(not gap)
            yield batch.select(["a", "b"]).filter(pa.array(held, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def plausible_groups(members: DataFrame, share: int = SHARE) -> DataFrame:
    """Edges (a, b) that leave sets of a block in one component where sketches allow links between them.

    Members are (block, doc_id, component, n, sketch), where sets of one component need not be held against each other."""

    def joined(ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, sketch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        wide = max(map(len, sketch))
        table = np.stack([np.frombuffer(x.ljust(wide, b"\0"), np.uint64) for x in sketch])
        _, component = np.unique(labels, return_inverse=True)
        bound = np.array([differ(int(n), share) for n in sizes])
        waiting = np.ones(len(ids), dtype=bool)
        a, b = [], []
        while True:
            left = np.flatnonzero(waiting)
            values, counts = np.unique(component[left], return_counts=True)
            if len(values) < 2:
                break
            x = left[component[left] != values[np.argmax(counts)]][0]
            waiting[x] = False
            near = np.flatnonzero((component != component[x]) & (places_apart(table, table[x]) <= np.minimum(bound, bound[x])))
            for y in near:
                if component[y] != component[x]:
                    a.append(x)
                    b.append(y)
                    component[component == component[y]] = component[x]
        return ids[np.array(a, dtype=np.int64)], ids[np.array(b, dtype=np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            blocks = rows.column("block").to_numpy()
            ids, labels, sizes = (rows.column(c).to_numpy() for c in ("doc_id", "component", "n"))
            sketch = rows.column("sketch").to_pylist()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            found = [joined(ids[i:j], labels[i:j], sizes[i:j], sketch[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in (0, 1)], ["a", "b"])

        # Rows come in order of block; the last block of a batch waits for its rest.
        kept = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if kept is None else [*kept.to_batches(), batch])
            blocks = rows.column("block")
            start = int(np.flatnonzero(blocks.to_numpy() == blocks[-1].as_py())[0]) if len(rows) else 0
            if start:
                yield from edges(rows.slice(0, start))
            kept = rows.slice(start)
        if kept is not None and len(kept):
            yield from edges(kept)

    # Rows of a block follow each other, whatever tasks adaptive execution merges.
    return members.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long")


def shared_keys(sets: DataFrame) -> DataFrame:
    """key, weight and doc_id of the keys that several of the sets (doc_id, keys) have; keys of the same sets are one, of their number as weight."""
    # Both uses of the keys read one shuffle.
    keys = sets.select("doc_id", F.explode("keys").alias("key")).where("key IS NOT NULL").repartition("key")
    groups = keys.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"))
    of_sets = groups.where("c > 1").groupBy("c", "x", "y").agg(F.min("key").alias("key"), F.count("*").alias("weight"))
    return session.written(keys.join(of_sets.select("key", "weight"), "key").select("key", "weight", "doc_id"), "members")


def families(sets: DataFrame, members: DataFrame, share: int = SHARE) -> DataFrame:
    """node and component of the sets (doc_id, n, kind, own, below) that a link may join to another, by the keys that they share."""
    first = members.groupBy("key").agg(F.min("doc_id").alias("hub"))
    common_keys = members.join(first, "key").where("doc_id <> hub").groupBy("doc_id", "hub").agg(F.sum("weight").alias("w"))
    best = common_keys.groupBy("doc_id").agg(F.min(F.struct((-F.col("w")).alias("w"), "hub"))["hub"].alias("hub"))
    side = lambda name: sets.select(F.col("doc_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "own", "below")])
    pairs = best.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).join(side("a"), "a").join(side("b"), "b")
    near = session.written(plausible_pairs(pairs, share).distinct(), "near")
    label = graph.components(near).select(F.col("node").alias("doc_id"), "component")
    labelled = members.drop("weight").join(label, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    opened = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("g")).where("low < high")
    rest = in_blocks(labelled.join(opened.select("key", "g"), "key"), "key", "doc_id", "g").select("doc_id", "component", "key", F.explode("blocks").alias("block"))
    # A set goes with the sketch of its key's size class; another set of the same doc_id, of none of these classes, drops out.
    made_for = F.col("key").bitwiseAND(255)
    sketch = F.when(F.pmod("kind", F.lit(256)) == made_for, F.col("own")).when(F.pmod(F.col("kind") - 1, F.lit(256)) == made_for, F.col("below"))
    rest = rest.join(sets.select("doc_id", "n", "kind", "own", "below"), "doc_id").select("block", "doc_id", "component", "n", sketch.alias("sketch")).where("sketch IS NOT NULL")
    # The pairs are read in both directions.
    return graph.components(near.unionByName(session.written(plausible_groups(rest, share), "plausible")))


def large_links(docs: DataFrame, sets: DataFrame, members: DataFrame, gram: int = GRAM, share: int = SHARE) -> DataFrame:
    """Edges between large sets. `sets` holds one document for each distinct set, `members` the keys that these share."""
    found = families(sets, members, share)
    sizes = found.groupBy("component").agg(F.count("*").alias("g"))
    members = in_blocks(found.join(sizes, "component"), "component", "node", "g").select(F.col("node").alias("doc_id"), "blocks")
    members = session.written(members, "families")
    side = F.broadcast(members) if members.count() <= BROADCAST_IDS and members.agg(F.max(F.size("blocks"))).first()[0] in (None, 1) else members
    return family_links(elements_of(docs.select("doc_id", "text").join(side, "doc_id"), gram), share)


def ngram_join(docs: DataFrame, gram: int = GRAM, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles and component_id of each document, by shingles of `gram` words and a likeness of `share` hundredths."""
    whole, folder = session.written_at(described(docs, gram, share), "sets")
    table = session.written(whole.drop("keys"), "sketches")
    some = table.where("n > 0 AND doc_id IS NOT NULL")
    kinds = session.written(some.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")), "kinds")
    few = [(r["n"], r["c"]) for r in kinds.where(F.col("n") <= MOST_SMALL).groupBy("n").agg(F.count("*").alias("c")).collect()]
    first_large = boundary(few, share)
    set_of = ["n", "f1", "f2"]
    copies = session.written(some.select("doc_id", *set_of).join(kinds, set_of).where("doc_id <> rep").distinct(), "copies")
    # Copies of a set have the same keys, so only the first document of each set brings them.
    gone = copies.select("doc_id", *set_of)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_COPIES else gone
    firsts_of = lambda rows: rows.where("n > 0 AND doc_id IS NOT NULL").join(gone, ["doc_id", *set_of], "left_anti")
    sets = firsts_of(table)
    members = shared_keys(firsts_of(whole.select("doc_id", *set_of, "keys").where(F.col("n") >= first_large)))
    session.remove_folders(docs.sparkSession, [folder])
    small = small_links(sets.where((F.col("n") >= smallest_large(share)) & (F.col("n") <= (first_large - 1) * OF // share)), share)
    large = large_links(docs.where("doc_id IS NOT NULL"), sets.where(F.col("n") >= first_large), members, gram, share)
    edges = session.written(small.unionByName(large), "links")
    # Rows of one doc_id with different sets hang together.
    same = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    found = graph.components(edges.unionByName(same))
    out = table.select("doc_id", F.col("n").alias("n_shingles"), "n").join(found, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
