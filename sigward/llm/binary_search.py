"""Exact top-k search of binary codes by incremental multi-index hashing.

A vector's code is the sign of each of its numbers, cut into m segments of so many bits that a segment value has about
CODES_A_VALUE codes. The search probes segment values at 0, 1, 2, ... bits from the query's, one segment after another, and verifies
what it finds. After radius r in the first j segments and r - 1 in the others, a code not seen yet differs in r + 1 bits in each of
the first and r bits in each of the others, so in m * r + j at least; a query ends once its k-th verified distance is below that. Each code is verified
where it is found first and nowhere else. Radii of few probes go through all segments in one step. Codes farther than a query's k-th so far do
not leave the join; at the start that is the k-th distance to SAMPLE codes, a bound and no more. Over all radii a query has m * 2^bits
probes, fewer than m * rows / CODES_A_VALUE * 2.

The index holds each distinct code once with its k + 1 smallest ids, so copies of a code, be they a third of all rows, are
one entry. Results are ordered by distance, then id.

Defined results: rows without a vector, with a null id or with another length than that of most vectors (ties: the longest) are neither indexed
nor asked. A null number is not positive. Rows that share an id and code are one; an id with several codes asks with each, and its result is the k nearest of all; a
query does not find its own id. With fewer than k other rows a query gets all of them.
An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigward import session

K = 10
MOST_BITS = 20
# A probe is exploded, shuffled and sorted; a verification is some bit counts in the join. So a probe should bring several codes.
CODES_A_VALUE = 8
# A step of its own costs about as much as so many probes.
STEP_PROBES = 1_000_000
SALTS = 64
SAMPLE = 256


def codes(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and segments, an array of numbers; the bits of a segment."""
    rows = vectors.where("vec_id IS NOT NULL AND size(embedding) > 0").select("vec_id", "embedding")
    lengths = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows"))
    seen = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    length, n = (seen["n"], seen["rows"]) if seen else (0, 0)
    parts = -(-length // max(4, min(MOST_BITS, (n // CODES_A_VALUE).bit_length())))
    bits = -(-length // max(parts, 1))
    bit = lambda a, x: a * 2 + F.coalesce(x > 0, F.lit(False)).cast("int")
    parts = [F.aggregate(F.slice("embedding", s + 1, bits), F.lit(0), bit) for s in range(0, length, max(bits, 1))]
    return rows.where(F.size("embedding") == length).select("vec_id", F.array(*parts).alias("segments")).distinct(), bits


def distance(a: Column, b: Column, m: int) -> Column:
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(m)), F.lit(0))


def smallest_ids(rows: DataFrame, most: int) -> DataFrame:
    """Each distinct code with its `most` smallest ids; a code's rows are first cut down in SALTS parts."""
    part = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    salted = rows.withColumn("salt", part).withColumn("place", F.row_number().over(Window.partitionBy("segments", "salt").orderBy("vec_id")))
    few = salted.where(F.col("place") <= most).withColumn("place", F.row_number().over(Window.partitionBy("segments").orderBy("vec_id")))
    return few.where(F.col("place") <= most).groupBy("segments").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def found_first(postings: DataFrame, active: DataFrame, step: list[int], radius: int, masks: list[int], m: int) -> DataFrame:
    """query_id, asked, vec_id and distance of codes at `radius` in a segment of `step` that no segment before has found."""
    own = F.inline(F.array(*[F.struct(F.lit(s).alias("s"), F.col("asked")[s].alias("own")) for s in step]))
    # Queries are few rows with many probes each, so they are dealt to all cores before they are spread out.
    asked = active.select("query_id", "asked", "bound", own).repartition(active.sparkSession.sparkContext.defaultParallelism, "query_id", "s")
    flips = F.split(F.lit(" ".join(map(str, masks))), " ").cast("array<int>")
    probes = asked.select("query_id", "asked", "bound", "s", F.explode(F.transform(flips, lambda x: F.col("own").bitwiseXOR(x))).alias("value"))
    p, i = probes.alias("p"), postings.alias("i")
    apart = distance(F.col("asked"), F.col("segments"), m)
    place = F.array_min(F.array(*[F.bit_count(F.col("asked")[s].bitwiseXOR(F.col("segments")[s])) * m + s for s in range(m)]))
    near = (apart <= F.col("bound")) & (place == F.col("p.s") + radius * m)
    # Probes grow as they are spread out, so neither side is broadcast.
    hits = p.hint("merge").join(i, (F.col("p.s") == F.col("i.s")) & (F.col("p.value") == F.col("i.value")) & near)
    return hits.select("query_id", "asked", F.explode("ids").alias("vec_id"), apart.cast("int").alias("distance")).where("query_id <> vec_id")


def top_k(vectors: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and distance: the k nearest other rows of each row that `queries` selects."""
    found, bits = codes(vectors)
    rows = session.written(found, "codes")
    held = rows.groupBy("vec_id").agg(F.count("*").alias("n"), F.max(F.size("segments")).alias("m"))
    all_rows, most, m = held.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.max("m")).first()
    if all_rows < 2:
        id_type = rows.schema["vec_id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, distance int")
    index = session.written(smallest_ids(rows, k + 1), "index")
    postings = index.select(F.posexplode("segments").alias("s", "value"), "segments", "ids")
    reach = min(k, all_rows - 1)
    some = [r["segments"] for r in index.orderBy(F.xxhash64("segments")).select("segments").limit(SAMPLE).collect()]
    far = F.lit(bits * m)
    if len(some) >= k + most:
        # So many of the sampled codes may be the query's own.
        sample = F.array(*[F.array(*map(F.lit, code)) for code in some])
        far = F.array_sort(F.transform(sample, lambda code: distance(F.col("asked"), code, m)))[k + most - 1]
    nothing = F.array().cast(f"array<struct<distance:int,vec_id:{rows.schema['vec_id'].dataType.simpleString()}>>")
    asked = rows.where(queries).select(F.col("vec_id").alias("query_id"), F.col("segments").alias("asked"))
    active = session.written(asked.select("*", far.cast("int").alias("bound"), nothing.alias("best")), "asked")
    waiting = active.count()
    finished = active.limit(0).select("query_id", "best")
    for radius in range(bits + 1):
        masks = [sum(1 << i for i in chosen) for chosen in combinations(range(bits), radius)]
        steps = [list(range(m))] if waiting * m * len(masks) <= STEP_PROBES else [[s] for s in range(m)]
        for step in steps:
            hits = found_first(postings, active, step, radius, masks, m)
            ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "asked").orderBy("distance", "vec_id")))
            new = ranked.where(F.col("rank") <= reach).groupBy("query_id", "asked").agg(F.collect_list(F.struct("distance", "vec_id")).alias("new"))
            best = F.slice(F.array_sort(F.concat("best", F.coalesce("new", nothing))), 1, reach)
            state = active.join(new, ["query_id", "asked"], "left").select("query_id", "asked", "bound", best.alias("best"))
            full = F.size("best") >= reach
            state = state.withColumn("bound", F.when(full, F.get("best", F.lit(reach - 1))["distance"]).otherwise(F.col("bound")))
            everything = radius == bits and step[-1] == m - 1
            state = session.written(state.withColumn("sure", F.lit(everything) | (full & (F.col("bound") <= m * radius + step[-1]))), "state")
            finished = finished.unionByName(state.where("sure").select("query_id", "best"))
            active = state.where("NOT sure").drop("sure")
            waiting = active.count()
            if not waiting:
                break
        if not waiting:
            break
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    near = finished.select("query_id", F.inline("best")).select("query_id", rank.alias("rank"), "vec_id", "distance")
    return near.where(F.col("rank") <= k)


def oracle(every: int, k: int = K) -> str:
    return f"""
WITH lengths AS (SELECT len(embedding) AS n FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
bits AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: coalesce(x > 0, false)::INT) AS code FROM embeddings JOIN lengths ON len(embedding) = n WHERE vec_id IS NOT NULL),
pairs AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, len(q.code) + 1), lambda i: (q.code[i] <> v.code[i])::INT))::INT AS distance
  FROM bits q JOIN bits v ON q.vec_id <> v.vec_id WHERE q.vec_id % {every} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= {k}"""
