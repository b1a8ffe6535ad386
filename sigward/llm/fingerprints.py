"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Each paragraph (line) is hashed to a wide vector and a text's fingerprint is the sum of its paragraphs' vectors, each lane
modulo 2^32. The sum does not depend on the order of paragraphs, and a paragraph is put in or taken out by adding or
subtracting its vector (`insert`, `delete`), without the rest of the text.

A vector has DENSE lanes that every paragraph fills, which make equality safe (128 bits), and SPARSE lanes of which each
paragraph fills one, so that texts with common paragraphs agree in lanes. `likeness` is 1 for equal fingerprints, else the
share of agreeing lanes among the sparse lanes that either text fills. Only DataFrame functions are used.

Defined results: a null text is an empty text, which has one empty paragraph. Rows that share a doc_id follow one another by text; a null
doc_id comes last in descending order. The next document of a lone document is itself. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DENSE, SPARSE = 4, 64
LANE = 1 << 32
# Documents are put in order within runs of 2^10 ids; runs of runs are put in order the same way.
RUN_BITS = 10
BEFORE_ALL = -(1 << (63 - RUN_BITS)) - 1


def part(digest: Column, i: int) -> Column:
    """The i-th 32 bits of a hexadecimal digest as a number."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def numbers(text: Column) -> Column:
    """Each paragraph's hash as DENSE numbers of 32 bits."""
    digests = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.md5(p.cast("binary")))
    return F.transform(digests, lambda d: F.array(*[part(d, i) for i in range(DENSE)]))


def vector(paragraphs: Column) -> Column:
    """Sum of the paragraphs' vectors: DENSE, then SPARSE lanes. Give it a column of `numbers` of an earlier select, as each lane reads it."""
    add = lambda a, v: (a + v) % LANE
    total = lambda i: F.aggregate(paragraphs, F.lit(0).cast("long"), lambda a, n: add(a, n[i]))
    dense = F.array(*map(total, range(DENSE)))
    sparse = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(SPARSE - 1).cast("long")),
        lambda i: F.aggregate(paragraphs, F.lit(0).cast("long"), lambda a, n: F.when(n[0] % SPARSE == i, add(a, n[1])).otherwise(a)),
    )
    return F.concat(dense, sparse)


def as_text(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def insert(lanes: Column, paragraphs: Column) -> Column:
    """The fingerprint's lanes after the paragraphs (`numbers`) were added."""
    return F.zip_with(lanes, vector(paragraphs), lambda a, b: (a + b) % LANE)


def delete(lanes: Column, paragraphs: Column) -> Column:
    """The fingerprint's lanes after the paragraphs (`numbers`) were taken out."""
    return F.zip_with(lanes, vector(paragraphs), lambda a, b: (a - b + LANE) % LANE)


def likeness(a: Column, b: Column) -> Column:
    pairs = F.slice(F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), -1).when(x == y, 1).otherwise(0)), DENSE + 1, SPARSE)
    filled = F.size(F.filter(pairs, lambda x: x >= 0))
    same = F.size(F.filter(pairs, lambda x: x == 1))
    return F.when(a == b, 1.0).otherwise(F.coalesce(F.try_divide(same.cast("double"), filled.cast("double")), F.lit(0.0)))


def below(values: DataFrame, column: str, bits: int = 64) -> DataFrame:
    """Each of the distinct longs and the next smaller one (null for the smallest), without a sort of all in one task."""
    v, run = F.col(column), f"{column}_"
    if bits <= RUN_BITS:
        return values.select(column, F.lag(v).over(Window.orderBy(v)).alias("below"))
    runs = values.select(v, F.shiftright(v, RUN_BITS).alias(run))
    inside = runs.withColumn("below", F.lag(v).over(Window.partitionBy(run).orderBy(v)))
    tops = runs.groupBy(run).agg(F.max(v).alias("top"))
    before = below(tops.select(run), run, bits - RUN_BITS)
    before = before.join(tops.select(F.col(run).alias("below"), F.col("top").alias("under")), "below", "left").select(run, "under")
    first = inside.where(F.col("below").isNull()).join(before, run).select(column, F.col("under").alias("below"))
    return inside.where(F.col("below").isNotNull()).select(column, "below").unionByName(first)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text, that of the next document in descending doc_id; after the last comes the first."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.shiftright("doc_id", RUN_BITS), F.lit(BEFORE_ALL)).alias("run"))
    order = Window.partitionBy("run").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    run = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("place", F.row_number().over(order))
    heads = run.where(F.col("place") == 1).select(F.col("run").alias("to"), F.col("text").alias("head"))
    span = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    # Runs of the ids there are lie within so many bits, besides the one run of null ids.
    bits = 1 if span["a"] is None else ((span["a"] >> RUN_BITS) ^ (span["b"] >> RUN_BITS)).bit_length()
    runs = rows.select("run").distinct()
    known = below(runs.where(F.col("run") != BEFORE_ALL), "run", bits)
    top, lowest = (None, None) if span["a"] is None else (span["b"] >> RUN_BITS, span["a"] >> RUN_BITS)
    nulls = runs.where(F.col("run") == BEFORE_ALL).select("run", F.lit(BEFORE_ALL if top is None else top).cast("long").alias("to"))
    some_null = not nulls.isEmpty()
    links = known.select("run", F.coalesce("below", F.lit(BEFORE_ALL if some_null else top).cast("long")).alias("to")).unionByName(nulls)
    edges = run.where(F.col("next_text").isNull()).join(links, "run").join(heads, "to").select("doc_id", "text", F.col("head").alias("next_text"))
    return run.where(F.col("next_text").isNotNull()).select("doc_id", "text", "next_text").unionByName(edges)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and the likeness to it and to the next document."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), (n - half)), F.col("next_text").substr(F.lit(1), half))
    rows = with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *[numbers(F.col(c)).alias(c) for c in ("text", "edited", "next_text")])
    rows = rows.select("doc_id", "n_chars", "edited_sha256", *[vector(F.col(c)).alias(k) for c, k in (("text", "own"), ("edited", "changed"), ("next_text", "other"))])
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("other")).alias("near_next"),
    )


def oracle() -> str:
    number = lambda i: f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
pairs AS (SELECT r, doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST, text), first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, text)) AS next_text FROM docs),
texts AS (SELECT r, doc_id, text, length(text) AS n, next_text, left(text, (length(text) - length(text) // 2)::BIGINT) || left(next_text, (length(text) // 2)::BIGINT) AS edited FROM pairs),
kinds AS (SELECT r, 'own' AS kind, text AS t FROM texts UNION ALL SELECT r, 'changed', edited FROM texts UNION ALL SELECT r, 'other', next_text FROM texts),
hashed AS (SELECT r, kind, md5(unnest(string_split(t, chr(10)))) AS h FROM kinds),
numbers AS (SELECT r, kind, {", ".join(f"{number(i)} AS v{i}" for i in range(DENSE))} FROM hashed),
dense AS (SELECT r, kind, {" || ".join(f"printf('%08x', (sum(v{i}) % {LANE})::BIGINT)" for i in range(DENSE))} AS d FROM numbers GROUP BY ALL),
lanes AS (SELECT r, kind, v0 % {SPARSE} AS lane, (sum(v1) % {LANE})::BIGINT AS s FROM numbers GROUP BY ALL),
filled AS (SELECT k.r, k.kind, p.lane, coalesce(l.s, 0) AS s FROM dense k CROSS JOIN (SELECT unnest(range({SPARSE})) AS lane) p LEFT JOIN lanes l ON l.r = k.r AND l.kind = k.kind AND l.lane = p.lane),
marks AS (SELECT r, kind, string_agg(printf('%08x', s), '' ORDER BY lane) AS f FROM filled GROUP BY ALL),
whole AS (SELECT m.r, m.kind, d.d || m.f AS f FROM marks m JOIN dense d ON d.r = m.r AND d.kind = m.kind),
near AS (SELECT a.r, b.kind, sum((a.s = b.s AND a.s <> 0)::INT)::DOUBLE / nullif(sum((a.s <> 0 OR b.s <> 0)::INT), 0) AS share
  FROM filled a JOIN filled b ON a.r = b.r AND a.lane = b.lane WHERE a.kind = 'own' AND b.kind <> 'own' GROUP BY ALL)
SELECT t.doc_id, t.n::BIGINT AS n_chars, sha256(t.edited) AS edited_sha256, o.f AS fingerprint, c.f AS edited_fingerprint,
  CASE WHEN o.f = c.f THEN 1.0::DOUBLE ELSE coalesce(e.share, 0)::DOUBLE END AS near_edited, CASE WHEN o.f = x.f THEN 1.0::DOUBLE ELSE coalesce(y.share, 0)::DOUBLE END AS near_next
FROM texts t JOIN whole o ON o.r = t.r AND o.kind = 'own' JOIN whole c ON c.r = t.r AND c.kind = 'changed' JOIN whole x ON x.r = t.r AND x.kind = 'other'
LEFT JOIN near e ON e.r = t.r AND e.kind = 'changed' LEFT JOIN near y ON y.r = t.r AND y.kind = 'other'"""
