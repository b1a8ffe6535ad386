"""Mixing sources to target weights by temperature.

A source's share q of all tokens is raised to an exponent between 0 (all sources alike) and 1 (as they are); the weights
are these powers over their sum. The smallest exponent is sought that keeps the repetition limit, or the largest that
reaches a target entropy: a section search that settles two decimals with each pass over the table of sources, six in
all. Weights times a budget give each source a number of passes: whole passes take all its documents, the last one takes
documents of a permutation until its share of the budget is used. Each pass is a permutation of its own, by a hash of
seed, pass and doc_id, cut into blocks of `block_tokens`.

Without a budget, the smallest one is taken that passes over every source once, so nothing is lost and the repetition
limit says how often a small source may come again.

A source may hold most documents: positions are summed within buckets of the permutation's hash, and buckets within the
source. Only DataFrame functions are used.

Defined results: tokens are words (runs without ASCII white space); a null text has none. A null source is a source of its
own. A source without tokens passes once. Rows that share a doc_id come each. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigward import session

MAX_REPEATS = 2.0
BLOCK_TOKENS = 1 << 20
# Hexadecimal digits of the permutation's hash that make a bucket: 4,096 buckets for each pass of a source.
BUCKET_DIGITS = 3
STEPS = 100


@dataclass(frozen=True)
class Plan:
    exponent: float
    budget: float
    passes: DataFrame


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def shares(docs: DataFrame) -> DataFrame:
    """source, n (tokens) and q (share of all tokens) of each source with tokens."""
    sums = session.written(docs.groupBy("source").agg(F.sum("n_tokens").alias("n")).where("n > 0"), "sources")
    total = sums.agg(F.sum("n").alias("n")).first()["n"] or 1
    return sums.select("source", "n", (F.col("n") / F.lit(float(total))).alias("q"))


def trial(table: DataFrame, low: float, step: float, budget: float | None) -> list:
    """Entropy and repeats at each of STEPS + 1 exponents, in one aggregation."""
    e = F.lit(low) + F.col("i") * F.lit(step)
    rows = table.select("n", "q", F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("i"))
    power = F.exp(e * F.log("q"))
    sums = rows.groupBy("i").agg(
        F.sum(power).alias("z"), F.sum(power * e * F.log("q")).alias("p"), F.sum("n").alias("total"),
        F.max(power / F.col("q")).alias("most"), F.min(power / F.col("q")).alias("least"),
    )
    repeats = F.col("most") / F.col("least") if budget is None else F.col("most") / F.col("z") * F.lit(budget) / F.col("total")
    return sums.select("i", (F.log("z") - F.col("p") / F.col("z")).alias("entropy"), repeats.alias("repeats")).orderBy("i").collect()


def find_exponent(table: DataFrame, entropy: float | None, max_repeats: float, budget: float | None) -> float:
    """To six decimals. Entropy and repeats both fall as the exponent grows."""
    low, step = 0.0, 1.0 / STEPS
    for _ in range(3):
        seen = trial(table, low, step, budget)
        if not seen:
            return 1.0
        if entropy is None:
            fits = [r["i"] for r in seen if r["repeats"] <= max_repeats + 1e-9]
            first = min(fits, default=STEPS)
            i = first - 1 if step > 1e-6 and first else first
        else:
            i = max((r["i"] for r in seen if r["entropy"] >= entropy - 1e-9), default=0)
        low = round(low + i * step, 6)
        if low >= 1:
            return 1.0
        step /= STEPS
    return low


def plan(docs: DataFrame, entropy: float | None = None, max_repeats: float = MAX_REPEATS, budget: float | None = None) -> Plan:
    """passes: source, n, weight, full (whole passes) and rest (tokens of the last pass)."""
    table = shares(docs)
    exponent = find_exponent(table, entropy, max_repeats, budget)
    powers = table.select("source", "n", F.exp(F.lit(exponent) * F.log("q")).alias("power"))
    sums = powers.agg(F.sum("power").alias("z"), F.max(F.col("n") / F.col("power")).alias("cover")).first()
    z, cover = sums["z"] or 1.0, sums["cover"] or 0.0
    total = cover * z if budget is None else float(budget)
    weighed = powers.select("source", "n", (F.col("power") / F.lit(z)).alias("weight"))
    target = F.col("weight") * F.lit(total)
    full = F.floor(target / F.col("n") + 1e-9)
    rest = F.greatest(F.round(target - full * F.col("n"), 3), F.lit(0.0))
    return Plan(exponent, total, weighed.select("source", "n", "weight", full.alias("full"), F.floor(rest + 1e-6).alias("rest")))


def order_key(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("pass"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, entropy: float | None = None, max_repeats: float = MAX_REPEATS, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """A row for each time a document comes: doc_id, source, pass, n_tokens, position (tokens of the pass before it), block."""
    rows = session.written(docs.select("doc_id", "source", word_count(F.col("text")).alias("n_tokens")), "words")
    made = plan(rows, entropy, max_repeats, budget)
    same = F.col("source").eqNullSafe(F.col("of"))
    # Joined by the source, a small row for each; a source that holds most rows is split by Spark's skew join.
    passes = made.passes.select(F.col("source").alias("of"), "full", "rest")
    dealt = rows.join(passes, same, "left").select("doc_id", "source", "n_tokens", F.coalesce("full", F.lit(1)).alias("full"), F.coalesce("rest", F.lit(0)).alias("rest"))
    last = F.when(F.col("rest") > 0, F.col("full")).otherwise(F.col("full") - 1)
    many = dealt.where(last >= 0).select("doc_id", "source", "n_tokens", "full", "rest", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("pass"))
    keyed = many.withColumn("key", order_key(seed)).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    run = ["source", "pass"]
    before = Window.partitionBy(*run).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = keyed.groupBy(*run, "bucket").agg(F.sum("n_tokens").alias("n")).select(*run, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*run, "bucket").orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    b = buckets.select(F.col("source").alias("b_source"), F.col("pass").alias("b_pass"), F.col("bucket").alias("b_bucket"), "before")
    joined = placed.join(b, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("pass") == F.col("b_pass")) & (F.col("bucket") == F.col("b_bucket")))
    out = joined.withColumn("position", F.col("inside") + F.col("before"))
    out = out.where((F.col("pass") < F.col("full")) | (F.col("position") + F.col("n_tokens") <= F.col("rest")))
    return out.select("doc_id", "source", "pass", "n_tokens", "position", F.floor(F.col("position") / block_tokens).alias("block"))


def repeated(docs: DataFrame, **goal) -> DataFrame:
    """The documents, each as often as `mix` has it."""
    key = ["doc_id", "source", "n_tokens"]
    times = mix(docs, **goal).groupBy(*key).agg(F.count("*").alias("times")).select(*[F.col(c).alias(f"of_{c}") for c in key], "times")
    # A document goes through as a struct, so that its columns may have any names.
    counted = docs.select(F.struct("*").alias("row"), "doc_id", "source", word_count(F.col("text")).alias("n_tokens"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in key]
    rows = counted.join(times, same[0] & same[1] & same[2])
    # Rows that agree in the key share its number of passes.
    alike = Window.partitionBy(*key)
    rows = rows.withColumn("alike", F.count("*").over(alike)).withColumn("place", F.row_number().over(alike.orderBy("row.text")))
    own = F.floor(F.col("times") / F.col("alike")) + (F.col("place") <= F.col("times") % F.col("alike")).cast("long")
    many = rows.where(own > 0).withColumn("copy", F.explode(F.array_repeat(F.lit(1), own.cast("int"))))
    return many.select("row.*")


def oracle(max_repeats: float = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> str:
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
shares AS (SELECT source, sum(n_tokens)::BIGINT AS n, sum(n_tokens)::DOUBLE / sum(sum(n_tokens)) OVER () AS q FROM words GROUP BY source HAVING sum(n_tokens) > 0),
span AS (SELECT max(q) / min(q) AS ratio FROM shares),
search AS (SELECT 0 AS round, 0::BIGINT AS low, 1000000::BIGINT AS high UNION ALL
  SELECT round + 1, CASE WHEN ok THEN low ELSE mid + 1 END, CASE WHEN ok THEN mid ELSE high END
  FROM (SELECT round, low, high, (low + high) // 2 AS mid, pow(ratio, 1 - ((low + high) // 2) / 1e6) <= {max_repeats} + 1e-9 AS ok FROM search, span WHERE round < 25 AND low < high)),
exponent AS (SELECT max_by(low, round) / 1e6 AS e FROM search),
powers AS (SELECT source, n, exp(e * ln(q)) AS power FROM shares, exponent),
sums AS (SELECT sum(power) AS z, max(n / power) AS cover FROM powers),
weighed AS (SELECT source, n, power / z AS weight, power / z * cover * z AS target FROM powers, sums),
passes AS (SELECT source, n, floor(target / n + 1e-9)::BIGINT AS whole, floor(greatest(round(target - floor(target / n + 1e-9) * n, 3), 0) + 1e-6)::BIGINT AS rest FROM weighed),
dealt AS (SELECT w.*, coalesce(p.whole, 1) AS whole, coalesce(p.rest, 0) AS rest FROM words w LEFT JOIN passes p ON w.source IS NOT DISTINCT FROM p.source),
many AS (SELECT *, unnest(range((whole + (rest > 0)::INT)::BIGINT)) AS pass FROM dealt),
keyed AS (SELECT *, md5('{seed}:' || pass || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM many),
placed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, pass ORDER BY key, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM keyed)
SELECT doc_id, source, pass::BIGINT AS pass, n_tokens, position, (position // {block_tokens})::BIGINT AS block FROM placed WHERE pass < whole OR position + n_tokens <= rest"""
