"""Spelling variants: words that differ by one code point, found by partition-and-enumerate signatures of their letters.

A word is the multiset of its letters, a binary vector with a place for each letter and each time it comes. Words one insertion, deletion or
replacement apart differ in at most DISTANCE = 2 places. The places are dealt into PARTS parts by hash; two such vectors agree on all
but two parts, so each choice of PARTS - 2 parts and what the vector has in them is a signature, and two vectors that are
near share one. Signatures are joined by equality and words that meet are verified by their edit distance.

Many words are made of the same letters, so a signature is refined by what else such pairs share exactly: with m the length of the
shorter word, the first m // 2 letters or the last m - m // 2 are the same in both. A word has a signature for each side and each of the
two m that it may have with a partner. This keeps groups small, loses no pair, and leaves little to verify.

A word's form is its near word that comes most often, if that comes twice as often or more; counts at least double along forms, so a
word's root is at most 62 forms away, and following roots of roots reaches it in six rounds or less.

The `noise` of the contract, by which a run of letters loses a code point in some documents, is a function of the caller.

Defined results: a null or empty text has no words. Rows that share a doc_id, or have none, are documents each. Words need LEAST_LETTERS
code points and LEAST_COUNT occurrences. Words without near words have none, no form, and are their own root. An empty table
gives no rows. Further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigward import session
from sigward.llm import common

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LETTERS = 5
LEAST_COUNT = 3
DISTANCE = 2
PARTS = 4
RATIO = 2
ROUNDS = 6
RUN_BYTES = 8 << 20
LOWER = {c: c + 32 for c in range(65, 91)}


def one_in_97(doc_id: int | None, run: str) -> str:
    """The run without one of its code points, where the checksum of doc_id and run says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, noise: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """word and n of all words of all texts; words of one letter run count once for each time they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", RUN_BYTES):
            total: Counter[str] = Counter()
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                own = Counter(LETTERS.findall((text.as_py() or "").translate(LOWER)))
                if noise is None:
                    total.update(own)
                else:
                    for word, n in own.items():
                        total[noise(doc_id, word)] += n
            long = [w for w in total if len(w) >= LEAST_LETTERS]
            yield pa.RecordBatch.from_arrays([pa.array(long, pa.string()), pa.array([total[w] for w in long], pa.int64())], ["word", "n"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def part_of(letter: str, time: int) -> int:
    """The part of a place of the vector; the checksum is scrambled, as its low bits follow those of the letter."""
    return (zlib.crc32(f"{letter}{time}".encode()) * 2654435761 >> 16) % PARTS


def signatures(word: str) -> list[int]:
    """Signed 64-bit signatures of a word: each PARTS - DISTANCE parts of its letters, with the first or last half for either length m."""
    import xxhash

    parts: list[list[str]] = [[] for _ in range(PARTS)]
    seen: Counter[str] = Counter()
    for letter in sorted(word):
        seen[letter] += 1
        parts[part_of(letter, seen[letter])].append(letter)
    size = len(word)
    halves = [half for m in (size, size - 1) for half in (f"{m}<{word[: m // 2]}", f"{m}>{word[size - (m - m // 2) :]}")]
    held = ["".join(p) for p in parts]
    chosen = [f"{which}" + "/".join(held[i] for i in which) for which in combinations(range(PARTS), PARTS - DISTANCE)]
    return [xxhash.xxh3_64_intdigest(f"{c} {h}") - (1 << 63) for c in chosen for h in halves]


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b) with a < b of all words (word, n) that differ by one code point, each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signatures(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(found, pa.list_(pa.int64()))], ["word", "n", "keys"])

    keyed = words.select("word", "n").mapInArrow(run, "word string, n long, keys array<long>")
    rows = session.written(keyed.select("word", "n", F.explode("keys").alias("key")), "signatures")
    side = lambda c: rows.select("key", F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    met = side("a").join(side("b"), "key").where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b", "n_a", "n_b").distinct()


def forms(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of a table of word and n."""
    pairs = session.written(near_pairs(words), "near-words")
    way = lambda a, b: pairs.select(F.col(a).alias("word"), F.struct((-F.col(f"n_{b}")).alias("minus"), F.col(b).alias("word")).alias("near"))
    best = way("a", "b").unionByName(way("b", "a")).groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("best"))
    met = words.join(best, "word", "left")
    formed = -F.col("best.minus") >= F.lit(RATIO) * F.col("n")
    table = met.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.minus")).alias("form_n"))
    table = session.written(table, "forms")
    return table.join(roots(table), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def roots(table: DataFrame) -> DataFrame:
    """word and root of the words with a form. Each round doubles the forms that are followed."""
    known = session.written(table.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    for _ in range(ROUNDS):
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = known.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = session.written(step, "roots")
        known = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return known


def variants(docs: DataFrame, noise: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """The words of all documents with their near words, forms and roots."""
    return forms(session.written(word_counts(docs, noise), "vocabulary"))


def oracle() -> str:
    upper = "".join(map(chr, range(65, 91)))
    return f"""
WITH RECURSIVE {common.CRC32_SQL},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {common.crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM counted, crc_table),
edited AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM edited GROUP BY word HAVING length(word) >= {LEAST_LETTERS} AND sum(n) >= {LEAST_COUNT}),
gaps AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word AS a, b.word AS b, b.n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word),
best AS (SELECT a AS word, count(*) AS n_near, min(struct_pack(minus := -n, near := b)) AS best FROM pairs GROUP BY a),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.minus >= {RATIO} * n THEN best.near END AS form, CASE WHEN -best.minus >= {RATIO} * n THEN -best.minus END AS form_n
  FROM words LEFT JOIN best USING (word)),
follow AS (SELECT word, word AS place, 0 AS step FROM forms UNION ALL SELECT f.word, g.form, step + 1 FROM follow f JOIN forms g ON f.place = g.word WHERE g.form IS NOT NULL)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN (SELECT word, max_by(place, step) AS root FROM follow GROUP BY word) USING (word)"""
