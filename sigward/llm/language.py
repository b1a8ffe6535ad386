"""Language identification by Bayesian fusion of evidence.

Evidence on a document's language: its text, the language its markup declares, the suffix of its address, and what its
host mostly holds. The text's likelihood comes from byte trigrams, hashed to a fixed table for each language; an extra
class, "und", finds all trigrams alike, and text that it explains best is in no known language. The declaration's
likelihood is a smoothed table of declared against identified language. The prior is hierarchical: a host's counts are
smoothed by those of its address suffix, these by those of the corpus. Counts and tables are grouped aggregations over all
documents. The classes are the declared languages that LEAST_ROWS rows of the whole table have; only the trigram tables are
fitted on a bounded sample, of TRAIN_ROWS rows of each language at most, those of the smallest hashes of doc_id and text.

Digits, and the ASCII letters that touch them, count for nothing. Defined results: a document without another letter (null and empty texts too) is "und" and not kept. A null declaration, suffix
or host is a value of its own. Rows that share a doc_id are judged each. An empty table gives no rows. Further columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigward import session
from sigward.llm import common

# Rows of each language that its trigrams are counted in.
TRAIN_ROWS = 8_000
TABLE_BITS = 15
# A declared language is a class when it has so many rows of the table; more classes than MOST_LANGUAGES are refused.
LEAST_ROWS, MOST_LANGUAGES = 5, 200
# Hashes are counted in steps of a 64th of their power of two, so a sample is full to about a hundredth.
STEPS = 64
# Trigrams overlap and repeat, so each counts as a part of an independent observation.
TEMPER = 0.25
UND_PRIOR = 1e-4
SMOOTH, HOST_PRIOR = 1.0, 20.0
RUN_BYTES = 1 << 20
UND = "und"


def plain(texts: pa.Array) -> pa.Array:
    """The texts in lower case without digits and the ASCII letters that touch them: numbers, addresses and keys are in no language.

    Other letters stay, as a run without a blank is a whole sentence in many scripts.
    """
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[0-9a-z._/-]*[0-9][0-9a-z._/-]*", " ")


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Table places of all trigrams of the texts, and how many each text has; a blank stands before and after a text."""
    padded = pc.binary_join_element_wise("", texts, " ", " ")
    padded = padded.cast(pa.large_binary())
    _, offsets, data = padded.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[padded.offset : padded.offset + len(padded) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].astype(np.uint32) if len(padded) and data else np.zeros(0, np.uint32)
    counts = np.diff(ends) - 2
    if not len(raw):
        return np.zeros(0, np.uint32), counts
    code = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    keep = np.ones(len(raw), dtype=bool)
    last = ends[1:] - ends[0]
    keep[last - 1] = False
    keep[last - 2] = False
    return (code * np.uint32(2654435761) >> np.uint32(32 - TABLE_BITS))[keep[:-2]], counts


def sample(labelled: DataFrame, rows: int) -> tuple[list[str], DataFrame]:
    """The languages, and text, declared and `copies` of at most `rows` rows of each; rows of one doc_id and text are one, `copies` times."""
    many = labelled.groupBy("declared").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS)
    names = sorted(r["declared"] for r in many.select("declared").limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} declared languages")
    own = labelled.where(F.col("declared").isin(names)).withColumn("h", F.xxhash64("doc_id", "text"))
    step = F.floor(F.log2(F.pmod("h", F.lit(1 << 62)) + 1) * STEPS).cast("int")
    hashes = session.written(own.groupBy("declared", "h").agg(F.count("*").alias("copies")).withColumn("step", step), "hashes")
    # At most languages x 62 x STEPS rows, no text among them.
    held: dict[str, list[tuple[int, int]]] = {}
    for r in hashes.groupBy("declared", "step").agg(F.count("*").alias("n")).collect():
        held.setdefault(r["declared"], []).append((r["step"], r["n"]))
    ends = []
    for name, steps in held.items():
        total, end = 0, -1
        for at, n in sorted(steps):
            if total + n > rows:
                break
            total, end = total + n, at
        ends.append((name, end))
    last = F.broadcast(labelled.sparkSession.createDataFrame(ends, "declared string, last int"))
    repeated = hashes.where("copies > 1").join(last, "declared").where(F.col("step") <= F.col("last")).select("declared", "h", "copies")
    chosen = own.withColumn("step", step).join(last, "declared").where(F.col("step") <= F.col("last"))
    return names, chosen.join(F.broadcast(repeated), ["declared", "h"], "left").select("text", "declared", F.coalesce("copies", F.lit(1)).alias("copies"))


def count_grams(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and the log-likelihood table: one row of places for each language and one for `und`."""
    names, chosen = sample(docs.where("declared IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "declared"), rows)
    places = 1 << TABLE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for part in common.slices(iter([batch]), "text", RUN_BYTES):
                kinds = list(zip(part.column("declared").to_pylist(), part.column("copies").to_pylist(), strict=True))
                for kind in set(kinds):
                    code, _ = grams(plain(part.column("text").filter(pa.array([k == kind for k in kinds]))))
                    tables[kind] = tables.get(kind, 0) + np.bincount(code, minlength=places)
        for (name, copies), table in tables.items():
            there = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(there), pa.string()), pa.array([copies] * len(there), pa.int64()), pa.array(there, pa.int32()), pa.array(table[there], pa.int64())], ["lang", "copies", "place", "n"])

    found = chosen.mapInArrow(count, "lang string, copies long, place int, n long").groupBy("lang", "copies", "place").agg(F.sum("n").alias("n"))
    # Each of the copies of a row was counted.
    found = session.written(found.groupBy("lang", "place").agg(F.sum(F.expr("n div copies")).alias("n")), "trigrams").toPandas()  # at most languages x places rows
    table = np.zeros((len(names), places))
    table[found["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(dtype=np.int64), found["place"].to_numpy(dtype=np.int64)] = found["n"]
    logs = np.log((table + 0.05) / (table.sum(axis=1, keepdims=True) + 0.05 * places))
    return names, np.vstack([logs, np.full((1, places), -math.log(places))]).astype(np.float32)


def text_evidence(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id, declared, suffix, host, has_letter and the tempered log-likelihoods of the text."""
    by_place = np.ascontiguousarray(table.T)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(iter([batch]), "text", RUN_BYTES):
                texts = plain(part.column("text"))
                code, counts = grams(texts)
                out = np.zeros((len(counts), by_place.shape[1]))
                starts, there = np.cumsum(counts) - counts, np.flatnonzero(counts > 0)
                if len(there):
                    for k in range(by_place.shape[1]):
                        out[there, k] = np.add.reduceat(by_place[code, k], starts[there], dtype=np.float64)
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False)
                logs = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array((TEMPER * out).reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "declared", "suffix", "host")), letters, logs], ["doc_id", "declared", "suffix", "host", "has_letter", "logs"])

    return docs.select("doc_id", "text", "declared", "suffix", "host").mapInArrow(score, "doc_id long, declared string, suffix string, host string, has_letter boolean, logs array<double>")


def normal(logs: Column) -> Column:
    """Probabilities of log-likelihoods."""
    shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sums(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Expected rows of each class for the keys, as an array."""
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(n)]).alias("n"))


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, lang, confidence and kept of each row of (doc_id, text, declared, suffix, host)."""
    names, table = count_grams(docs, rows)
    n = len(names) + 1
    prior = [(1 - UND_PRIOR) / max(n - 1, 1)] * (n - 1) + [UND_PRIOR]
    start = F.array(*[F.lit(math.log(p)) for p in prior])
    facts = session.written(text_evidence(docs, table).withColumn("p", normal(add(F.col("logs"), start))), "text-evidence")
    judged = facts.where("has_letter")
    each = F.lit(n)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    # P(declared | language): a row of counts for each declared value, over the counts of all.
    declared = sums(judged, ["declared"], n)
    overall = judged.agg(*[F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)]).first()
    whole = [float(overall[i] or 0.0) for i in range(n)]
    says = declared.select("declared", F.transform("n", lambda x, i: F.log((x + SMOOTH) / (F.array(*map(F.lit, whole))[i] + SMOOTH * (n + 1)))).alias("says"))
    base = [(w + SMOOTH) / (sum(whole) + SMOOTH * n) for w in whole]
    corpus = F.array(*map(F.lit, base))
    smooth = lambda own, above: F.zip_with(own, above, lambda x, y: (x + HOST_PRIOR * y) / (total(own) + HOST_PRIOR))
    suffixes = sums(judged, ["suffix"], n).select("suffix", smooth(F.col("n"), corpus).alias("above"))
    hosts = sums(judged, ["suffix", "host"], n).select(F.col("suffix").alias("h_suffix"), F.col("host").alias("h_host"), F.col("n").alias("own"))
    hosts = hosts.join(suffixes, F.col("h_suffix").eqNullSafe(F.col("suffix"))).select("h_suffix", "h_host", F.transform(smooth(F.col("own"), F.col("above")), lambda x: F.log(x)).alias("prior"))
    with_says = facts.join(says.withColumnRenamed("declared", "d_declared"), F.col("declared").eqNullSafe(F.col("d_declared")), "left")
    joined = with_says.join(hosts, F.col("suffix").eqNullSafe(F.col("h_suffix")) & F.col("host").eqNullSafe(F.col("h_host")), "left")
    none = F.array_repeat(F.lit(0.0), each)
    fused = joined.withColumn("all", normal(add(add(F.col("logs"), F.coalesce("says", none)), F.coalesce("prior", start))))
    best = F.array_max("all")
    lang = F.when(F.col("has_letter"), F.array(*map(F.lit, [*names, UND]))[F.array_position("all", best).cast("int") - 1]).otherwise(F.lit(UND))
    return fused.select("doc_id", lang.alias("lang"), F.when(F.col("has_letter"), best).otherwise(F.lit(1.0)).alias("confidence"), (lang != UND).alias("kept"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents have a declared language and a source, which stands for the host; no address."""
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Raw pages: text without tags, the html element's lang, the host and its last label."""
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*+>", " ")
    declared = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1))
    return pages.select(
        F.col("page_id").alias("doc_id"), text.alias("text"), F.nullif(declared, F.lit("")).alias("declared"),
        F.nullif(F.regexp_extract(host, r"([a-z]+)$", 1), F.lit("")).alias("suffix"), F.nullif(host, F.lit("")).alias("host"),
    )
