"""A corpus from raw documents to packed sequences, as a chain of stages.

Each stage takes the documents that its predecessor left, works on all of them, and returns the columns of documents;
the last returns the packed pieces. Between stages lies a Parquet table in the shared folder of the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigward import session
from sigward.llm import language, line_dedup, mixing, ngram_join, packing
from sigward.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay, with the language that was found. Rows that share a doc_id stay if any of them does."""
    found = language.identify(language.document_evidence(docs)).where("kept").groupBy("doc_id").agg(F.min("lang").alias("found"))
    # A document goes through the join as a struct, so that its columns may have any names.
    rows = docs.select(F.struct("*").alias("row")).join(found, F.col("row.doc_id").eqNullSafe(F.col("doc_id")))
    return rows.select(*[(F.col("found") if c == "lang" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first; a document left without any text goes too."""
    rows = line_dedup.with_kept(docs)
    rows = rows.where((F.col("dropped") == 0) | (F.trim(F.regexp_replace("kept", line_dedup.SPACE, " ")) != ""))
    n_chars = F.when(F.col("dropped") == 0, F.col("row.n_chars")).otherwise(F.char_length("kept").cast("long"))
    new = {"n_chars": n_chars, "text": F.col("kept")}
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


# Near copies of the corpus: shingles of five words, a likeness of 0.8.
GRAM, SHARE = 5, 80


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are alike, the one of the smallest doc_id stays, with all its rows; rows without a doc_id stay."""
    found = ngram_join.ngram_join(docs, GRAM, SHARE).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first"))
    gone = session.written(found.where("NOT first").select("doc_id"), "near-copies")
    # Few documents go, so that texts need no shuffle to leave them out.
    gone = F.broadcast(gone) if gone.count() <= ngram_join.BROADCAST_IDS else gone
    return docs.select(F.struct("*").alias("row")).join(gone, F.col("row.doc_id") == F.col("doc_id"), "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document passes once, those of small sources as often as the mixture asks."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_recurring_lines),
    ("ngram_join", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Tokenization and the language model are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = session.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
