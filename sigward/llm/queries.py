"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigward import session
from sigward.llm import binary_search, common, fingerprints, language, line_dedup, lm, mixing, ngram_join, packing, resampling, suffix_dedup, token_output, url_filter, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(session.prepare(spark), sf_dir)

    QUERIES[make.__name__] = run
    return run


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_files(common.documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end=0)


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(common.documents(spark, sf_dir))


ORACLES["op3_fingerprints"] = fingerprints.oracle()


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.documents(spark, sf_dir))


ORACLES["op9_mixing"] = mixing.oracle()


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(common.documents(spark, sf_dir))


ORACLES["op1_line_dedup"] = line_dedup.oracle()


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(language.document_evidence(common.documents(spark, sf_dir)))


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(common.documents(spark, sf_dir))


@query
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(common.documents(spark, sf_dir))


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(common.documents(spark, sf_dir)).drop("kept")


# The stated query set: every row whose id is divisible by this.
QUERY_EVERY = 20


@query
def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % QUERY_EVERY == 0)


ORACLES["op4_topk_search"] = binary_search.oracle(QUERY_EVERY)


# The rules of the URL filter: host, path and verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("host", "path", "verdict"), rule, strict=True)]) for rule in URL_RULES])
    rules = spark.range(1).select(F.inline(listed))
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules).drop("purity")


ORACLES["op13_url_filters"] = url_filter.oracle(URL_RULES)


@query
def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.drop("n_words")


ORACLES["op12_target_resampling"] = resampling.oracle()


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(common.documents(spark, sf_dir), variants.one_in_97)


ORACLES["op11_spelling_variants"] = variants.oracle()
