"""Queries of the problems on matching, survivors and texts, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltsieve.llm import matching, mixing, quality, survivors, tokenizer
from siltsieve.session import cut, table

#: Calling code of the mobiles in these tables.
COUNTRY = "61"


def _vocabulary() -> tuple[str, str]:
    """Path and pre-tokenising pattern of the default public vocabulary; the files stay outside the repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_matches(spark, d).select("id_a", "id_b").distinct()


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.matched_ids(table(spark, d, "unified_records"), table(spark, d, "unified_partner"), COUNTRY)


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "unified_records"), table(spark, d, "source_profiles"), COUNTRY)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_survivors(spark, d).filter("best_row_id is not null").select("id", F.col("best_row_id").alias("row_id"))


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    return survivors.true_values(table(spark, d, "unified_records"), table(spark, d, "source_profiles"), COUNTRY)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, d, "documents"), *_vocabulary())


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose decoded ids are not their text; none."""
    path, _ = _vocabulary()
    back = tokenizer.decode_corpus(p8_ids(spark, d), path).withColumnRenamed("text", "decoded")
    return table(spark, d, "documents").select("doc_id", "text").join(back, "doc_id").filter(F.coalesce("text", F.lit("")) != F.col("decoded"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return cut(tokenizer.count_tokens(table(spark, d, "documents"), *_vocabulary()))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sized, targets = _sized(spark, d), table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(sized, targets), sized, targets)


def p9_shares_at_corpus_size(spark: SparkSession, d: str) -> DataFrame:
    """The report of a mixture as large as the corpus, where small sources are clamped at their caps."""
    sized, targets = _sized(spark, d), table(spark, d, "mix_targets")
    budget = float(sized.agg(F.sum("n_tokens")).first()[0] or 0)
    return mixing.shares(mixing.mix(sized, targets, budget), sized, targets, budget)


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(table(spark, d, "documents"), table(spark, d, "common_words"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_statistics(spark, d).filter("kind is not null").select("doc_id", "kind")


QUERIES = {f.__name__: f for f in (p2_found, p2_matches, p5_found, p5_survivors, p5_values, p8_ids, p8_round_trip, p9_mixture, p9_shares, p9_shares_at_corpus_size, p10_found, p10_statistics)}
