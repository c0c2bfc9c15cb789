"""The registered query of each training-data operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import jaccard, langid, media, mixing, pii, quality, suffix_dedup, syncmers, token_counts, word_bpe
from .common import documents


def op1_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.next_likeness(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, ~langid.held_out())
    out = quality.predict(docs, model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.media_columns(documents(spark, sf_dir)))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.dedup(documents(spark, sf_dir)))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(documents(spark, sf_dir)))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    said = langid.predict(docs, langid.fit(docs.where(~langid.held_out())))
    return said.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir), words=3, percent=90).select("doc_id", "n_shingles", "component_id", "class_id")


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabularies keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(word_bpe.encode(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_syncmers, op2_mixing, op3_quality, op4_media, op5_suffix_dedup, op6_pii, op7_langid, op8_jaccard, op9_word_bpe, op10_token_counts)}

#: Queries whose rows SQL can express too.
ORACLES: dict[str, str] = {}
