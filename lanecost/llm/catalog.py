"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecost.llm import (
    byte_convolution,
    language_id,
    mixing,
    near_dedup,
    quality,
    secrets,
    sentence_pieces,
    source_divergence,
    spelling,
    substring_dedup,
    token_counts,
    token_files,
    topk,
)
from lanecost.llm.scratch import folder, stored

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
PIECES = "piece_bpe_32k.model"
TOKEN_LIMIT = 512
MIX_FRACTION = 0.5
GOOD = 0.7

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    known = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    labelled = docs.where(~held_out & known)
    model = language_id.fitted(labelled.select(F.col("doc_id").alias("id"), "lang", "text"))
    return language_id.predicted(docs, model, keep=(held_out.alias("held_out"),))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentence_pieces.segmented(_documents(spark, sf_dir), vocabulary(PIECES), keep=("doc_id",))
    n_pieces = F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long")
    return out.select("doc_id", n_pieces.alias("n_pieces"), "lossless", "piece_ids")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    path = folder(spark)
    token_counts.write(docs, path, vocabulary(TOKENIZER), keep=("n_bytes",))
    counted = token_counts.read(spark.read.parquet(path), TOKEN_LIMIT, keep=("n_bytes",))
    return counted.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "cut_chars"
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mixing.keyed(_documents(spark, sf_dir)).select("doc_id", "_cell", "_tokens", "_key")
    mix = mixing.drawn(stored(marked), MIX_FRACTION)  # without the texts, which are read once
    return mix.select(
        "doc_id",
        "mix.source",
        "mix.lang",
        "mix.topic",
        F.col("mix.tokens").alias("n_tokens"),
        F.round("mix.weight", 9).alias("cell_weight"),
        F.round("mix.prob", 9).alias("prob"),
        "mix.sampled",
    )


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(_documents(spark, sf_dir))
    # a row without an id is linked with nothing
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(rows, F.col("vec_id") % 50 == 0)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scanned(_documents(spark, sf_dir))
    base = len(secrets.KINDS) - 1

    def count(test: Callable[[Column], Column]) -> Column:
        return F.size(F.filter("secrets", test)).cast("long")

    def of_kind(rank: int) -> Column:
        return count(lambda s: s["rank"] == rank)

    return scanned.select(
        F.col("_id").alias("doc_id"),
        *[of_kind(r).alias(f"n_{secrets.KINDS[r]}") for r in range(base)],
        F.sha2(secrets.listing(F.col("secrets"), base), 256).alias("base_sha256"),
        secrets.listing(F.col("secrets")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_example"),
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    token_files.write(_documents(spark, sf_dir), path, vocabulary(TOKENIZER), END_ID)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(_documents(spark, sf_dir))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"]
    return judged.select(
        "doc_id", *[F.col(f"quality.{n}") for n in names[:-1]], F.array_join("quality.failed", ",").alias("failed")
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.deduplicated(_documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_documents(spark, sf_dir))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_documents(spark, sf_dir))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id AS id", "quality AS label")
    network = byte_convolution.fitted(docs.where(~held_out).withColumnRenamed("doc_id", "id"), labels)
    scored = byte_convolution.scored(docs, network, keep=("doc_id", held_out.alias("held_out")))
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
            op1_language_id,
            op2_sentencepiece,
            op3_token_counts,
            op4_mixing,
            op5_minhash_near_dedup,
            op6_exact_top_k,
            op7_secret_scans,
            op8_quality_rules,
            op9_token_files,
            op10_substring_dedup,
            op11_spelling_variants,
            op12_source_divergence,
            op13_quality_classifier,
        )}
