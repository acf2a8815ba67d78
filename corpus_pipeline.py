"""A corpus from raw documents to token ids: judge, dedup, redact, mix and segment.

Every stage takes (spark, docs, sf_dir) and returns a frame, which `run` writes as Parquet to the shared folder and
reads again for the next stage. All stages but the last return the columns of `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanecost.llm import mixing, near_dedup, quality, secrets, sentence_pieces
from lanecost.llm.catalog import PIECES, vocabulary
from lanecost.llm.scratch import folder, released, stored

MIX_FRACTION = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule.

    Null and empty texts have fewer words than the base rule asks for and go; repeated rows are judged alike. A text is
    measured whole, however long. An empty table stays empty. Columns of any name pass through.
    """
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the smallest id; of rows that share this id, the first by text, source
    and language.

    Rows are judged by id and text, so texts that share an id but are not alike lie in classes of their own and stay.
    Equal rows are one document. Rows without an id stay. An id and its text are told apart by a 64-bit hash. Null and
    empty texts are linked with nothing. Columns of any name pass through.
    """
    row = docs.select(F.struct("*").alias("row"))
    known = row.where("row.doc_id IS NOT NULL")
    known = known.withColumn("key", F.xxhash64("row.doc_id", F.coalesce("row.text", F.lit("\u0000"))))
    found = near_dedup.classes(known, "key", "row.text")
    found = found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("class"))
    named = stored(known.select("key", "row.doc_id").distinct().join(found.distinct(), "key"))
    least = named.groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    first = named.join(least, ["class", "doc_id"]).select("key", "class")
    order = Window.partitionBy("class").orderBy("row.text", "row.source", "row.lang")
    rest = known.join(first, "key").withColumn("place", F.row_number().over(order)).where("place = 1")
    return rest.select("row.*").union(docs.where("doc_id IS NULL"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by marks in the text and n_chars counted anew where a text changed.

    Null and empty texts stay as they are; repeated rows are redacted alike. Columns of any name pass through.
    """
    raw = "_" * (1 + max(map(len, docs.columns))) + "raw"  # longer than any name of the table
    clean = secrets.redacted(docs.withColumn(raw, F.col("text")))
    n_chars = F.when(F.col("text").eqNullSafe(F.col(raw)), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return clean.withColumn("n_chars", n_chars).drop(raw)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares of sources, languages and topics are nearer to each other.

    Null sources and languages are classes of their own, null and empty texts a topic. Rows that share an id share a draw;
    rows without an id draw by source, language and text. An empty table stays empty. Columns of any name pass through.
    """
    row = docs.select(F.struct("*").alias("row"))
    own = {c: f"row.{c}" for c in ("doc_id", "source", "lang", "text")}
    return mixing.mixed(row, MIX_FRACTION, **own).where("mix.sampled").select("row.*")


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, piece_ids, n_pieces and lossless of every document.

    Null and empty texts have no pieces. Equal texts under one id are segmented alike. Other columns take no part.
    """
    out = sentence_pieces.segmented(docs, vocabulary(PIECES), keep=("doc_id", "source", "lang"))
    return out.withColumn("n_pieces", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_duplicates),
    ("secret_scans", secret_scans),
    ("mixing", mixing_sources),
    ("sentencepiece", segmentation),
]

# SQL does not draw segmentations; the tests run the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = folder(spark)
    for name, stage in STAGES:
        path = f"{base}/{name}"
        with released(spark):  # the stage's own intermediate tables go when its rows are written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
