"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of documents;
a column that a stage does not know passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import mixing, near_dedup, packing, quality_pu
from lodestrata.llm._common import fresh, held_out, rows_of, stored
from lodestrata.llm.line_dedup import deduplicated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts. A null text is scored as an empty
    one; rows that are alike score alike, so repeats stay or go together; a score of exactly the
    threshold stays. Without a positive label every document stays."""
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~held_out())
    labels = rows_of(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held_out())
    return quality_pu.accepted(docs, quality_pu.train(seen, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more in three documents or more stay in one of them. A document
    that loses all its lines stays, with an empty text."""
    out = deduplicated(docs, min_docs=3, min_chars=20, counts=None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id, at a similarity of
    0.8 over five words: what such stages take by default, where the query of the operator has
    0.85 by its own contract. Rows without an id or without words all stay; rows that share an id
    are one document, so they stay or go together."""
    [gone_id] = fresh(docs, "gone_id")
    gone = near_dedup.near_duplicates(docs, percent=80, k=5).where(~F.col("kept")).select(F.col("doc_id").alias(gone_id))
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(gone_id), "left_anti")


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The flattest mix that uses every document once at least and none more than 1.5 times its
    source's share allows; a document that is used again is a row again. A null source is a source
    of its own; texts without words are used once; rows of one source that share an id are used
    alike."""
    return mixing.mixed(docs, limit=1.5, cover=True)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in sequences of at most 4096. A null or empty text is its
    closing token; rows that share an id are packed each by itself."""
    return packing.pack_documents(docs, 4096)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_duplicates),
    ("mixing", mixing_weights),
    ("packing", best_fit_packing),
]

#: Trained models and tokenizers are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each stage's rows stored before the next reads them."""
    docs = rows_of(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
