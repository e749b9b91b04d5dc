"""A corpus pipeline: quality rules, exact dedup, near-duplicate removal, secret redaction, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns they got.
Between stages the rows are written as Parquet to the shared folder and read again, so a lost executor repeats one stage
at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflow.llm.common import staged, table, unstage
from rasterflow.llm.exact_dedup import without_copies
from rasterflow.llm.ngram_join import Similarity, ngram_join
from rasterflow.llm.packing import pack_documents
from rasterflow.llm.quality_rules import quality_rules
from rasterflow.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled rules keep. Other columns are carried aside, so that their
    names never meet the operator's. A null text has no words and goes; repeated rows and null ids are judged like any other;
    without labels only the base rules reject; no rows in, no rows out."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "lang")]
    carried = docs.select("doc_id", "text", "lang", F.struct(*rest).alias("_rest")) if rest else docs
    kept = quality_rules(carried, table(spark, sf_dir, "labels")).where("kept")
    return kept.select(*(F.col("_rest")[c].alias(c) if c in rest else F.col(c) for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts: of most code points, then least id. Null texts are one class with blank
    ones; of repeated rows one stays, null ids come last; no rows in, no rows out."""
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each component of similar texts (five-word n-grams, similarity 0.8 or more). Texts without
    words, null ones too, and rows of null id link with nothing and stay; rows of one id stay or go together."""
    gone = ngram_join(docs, Similarity(words=5, part=80)).where("component_id <> id").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind in brackets; null and empty texts stay as they are."""
    return redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in training sequences; a null or empty text is one piece of its end id; ties
    of length go by id, piece and content; no rows in, no rows out."""
    return pack_documents(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near duplicates", near), ("secret scans", secrets), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table is deleted once the next one is written; the last one's input stays, as
    the result reads it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Packing tokenises, which SQL cannot state; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
