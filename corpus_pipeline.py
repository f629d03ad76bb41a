"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, redaction of personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import pii
from tidewatch.llm.common import materialize
from tidewatch.llm.line_dedup import dedup_lines
from tidewatch.llm.ngram_join import first_of_each, jaccard_components
from tidewatch.llm.packing import pack_by_curve
from tidewatch.llm.quality import keep_fertile
from tidewatch.llm.queries import bpe_vocabulary, rule_pieces, rule_vocabularies

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _as_documents(docs: DataFrame, text) -> DataFrame:
    """The columns of documents with another text; n_chars follows it."""
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass, their rows unchanged; a null or empty text has no words and fails."""
    return keep_fertile(docs.select(*COLUMNS), rule_vocabularies(spark), rule_pieces(spark))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that others keep; a null text stays null, a row without an id loses nothing."""
    out = dedup_lines(docs)
    return _as_documents(out, F.when(F.col("text").isNotNull(), F.col("kept_text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of alike documents, with all rows of that id; a document without an id is kept, as it names no group."""
    return first_of_each(docs.select(*COLUMNS), jaccard_components(docs))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind; null and empty texts stay."""
    return _as_documents(pii.redact(docs), F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids; a null text is empty and gives its end mark."""
    return pack_by_curve(docs, bpe_vocabulary(spark), length=2048)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("redact_pii", redact_pii), ("pack", pack)]

#: Tokenizers, trained trees and components can't be stated in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
