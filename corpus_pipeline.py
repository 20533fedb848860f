"""A corpus from raw documents to token digests, in stages; each reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.llm import bpe, decontam, neardup, pii, quality
from tracequarry.llm.common import table
from tracequarry.sources.shared import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled documents of the table, doesn't reject.

    Null and empty texts get the score of padding and are judged by it like all; without labels all score alike. Rows that
    repeat an id or a text are judged each for itself; extra columns are kept; an empty table stays empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id.

    Rows with a null text stay, and so does a text without a word unless another row has the same; of rows with one id and
    one text one stays; a null id stays only if no other of its group has an id; extra columns are kept."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to count as contaminated.

    Null and empty texts have no words and stay; benchmark rows without an id count; repeated rows are judged each for
    itself; an empty benchmark removes nothing; extra columns are kept."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data replaced by its kind.

    Null texts stay null; overlapping spans become one; n_chars, if there is such a column, counts the new text; no row goes;
    extra columns are kept."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of what is left; null and empty texts have no tokens, repeated rows stay."""
    return docs.select("doc_id", bpe.digests(spark, docs, bpe.vocabulary()).alias("r")).select("doc_id", F.col("r.*"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact),
    ("bpe", encode),
]

#: Learned models and library encodings aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Tables in between lie in the shared folder until the JVM ends."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
