"""Raw documents to a training mix: five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import decontam, mixing, neardup, pii, quality
from tallybook.llm.common import columns_of
from tallybook.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the table ``labels``.

    Null and empty texts have the evidence of empty texts; repeated rows share one fate.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.classify(docs, labels)
    return found.where(found.columns[-1]).select(*columns_of(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.

    Texts without words are no one's duplicate and stay.
    """
    return neardup.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the table ``benchmark``; null and empty texts hold none."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, follows a changed text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the new text.

    Null and empty texts stay as they are, repeated rows stay repeated.
    """
    return _counted(pii.redact_pii(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time it takes a document, border texts cut (see the operator)."""
    return _counted(mixing.mixed_documents(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("personal data", pii_stage),
    ("source mixing", mixing_stage),
]

#: Classifier, SimHash windows and transducers have no SQL form: the stages are tested
#: against brute-force versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{place}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
