"""The corpus pipeline: stages from raw documents to packed sequences, each written before the next.

Every stage but the last returns the columns of documents. A document that a stage leaves
without a word is dropped there; all other documents go on, with their texts unchanged
where the stage found nothing to cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.llm import decontam, jaccard, langid, packing, shared, substring

#: A passage counts as repeated from so many words on.
REPEATED_WORDS = 50


def _with_words(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those that resemble no learned language. Rows with a null id are judged, not learned from; repeated rows are each judged."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: links are a Jaccard similarity of 0.8 over five-word shingles.

    The smallest id stays, with all rows of that id; rows with a null id and texts without words stay.
    """
    return shared.few_tasks(jaccard.one_of_each(docs, size=5, num=80, den=100))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of REPEATED_WORDS words or more that a document of a smaller id has too. Rows with a null id lose none."""
    return shared.few_tasks(_with_words(substring.without_repeats(docs, width=REPEATED_WORDS)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every span of ten words of a benchmark item, whatever the row's id. Null items and an empty benchmark hit nothing."""
    return _with_words(decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences, null ids and repeated rows included."""
    return packing.packed_documents(docs)


STAGES = [(f.__name__, f) for f in (language_id, near_duplicates, substring_dedup, decontamination, best_fit_packing)]
#: Language profiles, links and packing go beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the table documents. What only earlier stages needed is deleted once a stage's table is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = shared.made()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.written(docs, name)
            shared.drop(spark, [x for x in shared.made()[:-1] if x not in before])
    return docs
