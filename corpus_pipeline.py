"""A corpus made ready for training: five stages, each written as Parquet and read again as the next one's docs.

1. toxicity: documents that the classifier chain finds toxic go;
2. language: documents without letters, or without a language that has at least half of their letters, go;
3. near_duplicates: of each group of documents that the Jaccard join links, the one of the least doc_id stays;
4. decontaminate: documents that hold a window of a benchmark item go;
5. sentencepiece: the remaining documents' ids.

Defined results: null and empty texts, and others without letters, go with the language stage and are kept by all before it; of
repeated rows one stays from the third stage on, and of unrelated texts with one doc_id all do; rows without doc_id are not
compared as near duplicates and stay. Columns of any name pass through all stages but the last; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontaminate, language, near_join, pieces, toxicity
from vellum.llm.common import table, written

LEAST_SHARE = 0.5


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("p_toxic") < toxicity.THRESHOLD).select("row.*")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language.identify(docs, language.fit(docs))
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)).select("row.*")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, ["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", keep_clean),
    ("language", keep_language),
    ("near_duplicates", keep_one),
    ("decontaminate", keep_uncontaminated),
    ("sentencepiece", encode),
]

#: The classifier, the language model and the pieces are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
