"""The corpus pipeline: five stages over `documents`, each on all that the one before it kept.

Toxic documents go, one document of each group of near copies stays, documents with benchmark passages go, secrets are masked,
and what is left is packed into sequences. ORACLE_SQL is None: SQL can express neither the net nor the tokenizer; the
stages are tested against definitions instead.

Every stage but the last returns the columns of its input, whatever their names. Null and empty texts are kept by the first
four: they are not toxic, have no copies (a text without words is in no group), no passages and no secrets; packing gives
them one piece with the end id alone. Of rows with one id and text the near-copy stage keeps one. Rows with null ids are kept, as the last
of their group. Without documents no stage has rows; without labels or benchmark items nothing is dropped for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontaminate, ngram_join, packing, secrets, toxicity
from lodestrata.llm.common import written
from lodestrata.session import table


def clear_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.cleared(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", clear_toxic),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("secrets", mask_secrets),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for `documents` (the pieces of every document that is kept, with their sequences and places there).

    What each stage keeps is written to the shared folder and read again. Hard rows are treated as the module tells.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
