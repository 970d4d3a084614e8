"""A training-data pipeline: quality, near duplicates, decontamination, personal data, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns the next stage's documents (the last one: packed pieces).  All but
the last return the columns of ``documents``.  ``run`` applies them in order
and writes what every stage kept to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapecode.llm import decontaminate, ngram_join, packing, pii, quality
from shapecode.llm.common import made, release, table, written
from shapecode.llm.queries import tokenizer_path

ORACLE_SQL = None          # SQL cannot express the stages; tests compare them with brute force


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality vote does not reject; all columns, whatever their names, pass through.

    Null and empty texts score the share of good rows among the labelled ones;
    repeated rows are judged alike; an empty table stays empty.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = "_score"
    while score in docs.columns:
        score += "_"
    return quality.score(docs, model, out=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest id.

    Null and empty texts are no duplicates of anything; repeated rows are one
    document; a null id stays on its own; an empty table stays empty.
    """
    return ngram_join.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages.

    Null and empty texts hold none; repeated rows go or stay together; an empty
    table stays empty.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind, n_chars counted anew.

    Null texts stay null with their n_chars; repeated rows are redacted alike;
    an empty table stays empty.
    """
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids.

    A null or empty text is its end id alone; repeated rows are packed as
    documents of their own; an empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", keep_one_of_group),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = made(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, keep=[*before, made(spark)[-1]])      # what the stage wrote on its way, and the stage before
    return STAGES[-1][1](spark, docs, sf_dir)
