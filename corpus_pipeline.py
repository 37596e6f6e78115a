"""The corpus pipeline: from raw documents to packed token sequences.

Each stage takes all that the one before it kept. Null and blank texts pass the stages that
look for something in them and are judged by the quality classifier like any other text.
Rows with an equal ``doc_id`` are one document: they stay or go together where a stage
decides on documents (the first three), and a null ``doc_id`` stays there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywing.llm import decontam, neardup, packing, pii, quality
from tallywing.llm.queries import WORD_TOKENIZER, table
from tallywing.llm.tokens import bound_batches
from tallywing.session import materialize, ship, work_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model does not reject."""
    bound_batches(ship(spark))
    features = materialize(quality.features_table(docs), "features")
    model = quality.learn(features, table(spark, sf_dir, "labels"))
    scores = features.select("doc_id", quality.score_column(model, F.col("features")).alias("score"))
    return neardup.by_ids(docs, scores.filter(F.col("score") < quality.THRESHOLD), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of every group whose five-word shingles are linked at 0.8."""
    bound_batches(spark)
    linked = neardup.link_components(docs, width=5, percent=80)
    return neardup.by_ids(docs, linked.filter("component_id <> doc_id"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    bound_batches(spark)
    return neardup.by_ids(docs, decontam.contaminated(docs, table(spark, sf_dir, "benchmark")), "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs, pii.fit(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their place in sequences of 4096."""
    bound_batches(spark)
    return packing.pack_documents(docs, WORD_TOKENIZER, end_id=1, with_ids=True)


STAGES = [("quality classifier", keep_quality), ("minhash near-dedup", drop_near_duplicates),
          ("benchmark decontamination", drop_contaminated), ("personal data", redact_personal_data),
          ("best-fit packing", pack_sequences)]
#: Trained models and tokenizers are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each is stored and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return result
        path = work_dir(spark, "stage")
        result.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
