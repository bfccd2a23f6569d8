"""Corpus pipeline: quality rules, toxicity, near-dedup, mixing, packing; each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sarnai.llm import mixing, packing, quality, simhash, toxicity
from sarnai.llm.common import materialize, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the labels of the documents that are left, held-out ids excepted."""
    return toxicity.drop_toxic(docs, toxicity.train(toxicity.training_rows(docs, table(spark, sf_dir, "labels"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies that mixing made are packed each; a piece's place is (sequence_id, offset), as copies share doc_id and start."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]
ORACLE_SQL = None  # tokenisers and a trained model are not SQL; held against brute force in the tests
RUN_NAME = "sarnai.pipeline.run"  # session setting; a run with a name resumes after the last stage that was written whole


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, name = table(spark, sf_dir, "documents"), spark.conf.get(RUN_NAME, None)
    for at, (title, stage) in enumerate(STAGES):
        docs = stored(spark, docs, sf_dir, stage, f"stage-{at}-" + title.replace(" ", "-").lower(), name)
    return docs


def stored(spark: SparkSession, docs: DataFrame, sf_dir: str, stage, tag: str, name: str | None) -> DataFrame:
    """The stage's rows as a table in the shared folder; read, and not made again, if a run of that name has written it."""
    done = written(spark, tag, name)
    return materialize(stage(spark, docs, sf_dir), tag, name) if done is None else done
