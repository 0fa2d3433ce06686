"""The corpus pipeline: documents through two filters, deduplication, decontamination and encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``. ``run`` writes each stage's result to the shared folder and
reads it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.llm import bpe, decontam, near_dedup, rule_lists, zstd_quality
from fleetlens.llm.common import read_table, remainder, stage, unique_name

# No SQL expresses the trained and the hashed stages; tests hold them against brute force.
ORACLE_SQL = None


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1).select("doc_id", "quality")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the compression classifier scores 0.5 or more."""
    model = zstd_quality.fit(docs, training_labels(spark, sf_dir))
    score = unique_name(docs, "quality_score")
    return zstd_quality.score(docs, model, into=score).where(F.col(score) >= 0.5).drop(score)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rule and the learned decision list."""
    # The rules are learned from the counts that they then judge: the texts are counted once.
    counted = stage(rule_lists.statistics(docs), "counted")
    added = [c for c in counted.columns if c not in docs.columns]
    labelled = counted.select("doc_id", *rule_lists.BASE, *rule_lists.EXTRA, "base_failed").join(training_labels(spark, sf_dir), "doc_id")
    rules = rule_lists.learn(stage(labelled, "labelled"))
    return counted.where(~F.col("base_failed") & (rule_lists.verdict(rules) == 0)).drop(*added)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, that of the smallest id."""
    return near_dedup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents into which a benchmark item leaks."""
    return decontam.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the BPE ids of every whole text, their number, and whether they decode to the text."""
    return bpe.encode_checked(docs).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", one_of_each_group),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
