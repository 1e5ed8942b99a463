"""The corpus pipeline: toxicity filter, near-duplicate removal, benchmark decontamination, PII redaction, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame with the
columns of ``documents``; the last one adds the mixing order. Stages judge rows, so ids need not be unique.

Defined cases: null and empty texts are kept as one row (they are copies of one another); texts of any length are read
whole; of repeated rows one stays; null ids sort last; extra columns go through all stages, but for the columns that
mixing adds; an empty table, or one without labels or benchmark items, goes through as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm import common, decontaminate, jaccard_join, mixing, pii, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below 0.5."""
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of copies and near copies."""
    return jaccard_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced in the text."""
    return pii.redact_pii(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their place in the mixture (mix_slot, mix_row) and how it came about."""
    mixed = mixing.mix_sources(docs)
    own = [F.col(f"`{x}`") for x in docs.columns if x.lower() not in mixing.ADDED]
    return mixed.select(*own, *[F.col(c).cast("long").alias(c) for c in ("mix_block", "mix_phase", "mix_slot", "mix_row")])


STAGES = [("toxicity", toxicity_stage), ("jaccard_join", jaccard_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("mixing", mixing_stage)]

#: Models and MinHash retrieval are not expressible in SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every table that a stage wrote is deleted once the next one stands."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.Scope(spark) as scope:
            kept = scope.keep(common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        common.release(docs)
        docs = kept
    return docs
