"""Versioned rows over plain Parquet: edits append, reads choose the latest version at a moment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OFFSETS = (60, 120, 300, 600, 1800, 3600)


def as_of(versions: DataFrame, key: str, at) -> DataFrame:
    """The newest version of each key valid at ``at``. One aggregate with map-side combine, no window."""
    cols = [c for c in versions.columns if c != key]
    seen = versions.where(F.col("valid_from") <= F.lit(at).cast("timestamp_ntz"))
    return seen.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("valid_from", F.hash(*cols))).alias("r")).select(key, "r.*")


def at_offset(versions: DataFrame, key: str, now, seconds: int, retention_seconds: int) -> DataFrame | None:
    """None beyond the retention."""
    from datetime import timedelta

    return None if seconds > retention_seconds else as_of(versions, key, now - timedelta(seconds=seconds))


def now_and_before(versions: DataFrame, key: str, now, seconds: int = 300) -> DataFrame:
    from datetime import timedelta

    return as_of(versions, key, now).withColumn("version", F.lit("current")).unionByName(as_of(versions, key, now - timedelta(seconds=seconds)).withColumn("version", F.lit("before")))


def edit_score(versions: DataFrame, org_id, score: float, at, second_look: float = 55) -> DataFrame:
    """The row to append when one organisation's score is changed; its verdict follows."""
    row = as_of(versions, "org_id", at).where(F.col("org_id") == F.lit(org_id))
    verdict = F.when(F.lit(score) >= second_look, "needs a second look").when(F.col("is_verified"), "verified").otherwise("unverified")
    return row.withColumn("risk_score", F.lit(float(score))).withColumn("verdict", verdict).withColumn("valid_from", F.lit(at).cast("timestamp_ntz")).select(*versions.columns)
