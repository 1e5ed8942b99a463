"""The receipt queue as an event log: a row for each change of state, the latest one being the state."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "queue_id string, status string, at timestamp_ntz, error string"
FORBIDDEN = ("beneficiary_id", "org_id", "lat", "lon", "name")
ALLOWED = ("queue_id", "disbursement_id", "programme_code", "amount_band", "window_key", "org_hash")


def state(events: DataFrame) -> DataFrame:
    return events.groupBy("queue_id").agg(F.max_by(F.struct("status", "at", "error"), F.struct("at", "status")).alias("s")).select("queue_id", "s.*")


def claim(events: DataFrame, n: int, at) -> DataFrame:
    """Exactly the events that claim the first n pending entries; append them, then mint from them."""
    first = state(events).where("status = 'PENDING'").orderBy("queue_id").limit(n)
    return first.select("queue_id", F.lit("CLAIMED").alias("status"), F.lit(at).cast("timestamp_ntz").alias("at"), F.lit(None).cast("string").alias("error"))


def mark(claimed: DataFrame, status: str, at, error: str | None = None) -> DataFrame:
    return claimed.select("queue_id", F.lit(status).alias("status"), F.lit(at).cast("timestamp_ntz").alias("at"), F.lit(error[:900] if error else None).cast("string").alias("error"))


def requeue(events: DataFrame, at, stranded_minutes: int = 5) -> DataFrame:
    """Failed entries, and claims older than some minutes, become pending again."""
    old = F.col("at") < F.lit(at).cast("timestamp_ntz") - F.expr(f"INTERVAL {stranded_minutes} MINUTES")
    return mark(state(events).where((F.col("status") == "FAILED") | ((F.col("status") == "CLAIMED") & old)), "PENDING", at)


def receipt_columns(df: DataFrame) -> DataFrame:
    """Only the columns that may leave with a receipt; forbidden ones are an error, not dropped in silence."""
    if bad := set(df.columns) & set(FORBIDDEN):
        raise ValueError(f"not for receipts: {sorted(bad)}")
    return df.select(*[c for c in ALLOWED if c in df.columns])


def with_retry(step: Callable, attempts: int = 5, first_ms: int = 400, sleep: Callable[[float], None] = time.sleep):
    """The result of ``step``; after a failure it waits 400 ms, then twice as long each time. The last failure is raised."""
    for n in range(attempts):
        try:
            return step()
        except Exception:
            if n == attempts - 1:
                raise
            sleep(first_ms * 2**n / 1000)
