"""The receipt queue as a stream: every entry is its own state machine, keyed by its bucket and number, with timers.

Commands come in (enqueue, claim, minted, failed), events go out (one for each command that had an effect or was refused,
and one for each timer). An entry's state lives with its number inside its bucket (BUCKETS): its claims meet in one task,
and two of them are worked one after the other, so that only one gets it. A claim that is not settled in time, and a
failure after its pause, return to PENDING by timer. Each claim has a number (``attempt``); a worker whose claim has been
given to another one is refused. State and timers are in the checkpoint, events in a file sink with a log of its own:
a restart repeats nothing and loses nothing.

Defined cases: commands without an entry, a kind or a worker where one is needed, and unknown kinds are refused as such;
an entry enqueued again stays as it is; a settled entry stays settled for ever (one row of state), so that nothing is
minted twice; of bids in one batch the earliest wins, ties to the smaller worker, then to the smaller command text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

COMMAND = "queue_id string, kind string, worker string, attempt int, at timestamp, error string"
EVENT = "queue_id string, status string, worker string, attempt int, at timestamp, note string"
ID = "queue_id string"
STATE = "status string, worker string, attempt int, due bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ERROR_LENGTH = 900
#: A command's place in its batch: an entry is there before it is claimed, and claimed before it is settled.
ORDER = {"ENQUEUE": 0, "CLAIM": 1, "MINTED": 2, "FAILED": 2}
#: Entries are keyed by their number inside buckets: a call to the state store costs more than a command, and the calls that
#: Spark makes for every group (its key, the times) are then made once a bucket and batch. Fixed for a checkpoint's life.
BUCKETS = 4096
NEW = (None, None, 0, None)  # the state of an entry that is not there
SAID = Row(*(c.split()[0] for c in EVENT.split(", ")))


class Entry(StatefulProcessor):
    """The queue entries of one bucket, each with a state of its own."""

    def __init__(self, stranded_ms: int, retry_ms: int):
        self.stranded_ms, self.retry_ms = stranded_ms, retry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("entry", ID, STATE)
        self.waiting = handle.getMapState("waiting", ID, "due bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Entry by entry, the commands of one after the other; its state is read once before them and written once after
        them."""
        now, entries, timers = timerValues.getCurrentProcessingTimeInMs(), {}, set()
        for r in rows:
            entries.setdefault(r.queue_id, []).append(r)
        for queue_id, commands in entries.items():
            if len(commands) > 1:
                commands.sort(key=lambda r: (ORDER.get(r.kind, 9), r.at is None, r.at and r.at.timestamp(), r.worker or "", str(r)))
            old = state = NEW if queue_id is None else self.state.getValue((queue_id,)) or NEW
            for r in commands:
                state, event = self._one(state, queue_id, r, now)
                yield event
            if state == old:
                continue
            self.state.updateValue((queue_id,), state)
            if state[3] is not None:
                self.waiting.updateValue((queue_id,), (state[3],))
                timers.add(state[3])
            elif old[3] is not None:
                self.waiting.removeKey((queue_id,))
        for due in timers:
            self.handle.registerTimer(due)

    def _one(self, state: tuple, queue_id: str | None, r: Row, now: int) -> tuple[tuple, Row]:
        """The entry's state after a command, and the command's event."""

        def say(status: str, note: str | None = None, attempt: int | None = r.attempt, then: tuple = state) -> tuple[tuple, Row]:
            return then, SAID(queue_id, status, r.worker, attempt, r.at, note)

        if queue_id is None or r.kind not in ORDER or (r.kind != "ENQUEUE" and r.worker is None):
            return say("REFUSED", "not a command")
        status, owner, attempt, due = state
        if r.kind == "ENQUEUE":
            if status is not None:
                return say("REFUSED", "already queued")
            return say("PENDING", attempt=0, then=("PENDING", None, 0, None))
        if r.kind == "CLAIM":
            if status != "PENDING":
                return say("REFUSED", f"is {status}" if status else "not queued")
            return say("CLAIMED", attempt=attempt + 1, then=("CLAIMED", r.worker, attempt + 1, now + self.stranded_ms))
        if status not in ("CLAIMED", "PENDING") or owner != r.worker or r.attempt not in (None, attempt):
            return say("REFUSED", "not this worker's claim")
        if r.kind == "MINTED":  # also after the timer, as long as no one else has claimed it: it was minted all the same
            return say("MINTED", attempt=attempt, then=("MINTED", r.worker, attempt, None))
        if status == "PENDING":
            return say("REFUSED", "already returned")
        return say("FAILED", (r.error or "")[:ERROR_LENGTH] or None, attempt, ("FAILED", r.worker, attempt, now + self.retry_ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """All entries of the bucket that wait no longer; one that was settled or claimed anew waits for nothing, or for
        another timer."""
        until, at = expiredTimerInfo.getExpiryTimeInMs(), datetime.fromtimestamp(timerValues.getCurrentProcessingTimeInMs() / 1000)
        for queue_id in [k[0] for k, (due,) in self.waiting.iterator() if due <= until]:
            status, owner, attempt, _ = self.state.getValue((queue_id,))
            self.state.updateValue((queue_id,), ("PENDING", owner, attempt, None))
            self.waiting.removeKey((queue_id,))
            yield SAID(queue_id, "PENDING", owner, attempt, at, "claim stranded" if status == "CLAIMED" else "after failure")


def read_commands(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(COMMAND).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def events(commands: DataFrame, stranded_seconds: float = 300, retry_seconds: float = 0) -> DataFrame:
    """The queue's events. The session needs the RocksDB state store (``use_state_store``)."""
    step = Entry(round(stranded_seconds * 1000), round(retry_seconds * 1000))
    dealt = commands.withColumn("_bucket", F.pmod(F.xxhash64("queue_id"), F.lit(BUCKETS)))
    return dealt.groupBy("_bucket").transformWithState(statefulProcessor=step, outputStructType=EVENT, outputMode="Append", timeMode="ProcessingTime")


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def run(df: DataFrame, out: str, checkpoint: str, once: bool = False, seconds: float = 4) -> StreamingQuery:
    """Events into Parquet, each once. ``once``: all that is there, then stop; timers that are due fire with it. A stream
    that goes on also looks at its timers when no command comes, which one that shall stop must not: it would never end."""
    w = df.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    if not once:
        return w.trigger(processingTime=f"{seconds} seconds").start()
    spark, name = df.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")  # the stream keeps the settings that it starts with
    try:
        return w.trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)


def current(log: DataFrame) -> DataFrame:
    """Each entry's state by the events alone: refusals change nothing; within an attempt a later status is greater."""
    rank = F.expr("CASE status WHEN 'PENDING' THEN if(note IS NULL, 0, 3) WHEN 'CLAIMED' THEN 1 WHEN 'FAILED' THEN 2 ELSE 4 END")
    kept = log.where("status <> 'REFUSED'").withColumn("_rank", F.struct("attempt", rank))
    return kept.groupBy("queue_id").agg(F.max_by(F.struct("status", "worker", "attempt"), "_rank").alias("s")).select("queue_id", "s.*")


def bids(pending: DataFrame, worker: str, n: int, at) -> DataFrame:
    """Claims of the first n pending entries; others may bid for the same ones, each goes to one worker."""
    first = pending.where("status = 'PENDING'").orderBy("queue_id").limit(n)
    return first.select("queue_id", F.lit("CLAIM").alias("kind"), F.lit(worker).alias("worker"), F.lit(None).cast("int").alias("attempt"), F.lit(at).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("error"))


def q_receipt_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The receipts of all delivered disbursements through the stream: two workers bid for every entry whose number is
    even, the earlier bid wins; the winners settle theirs, one in five as a failure, and losers' reports are refused.
    Entries by status, worker and attempt."""
    from ..plans import marts
    from ..plans.dialect import Spark
    from ..sources import shared

    use_state_store(spark)
    where = f"{shared.root(spark)}/receipts-{uuid.uuid4().hex}"
    done = spark.sql(marts.disbursements(Spark), orders=spark.read.parquet(f"{sf_dir}/orders.parquet")).where("status = 'DELIVERED'").selectExpr("disbursement_id AS id", "cast(delivered_at AS timestamp) AS t")
    early, late = "if(id % 4 = 0, 'b', 'a')", "if(id % 4 = 0, 'a', 'b')"
    steps = [("true", "'ENQUEUE'", "cast(NULL AS string)", 0), ("id % 2 = 0", "'CLAIM'", late, 20), ("id % 2 = 0", "'CLAIM'", early, 10)]
    steps += [("id % 2 = 0", "if(id % 5 = 0, 'FAILED', 'MINTED')", who, 30) for who in (early, late)]
    fields = "cast(id AS string) AS queue_id", "cast(NULL AS int) AS attempt", "cast(NULL AS string) AS error"
    one = lambda where, kind, worker, minutes: done.where(where).selectExpr(*fields, f"{kind} AS kind", f"{worker} AS worker", f"t + INTERVAL {minutes} MINUTES AS at")
    made = reduce(DataFrame.unionByName, (one(*s) for s in steps))
    made.write.parquet(f"{where}/commands")
    run(events(read_commands(spark, f"{where}/commands", 1_000_000), retry_seconds=3600), f"{where}/events", f"{where}/checkpoint", once=True).awaitTermination()
    for part in ("commands", "checkpoint"):
        fs, p = shared.path_of(spark, f"{where}/{part}")
        fs.delete(p, True)
    return current(spark.read.schema(EVENT).parquet(f"{where}/events")).groupBy("status", "worker", "attempt").count().withColumnRenamed("count", "entries")


Q_RECEIPT_STREAM_SQL = """SELECT status, worker, attempt, count(*) AS entries FROM (
    SELECT CASE WHEN o_orderkey % 2 <> 0 THEN 'PENDING' WHEN o_orderkey % 5 = 0 THEN 'FAILED' ELSE 'MINTED' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'b' WHEN o_orderkey % 2 = 0 THEN 'a' END AS worker, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS attempt
    FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus NOT IN ('P', 'O')) e GROUP BY ALL"""
