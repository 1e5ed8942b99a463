"""The receipt queue as a stream: competing claims, timers, restarts."""

import time
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import Row

from tallyworks.streaming import receipt_queue as rq

SF = "/root/testdata/sf0.001"
T0 = datetime(2026, 1, 1)


@pytest.fixture
def queue(spark, tmp_path):
    rq.use_state_store(spark)
    n = [0]

    def step(*commands, stranded=300, retry=0):
        """One start of the stream, which ends with all that is there: each call is a restart from the checkpoint."""
        rows = [(q, kind, worker, attempt, T0 + timedelta(seconds=at), error) for q, kind, worker, attempt, at, error in commands]
        n[0] += 1
        spark.createDataFrame(rows, rq.COMMAND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rq.run(rq.events(rq.read_commands(spark, f"{tmp_path}/in"), stranded, retry), f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination(120)
        log = spark.read.schema(rq.EVENT).parquet(f"{tmp_path}/out")
        return {r.queue_id: (r.status, r.worker, r.attempt) for r in rq.current(log).collect()}, log

    return step


def test_two_claimers_never_get_one_entry(spark, queue):
    entries = [(f"q{i}", "ENQUEUE", None, None, 0, None) for i in range(20)]
    state, log = queue(*entries, *entries[:3])
    assert set(state.values()) == {("PENDING", None, 0)} and log.where("note = 'already queued'").count() == 3
    pending = spark.createDataFrame([(q, s[0]) for q, s in state.items()], "queue_id string, status string")
    both = [tuple(r) for w, at in (("a", 2), ("b", 1)) for r in rq.bids(pending, w, 12, T0 + timedelta(seconds=at)).selectExpr("queue_id", "kind", "worker", "attempt", f"{at} AS at", "error").collect()]
    assert len(both) == 24
    state, log = queue(*both)
    won = log.where("status = 'CLAIMED'").collect()
    assert len(won) == len({r.queue_id for r in won}) == 12 and {r.worker for r in won} == {"b"}
    assert log.where("status = 'REFUSED' AND worker = 'a' AND note = 'is CLAIMED'").count() == 12
    q = won[0].queue_id
    state, log = queue((q, "MINTED", "a", None, 3, None), (q, "MINTED", "b", 1, 4, None), (q, "MINTED", "b", 1, 5, None), (q, "CLAIM", "c", None, 9, None))
    assert state[q] == ("MINTED", "b", 1) and log.where("status = 'MINTED'").count() == 1


def test_timers_return_stranded_and_failed_entries(queue):
    settings = {"stranded": 2, "retry": 1}
    state, _ = queue(*[(q, "ENQUEUE", None, None, 0, None) for q in "xyz"], *[(q, "CLAIM", "a", None, 1, None) for q in "xyz"], ("y", "FAILED", "a", 1, 2, "e" * 2000), **settings)
    assert state == {"x": ("CLAIMED", "a", 1), "y": ("FAILED", "a", 1), "z": ("CLAIMED", "a", 1)}
    queue(("z", "MINTED", "a", 1, 3, None), **settings)
    time.sleep(3)
    state, log = queue(("other", "ENQUEUE", None, None, 0, None), **settings)
    assert state == {"x": ("PENDING", "a", 1), "y": ("PENDING", "a", 1), "z": ("MINTED", "a", 1), "other": ("PENDING", None, 0)}
    assert {(r.queue_id, r.note) for r in log.where("status = 'PENDING' AND attempt = 1").collect()} == {("x", "claim stranded"), ("y", "after failure")}
    assert {len(r.note) for r in log.where("status = 'FAILED'").collect()} == {rq.ERROR_LENGTH}
    state, log = queue(("x", "CLAIM", "b", None, 4, None), ("x", "MINTED", "a", 1, 5, None), stranded=300)
    assert state["x"] == ("CLAIMED", "b", 2) and log.where("note = 'not this worker''s claim'").count() == 1
    state, _ = queue(("x", "MINTED", "b", 2, 6, None), stranded=300)
    assert state["x"] == ("MINTED", "b", 2)


def test_odd_commands_are_refused(queue):
    state, log = queue((None, "ENQUEUE", None, None, 0, None), ("q", None, "a", None, 0, None), ("q", "CLAIM", None, None, 0, None), ("q", "CLAIM", "a", None, 0, None), ("q", "MINTED", "a", None, 0, None), ("q", "DANCE", "a", None, 0, None))
    assert state == {} and log.count() == 6 == log.where("status = 'REFUSED'").count()


def test_registered_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{SF}/orders.parquet'")
    got = sorted(map(tuple, rq.q_receipt_stream(spark, SF).select("status", "worker", "attempt", "entries").collect()), key=str)
    assert got and got == sorted(con.execute(rq.Q_RECEIPT_STREAM_SQL).fetchall(), key=str)


def test_a_state_is_read_and_written_once_a_batch():
    """Five commands of one entry cost one read and one write of its state, and no timer that the last of them ends."""
    calls = []

    class Handle(dict):
        getMapState = lambda self, name, *_: Map(name)
        registerTimer = lambda self, due: calls.append(("timer", due))

    class Map(dict):
        def __init__(self, name):
            self.name = name

        def getValue(self, key):
            calls.append(("get", self.name))
            return self.get(key)

        def updateValue(self, key, value):
            calls.append(("update", self.name))
            self[key] = value

    class Now:
        getCurrentProcessingTimeInMs = lambda self: 5

    command = lambda kind, worker, at: Row(queue_id="q", kind=kind, worker=worker, attempt=None, at=T0 + timedelta(seconds=at), error=None)
    step = rq.Entry(1000, 1000)
    step.init(Handle())
    rows = [command("MINTED", "a", 9), command("MINTED", "b", 9), command("CLAIM", "b", 2), command("CLAIM", "a", 1), command("ENQUEUE", None, 0)]
    assert [e.status for e in step.handleInputRows((1,), iter(rows), Now())] == ["PENDING", "CLAIMED", "REFUSED", "MINTED", "REFUSED"]
    assert calls == [("get", "entry"), ("update", "entry")] and step.state[("q",)] == ("MINTED", "a", 1, None)
    list(step.handleInputRows((1,), iter([command("FAILED", "a", 10)]), Now()))
    assert len(calls) == 3
