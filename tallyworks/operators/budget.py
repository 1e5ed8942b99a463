"""A privacy budget that outlives sessions: spending is a chain of numbered files in a shared folder.

To spend is to publish the next number, which carries the sum so far. A number can be published once, so of two sessions
that read the same sum one succeeds and the other reads again: together they cannot overspend. A number appears with its
whole content (a hard link on a local disk, a rename that refuses to overwrite elsewhere; a store without such a rename
cannot hold a budget). Spending comes before the answer: a session that dies in between has lost budget, not privacy.
Costs are whole millionths, so that sums are exact.
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import path_of

MICRO = 1_000_000
ROW = "query int, mechanism string, filters int, epsilon double, spent double, at timestamp"


def micro(x: float) -> int:
    return round(x * MICRO)


class Budget:
    """The budget in a folder; every session that names the same folder spends from it."""

    def __init__(self, spark: SparkSession, folder: str, total: float):
        self.spark, self.total = spark, micro(total)
        self.fs, p = path_of(spark, folder)
        self.fs.mkdirs(p)
        self.folder = self.fs.makeQualified(p)
        self.jvm = spark.sparkContext._jvm
        self.links = self.folder.toUri().getScheme() == "file"

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def _numbers(self) -> list[int]:
        names = (f.getPath().getName() for f in self.fs.listStatus(self.folder))
        return sorted(int(n[6:]) for n in names if n.startswith("spent-"))

    def _read(self, n: int) -> dict:
        stream = self.fs.open(self._path(f"spent-{n:09d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def last(self) -> tuple[int, int]:
        """The newest number (0: none) and the millionths spent until then."""
        numbers = self._numbers()
        if numbers and numbers != list(range(1, len(numbers) + 1)):
            raise RuntimeError("the chain has a gap: nothing can be spent")
        return (numbers[-1], self._read(numbers[-1])["spent"]) if numbers else (0, 0)

    def _publish(self, n: int, record: dict) -> bool:
        """False if another session has published this number."""
        draft, final = self._path(f"draft-{uuid.uuid4().hex}"), self._path(f"spent-{n:09d}")
        out = self.fs.create(draft, False)
        out.write(json.dumps(record).encode())
        out.close()
        if self.links:
            try:
                os.link(draft.toUri().getPath(), final.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                self.fs.delete(draft, False)
        gateway = self.spark.sparkContext._gateway
        options = gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.folder.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, options)
            return True
        except Exception:
            self.fs.delete(draft, False)
            if self.fs.exists(final):
                return False
            raise

    def spend(self, epsilon: float, mechanism: str, filters: int) -> int | None:
        """The number of the spending, or None if the budget does not hold it: then nothing is spent."""
        cost = micro(epsilon)
        if cost < 0:
            raise ValueError("a cost cannot be negative")
        while True:
            n, spent = self.last()
            if spent + cost > self.total:
                return None
            record = {"query": n + 1, "mechanism": mechanism, "filters": filters, "cost": cost, "spent": spent + cost, "at": datetime.now(timezone.utc).isoformat()}
            if self._publish(n + 1, record):
                return n + 1

    @property
    def spent(self) -> float:
        return self.last()[1] / MICRO

    def ledger(self) -> DataFrame:
        """All spendings of all sessions."""
        rows = [self._read(n) for n in self._numbers()]
        return self.spark.createDataFrame([(r["query"], r["mechanism"], r["filters"], r["cost"] / MICRO, r["spent"] / MICRO, datetime.fromisoformat(r["at"])) for r in rows], ROW)
