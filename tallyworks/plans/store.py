"""Written marts: versions of each mart as Parquet, a build log, and a catalog over both.

A version is a folder of its own; it counts once its row is in the log, so a build that dies half-way leaves the old
version in place. Readers take the newest version, or the newest at a moment.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared

CHANGES = "org_id bigint, changed_at timestamp_ntz, seq bigint, score double"
LOG = "object_name string, layer string, action string, version string, path string, row_count bigint, built_at timestamp"
TARGET_LAG, TOLERATED_LAG = 60, 120  # seconds
RETENTION_DAYS = 90


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Store:
    """Marts under one folder, written by one driver at a time. ``clock`` is replaceable for tests."""

    def __init__(self, spark: SparkSession, where: str, clock=now, changes: str | None = None):
        self.spark, self.where, self.clock = spark, where.rstrip("/"), clock
        self.change_log = changes or f"{self.where}/_changes"
        self.last: DataFrame | None = None  # the previous result
        self._newest: dict[str, str] | None = None

    # -- the log

    def log(self) -> DataFrame:
        fs, p = shared.path_of(self.spark, f"{self.where}/_log")
        return self.spark.read.schema(LOG).parquet(f"{self.where}/_log") if fs.exists(p) else self.spark.createDataFrame([], LOG)

    def _note(self, name: str, layer: str, action: str, path: str, rows: int) -> None:
        row = (name, layer, action, uuid.uuid4().hex, path, rows, self.clock())
        newest = self._paths()
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{self.where}/_log")
        self._newest = newest | {name: path}

    def _paths(self, at: datetime | None = None) -> dict[str, str]:
        if at is None and self._newest is not None:
            return self._newest
        log = self.log() if at is None else self.log().where(F.col("built_at") <= F.lit(at))
        newest = log.groupBy("object_name").agg(F.max_by("path", F.struct("built_at", "version")).alias("path"))
        out = {r["object_name"]: r["path"] for r in newest.collect()}  # a row a mart
        if at is None:
            self._newest = out
        return out

    # -- changes of scores

    def changes(self) -> DataFrame | None:
        """The changes applied so far, or None before the first one."""
        fs, p = shared.path_of(self.spark, self.change_log)
        return self.spark.read.schema(CHANGES).parquet(self.change_log) if fs.exists(p) else None

    def append_change(self, org: int, score: float, at: datetime | None = None) -> None:
        """One row; of changes at one moment the one that was appended last counts."""
        row = (org, at or self.clock(), time.time_ns(), score)
        self.spark.createDataFrame([row], CHANGES).coalesce(1).write.mode("append").parquet(self.change_log)

    def with_own_changes(self) -> Store:
        """The same tables beside an empty change log."""
        out = Store(self.spark, self.where, self.clock, f"{self.where}/_tries/{uuid.uuid4().hex}")
        out._newest = self._newest
        return out

    # -- tables

    def has(self, name: str) -> bool:
        return name in self._paths()

    def read(self, name: str, at: datetime | None = None) -> DataFrame:
        paths = self._paths(at)
        if name not in paths:
            raise LookupError(f"{name} has no version" + (f" at {at}" if at else ""))
        self.last = self.spark.read.parquet(paths[name])
        return self.last

    def write(self, name: str, df: DataFrame, layer: str = "MARTS") -> DataFrame:
        """A new version from a query."""
        path = f"{self.where}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._note(name, layer, "create", path, self.spark.read.parquet(path).count())
        return self.read(name)

    def append(self, name: str, df: DataFrame, layer: str = "MARTS") -> DataFrame:
        """The rows of the newest version and those of a query, by column name."""
        old = self.read(name)
        return self.write(name, old.unionByName(df.select(*old.columns)), layer)

    def truncate(self, name: str) -> DataFrame:
        return self.write(name, self.read(name).limit(0))

    def copy(self, other: Store) -> list[str]:
        """All marts as they are now, into another store."""
        names = sorted(self._paths())
        for n in names:
            other.write(n, self.read(n))
        return names

    def expire(self) -> int:
        """Delete versions beyond the retention that are not the newest; their rows stay in the log."""
        keep, limit, gone = set(self._paths().values()), self.clock() - timedelta(days=RETENTION_DAYS), 0
        for r in self.log().where(F.col("built_at") < F.lit(limit)).select("path").distinct().collect():
            if r["path"] not in keep:
                fs, p = shared.path_of(self.spark, r["path"])
                gone += bool(fs.delete(p, True))
        return gone

    # -- views over the log

    def catalog(self) -> DataFrame:
        """One row a layer: its objects, how many of them are kept fresh, and their rows."""
        newest = self.log().groupBy("object_name").agg(F.max_by(F.struct("layer", "row_count"), F.struct("built_at", "version")).alias("r"))
        return newest.groupBy(F.col("r.layer").alias("schema_name")).agg(F.count("*").alias("objects"), F.sum("r.row_count").alias("total_rows")).orderBy("schema_name")

    def health(self) -> DataFrame:
        """Seconds since each mart was built, against its target."""
        age = F.expr(f"timestampdiff(SECOND, refresh_end_time, timestamp'{self.clock():%Y-%m-%d %H:%M:%S}')")
        last = self.log().groupBy("layer", "object_name").agg(F.max("built_at").alias("refresh_end_time"))
        out = last.select(F.concat_ws(".", "layer", F.upper("object_name")).alias("object_name"), F.col("object_name").alias("short_name"), F.lit("ACTIVE").alias("state"), "refresh_end_time", age.alias("seconds_since_refresh"), F.lit(TARGET_LAG).alias("target_lag_seconds"))
        return out.withColumn("within_lag", F.col("seconds_since_refresh") <= TOLERATED_LAG).orderBy(F.desc("seconds_since_refresh"), "object_name").limit(20)


_stores: dict[tuple[str, str], Store] = {}


def session_store(spark: SparkSession, sf_dir: str) -> Store:
    """The store of a session's queries over one input; another one as soon as a file of the input changes."""
    inputs = hashlib.sha256(repr((sf_dir, shared.stamp(spark, sf_dir))).encode()).hexdigest()[:16]
    key = (spark.sparkContext.applicationId, inputs)
    if key not in _stores:
        changes = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]  # they outlive the versions of the input
        _stores[key] = Store(spark, f"{shared.root(spark)}/marts-{key[0]}-{inputs}", changes=f"{shared.root(spark)}/changes-{key[0]}-{changes}")
    return _stores[key]
