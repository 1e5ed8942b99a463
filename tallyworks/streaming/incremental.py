"""A mart that is kept up to date from new input alone.

What a mart needs of its input is kept as partial aggregates for each (input file, key): sums, and for columns of which
the distinct values, the least or the greatest is wanted, how often each value occurs. Both can be added and taken away,
so a file that came in is added, one that is gone is taken away, and a rewritten one is taken away in its old form and
added in its new one; no other file is read. Reading the mart adds the partials up.

Every change is a run: a folder of partials that counts once its row is in the log of runs, so a run that dies half-way
leaves nothing behind that is read, and a repeated one replaces its own folder. Runs are merged into one by ``compact``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import now
from ..sources import shared

RUNS = "run string, replaces array<string>, at timestamp"
FILES = "file string, version string, live boolean, at timestamp, run string"
MOST_RUNS = 16
FILE = "_file"


@dataclass(frozen=True)
class Measures:
    """``sums`` and ``values`` are name -> SQL over the input's rows; the mart gets n, the sums, and for each of the values
    {name}_distinct, {name}_min and {name}_max."""

    key: tuple[str, ...]
    sums: dict[str, str] = field(default_factory=dict)
    values: dict[str, str] = field(default_factory=dict)


def file_key(path: str) -> str:
    """One spelling for ``file:/x`` and ``file:///x``."""
    return re.sub(r"^([a-z0-9]+):/*", r"\1:/", path)


def with_file(rows: DataFrame) -> DataFrame:
    return rows.withColumn(FILE, F.regexp_replace("_metadata.file_path", r"^([a-z0-9]+):/*", "$1:/"))


class Partials:
    """The partial aggregates of one mart under a folder, written by one driver at a time."""

    def __init__(self, spark: SparkSession, where: str, measures: Measures, clock: Callable[[], datetime] = now):
        self.spark, self.where, self.m, self.clock = spark, where.rstrip("/"), measures, clock

    # -- what is committed

    def _log(self, name: str, schema: str) -> DataFrame:
        fs, p = shared.path_of(self.spark, f"{self.where}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.where}/{name}") if fs.exists(p) else self.spark.createDataFrame([], schema)

    def runs(self) -> list[str]:
        rows = self._log("_runs", RUNS).collect()  # a row a run, MOST_RUNS of them live
        gone = {x for r in rows for x in r["replaces"] or []}
        return sorted({r["run"] for r in rows} - gone)

    def files(self) -> DataFrame:
        """The newest state of each input file."""
        newest = self._log("_files", FILES).groupBy("file").agg(F.max_by(F.struct("version", "live", "at"), F.struct("at", "run")).alias("s"))
        return newest.select("file", "s.*").where("live")

    def refreshed_at(self) -> datetime | None:
        return self._log("_runs", RUNS).agg(F.max("at")).first()[0]

    def _table(self, name: str) -> DataFrame | None:
        runs = self.runs()
        return self.spark.read.parquet(*[f"{self.where}/{name}/{r}" for r in runs]) if runs else None

    # -- runs

    def _write(self, run: str, sums: DataFrame, values: dict[str, DataFrame], replaces: list[str]) -> None:
        sums.write.mode("overwrite").parquet(f"{self.where}/sums/{run}")
        for name, df in values.items():
            df.write.mode("overwrite").parquet(f"{self.where}/values-{name}/{run}")
        self.spark.createDataFrame([(run, replaces, self.clock())], RUNS).coalesce(1).write.mode("append").parquet(f"{self.where}/_runs")

    def apply(self, rows: DataFrame, run: str, without: DataFrame | None = None) -> None:
        """Add the rows of an input (with their FILE); take away the files of ``without``. A run that is committed already
        is left alone."""
        if run in self.runs():
            return
        by = [FILE, *self.m.key]
        sums = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(F.expr(e)).alias(k) for k, e in self.m.sums.items()])
        values = {k: rows.select(*by, F.expr(e).alias("value")).where("value IS NOT NULL").groupBy(*by, "value").agg(F.count("*").alias("n")) for k, e in self.m.values.items()}
        if without is not None and (old := self._table("sums")) is not None:
            minus = lambda df, cols: df.join(without.select(F.col("file").alias(FILE)), FILE, "left_semi").withColumns({c: -F.col(c) for c in cols})
            sums = sums.unionByName(minus(old, ["n", *self.m.sums]))
            values = {k: v.unionByName(minus(self._table(f"values-{k}"), ["n"])) for k, v in values.items()}
        self._write(run, sums, values, [])
        if len(self.runs()) > MOST_RUNS:
            self.compact()

    def compact(self) -> None:
        """All runs as one; what was taken away is gone from it."""
        runs, by = self.runs(), [FILE, *self.m.key]
        sums = self._table("sums").groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", *self.m.sums)]).where("n <> 0")
        values = {k: self._table(f"values-{k}").groupBy(*by, "value").agg(F.sum("n").alias("n")).where("n <> 0") for k in self.m.values}
        self._write(f"c-{uuid.uuid4().hex}", sums, values, runs)

    def refresh(self, folder: str, load: Callable[[list[str]], DataFrame]) -> dict[str, int]:
        """Bring the partials up to the files below a folder. ``load`` reads some files, with their FILE; it gets only those
        that are new or were rewritten. Returns how many files were added, rewritten, removed and left alone."""
        uri = lambda p: shared.path_of(self.spark, p)[1].toUri().toString()  # blanks and the like as Spark spells them
        listed = [(file_key(uri(p)), f"{size}-{at}", p) for p, size, at in shared.stamp(self.spark, folder) if re.fullmatch(r"[^_.].*", p.rsplit("/", 1)[-1])]
        seen = self.spark.createDataFrame([(k, v, p) for k, v, p in listed], "file string, new string, path string")
        both = self.files().select("file", "version").join(seen, "file", "full").where("version IS DISTINCT FROM new").collect()  # a row a changed file
        added, stale = [r for r in both if r["new"] is not None], [r for r in both if r["version"] is not None]
        count = {"added": len(both) - len(stale), "rewritten": len(added) + len(stale) - len(both), "removed": len(both) - len(added)}
        count["unchanged"] = len(listed) - len(added)
        if both:
            run = f"r-{uuid.uuid4().hex}"
            without = self.spark.createDataFrame([(r["file"],) for r in stale], "file string") if stale else None
            rows = load([r["path"] for r in added]) if added else load([listed[0][2]] if listed else []).where("false")
            self.apply(rows, run, without)
            log = [(r["file"], r["new"] or r["version"], r["new"] is not None, self.clock(), run) for r in both]
            self.spark.createDataFrame(log, FILES).coalesce(1).write.mode("append").parquet(f"{self.where}/_files")
        return count

    def follow(self, stream: DataFrame, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda x: x, seconds: int = 60, once: bool = False) -> StreamingQuery:
        """Add the batches of a stream of new files. A batch that is repeated after a failure counts once."""
        w = stream.writeStream.foreachBatch(lambda batch, n: self.apply(prepare(batch), f"b-{n:012d}")).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{seconds} seconds")).start()

    # -- the mart

    def read(self) -> DataFrame:
        """key, n, the sums, and {name}_distinct, {name}_min, {name}_max of the values. Without any run there is no table."""
        if (sums := self._table("sums")) is None:
            raise LookupError(f"nothing was refreshed under {self.where}")
        out = sums.groupBy(*self.m.key).agg(*[F.sum(c).alias(c) for c in ("n", *self.m.sums)]).where("n > 0")
        for k in self.m.values:
            held = self._table(f"values-{k}").groupBy(*self.m.key, "value").agg(F.sum("n").alias("n")).where("n > 0")
            held = held.groupBy(*self.m.key).agg(F.count("*").alias(f"{k}_distinct"), F.min("value").alias(f"{k}_min"), F.max("value").alias(f"{k}_max"))
            out = out.join(held, list(self.m.key), "left")
        return out


_MONEY = {"pledged": None, "moved": ("DISPATCHED", "DELIVERED", "UNACCOUNTED"), "delivered": ("DELIVERED",), "unaccounted": ("UNACCOUNTED",)}
ACTIVITY = Measures(
    ("org_id",),
    {k: "pledged_usd" if v is None else f"CASE WHEN status IN ({', '.join(map(repr, v))}) THEN amount_usd ELSE cast(0 AS decimal(12,2)) END" for k, v in _MONEY.items()},
    {"district": "district", "day": "dispatched_at"},
)


def activity(spark: SparkSession, sf_dir: str, where: str, clock: Callable[[], datetime] = now) -> tuple[DataFrame, dict[str, int]]:
    """The organisations' activity, refreshed from the changed files of ``orders`` only, and what was done."""
    from ..plans import marts
    from ..plans.dialect import Spark

    def load(files: list[str]) -> DataFrame:
        rows = with_file(spark.read.parquet(*(files or [f"{sf_dir}/orders.parquet"])))
        return spark.sql(marts.disbursements(Spark, extra=FILE), orders=rows)

    partials = Partials(spark, where, ACTIVITY, clock)
    done = partials.refresh(f"{sf_dir}/orders.parquet", load)
    x, usd = partials.read(), lambda c: F.col(c).cast("double")
    share = lambda c: usd(c) / F.nullif(usd("moved"), F.lit(0.0))
    return x.select(
        "org_id", F.col("n").alias("disbursements"), F.col("district_distinct").alias("districts"), usd("pledged").alias("pledged_usd"), usd("moved").alias("moved_usd"), usd("delivered").alias("delivered_usd"),
        usd("unaccounted").alias("unaccounted_usd"), F.round(share("unaccounted"), 6).alias("unaccounted_ratio"), F.round(share("delivered"), 6).alias("delivery_rate"), F.col("day_min").alias("first_at"), F.col("day_max").alias("last_at"),
    ), done


def q_activity_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table through the partials; a second call in a session reads changed files only."""
    import hashlib

    name = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    return activity(spark, sf_dir, f"{shared.root(spark)}/activity-{spark.sparkContext.applicationId}-{name}")[0]


Q_ACTIVITY_SQL = """SELECT o_custkey AS org_id, count(*) AS disbursements, count(DISTINCT (o_custkey * 13 + CASE WHEN o_orderkey % 20 = 0 THEN 11 ELSE 0 END) % 25) AS districts, sum(p)::DOUBLE AS pledged_usd, sum(p) FILTER (WHERE s <> 'PLEDGED')::DOUBLE AS moved_,
    coalesce(sum(p) FILTER (WHERE s = 'DELIVERED'), 0)::DOUBLE AS delivered_usd, coalesce(sum(p) FILTER (WHERE s = 'UNACCOUNTED'), 0)::DOUBLE AS unaccounted_usd, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at
    FROM (SELECT *, o_totalprice::DECIMAL(12,2) AS p, CASE WHEN o_orderpriority = '1-URGENT' THEN 'UNACCOUNTED' WHEN o_orderstatus = 'P' THEN 'PLEDGED' WHEN o_orderstatus = 'O' THEN 'DISPATCHED' ELSE 'DELIVERED' END AS s FROM orders) o GROUP BY 1"""
Q_ACTIVITY_SQL = f"SELECT * EXCLUDE (moved_), coalesce(moved_, 0) AS moved_usd, round(unaccounted_usd / nullif(coalesce(moved_, 0), 0), 6) AS unaccounted_ratio, round(delivered_usd / nullif(coalesce(moved_, 0), 0), 6) AS delivery_rate FROM ({Q_ACTIVITY_SQL}) a"
