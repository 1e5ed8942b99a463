"""Partials equal a rebuild after inserts, rewrites and removals, and read changed files only."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tallyworks.streaming import incremental as inc

SF = "/root/testdata/sf0.001"


def rebuilt(spark, folder):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view orders as select * exclude (part) from (select *, 1 as part from read_parquet('{folder}/orders.parquet/*.parquet'))")
    q = con.execute(inc.Q_ACTIVITY_SQL)
    names = [x[0] for x in q.description]
    return {r[names.index("org_id")]: dict(zip(names, r)) for r in q.fetchall()}


def same(got, want):
    rows = {r.org_id: r.asDict() for r in got.collect()}
    assert rows.keys() == want.keys()
    for k, v in want.items():
        assert rows[k] == {c: pytest.approx(x) if isinstance(x, float) else x for c, x in v.items()}


def test_refresh_reads_changed_files_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inc, "MOST_RUNS", 3)
    folder, where = f"{tmp_path}/in", f"file://{tmp_path}/partials"
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.repartition(4, "o_orderkey").write.parquet(f"{folder}/orders.parquet")
    names = sorted(x for x in os.listdir(f"{folder}/orders.parquet") if x.startswith("part-"))
    read = []
    real = inc.with_file
    monkeypatch.setattr(inc, "with_file", lambda rows: read.append(len(rows.inputFiles())) or real(rows))
    step = lambda: inc.activity(spark, folder, where)
    got, done = step()
    assert done == {"added": 4, "rewritten": 0, "removed": 0, "unchanged": 0} and read == [4]
    same(got, rebuilt(spark, folder))
    got, done = step()  # nothing changed: nothing is read
    assert done == {"added": 0, "rewritten": 0, "removed": 0, "unchanged": 4} and read == [4]
    same(got, rebuilt(spark, folder))

    def put(df, name):
        df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/one")
        part = next(x for x in os.listdir(f"{tmp_path}/one") if x.startswith("part-") and x.endswith(".parquet"))
        shutil.copy(f"{tmp_path}/one/{part}", f"{folder}/orders.parquet/{name}")
        if os.path.exists(check := f"{folder}/orders.parquet/.{name}.crc"):
            os.remove(check)

    put(orders.where("o_orderkey % 3 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000), "part-new one.parquet")  # inserts
    old = spark.read.parquet(f"{folder}/orders.parquet/{names[0]}")
    put(old.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), names[0])  # updates and deletes
    os.remove(f"{folder}/orders.parquet/{names[1]}")  # a removed file
    got, done = step()
    assert done == {"added": 1, "rewritten": 1, "removed": 1, "unchanged": 2} and read == [4, 2]
    same(got, rebuilt(spark, folder))
    for k in range(4):  # runs are merged, and an emptied key leaves the mart
        put(orders.where("o_custkey = 7"), f"part-again-{k}.parquet")
        got, done = step()
    os.remove(f"{folder}/orders.parquet/part-new one.parquet")
    got, done = step()
    assert done["removed"] == 1
    same(got, rebuilt(spark, folder))
    partials = inc.Partials(spark, where, inc.ACTIVITY)
    assert len(partials.runs()) <= 4 and partials.refreshed_at() is not None


def test_a_repeated_batch_counts_once(spark, tmp_path):
    m = inc.Measures(("k",), {"total": "v"}, {"v": "v"})
    p = inc.Partials(spark, f"file://{tmp_path}/p", m)
    with pytest.raises(LookupError):
        p.read()
    src = f"{tmp_path}/src"
    spark.createDataFrame([(1, 5), (1, 7), (2, None), (None, 3)], "k int, v bigint").coalesce(1).write.parquet(src)
    stream = lambda: inc.with_file(spark.readStream.schema("k int, v bigint").parquet(src))
    p.follow(stream(), f"{tmp_path}/check", once=True).awaitTermination()
    want = {(1, 2, 12, 2, 5, 7), (2, 1, None, None, None, None)}
    assert {tuple(r) for r in p.read().where("k IS NOT NULL").collect()} == want
    p.apply(inc.with_file(spark.read.parquet(src)), "b-000000000000")  # the batch again, after a failure
    assert {tuple(r) for r in p.read().where("k IS NOT NULL").collect()} == want
    spark.createDataFrame([(1, 1)], "k int, v bigint").coalesce(1).write.mode("append").parquet(src)
    p.follow(stream(), f"{tmp_path}/check", once=True).awaitTermination()
    assert {tuple(r) for r in p.read().where("k = 1").collect()} == {(1, 3, 13, 3, 1, 7)}
