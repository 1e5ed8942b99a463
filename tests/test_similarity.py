"""Pairs above a cosine against all pairs, hot blocks, and vectors of zeros."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.operators import similarity
from tallyworks.plans import compile as plans
from tallyworks.plans.dialect import Spark
from tallyworks.plans.marts import PRODUCTION_CUT
from tallyworks.plans.named import texts

SCHEMA = "region int, cause string, id bigint, tag bigint, unit array<double>"


def side(rng, n, first, hot=0.8):
    v = rng.normal(size=(n, 8)) * np.array([4, 3, 2, 1, 1, 0.5, 0.2, 0.1])
    v /= np.linalg.norm(v, axis=1)[:, None]
    return [(0 if rng.random() < hot else int(rng.integers(1, 4)), "c", first + i, first + n + i if i % 3 else None, x.tolist()) for i, x in enumerate(v)]


@pytest.mark.parametrize("floor", [None, -1.0, 0.3, 0.9])
@pytest.mark.parametrize("part", [7, 512])
def test_pairs_are_all_pairs(spark, floor, part):
    rng = np.random.default_rng(1)
    left, right = side(rng, 60, 0), side(rng, 80, 60)
    want = {(a[2], b[2]): (a[3] == b[2], float(np.dot(a[4], b[4]))) for a in left for b in right if a[:2] == b[:2]}
    want = {k: v for k, v in want.items() if floor is None or v[1] >= floor}
    got = similarity.cosine_pairs(spark.createDataFrame(left + [(0, "c", 999, None, None)], SCHEMA), spark.createDataFrame(right, SCHEMA), ["region", "cause"], floor, part).collect()
    assert len(got) == len(want) and {(r.left_id, r.right_id): (r.tagged, pytest.approx(r.cosine)) for r in got} == want


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(side(np.random.default_rng(2), 5, 0), SCHEMA)
    assert similarity.cosine_pairs(none, some, ["region", "cause"], 0.5).count() == 0 == similarity.cosine_pairs(none, none, ["region", "cause"]).count()


def test_the_bound_spares_work_and_loses_nothing():
    rng = np.random.default_rng(4)
    a, b = (np.array([x[4] for x in side(rng, 300, 0)]) for _ in range(2))
    x, y, cosine, done = similarity.near(a, b, 0.995)
    assert {*zip(x.tolist(), y.tolist())} == {*zip(*(v.tolist() for v in np.nonzero(a @ b.T >= 0.995)))}
    assert similarity.near(a[:5], -a[:5] * 1.0, 0.999)[3] <= done <= a.shape[0] * b.shape[0]


def test_a_vector_of_zeros_is_similar_to_nothing(spark, tmp_path):
    """One such row no longer stops the pairs and what is built on them."""
    import glob
    import os

    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        os.symlink(f, f"{tmp_path}/{os.path.basename(f)}")
    os.remove(f"{tmp_path}/embeddings.parquet")
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    e.withColumn("embedding", F.when(F.col("vec_id") == 10, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert plans.run(spark, str(tmp_path), "q_threshold_curve").count() > 0
    assert plans.run(spark, str(tmp_path), "q_nearest_threshold").where("suspect_id = 10 OR target_id = 10").count() == 0
    assert plans.run(spark, str(tmp_path), "q_org_risk_one", org=10).count() == 1


def test_order_is_by_the_unrounded_similarity(spark, tmp_path):
    """Pairs that are the cut when rounded to six decimals come in the order of their distances before rounding."""
    wide = [7e-8, 3e-7, 1e-8]
    pairs = [(10 * k, 10 * k + 1, PRODUCTION_CUT + gap) for k, gap in enumerate(wide, 1)]
    rows = spark.createDataFrame(pairs, "suspect_id bigint, target_id bigint, semantic_sim double")
    got = spark.sql(texts(Spark)["q_nearest_threshold"], scored_pairs=rows).collect()
    assert [r.suspect_id for r in got] == [30, 10, 20]
    parts = ("semantic", "evasion", "geometry", "unaccounted", "receipts")
    edits = spark.createDataFrame([(k, 50 + gap, *[0.0] * 5) for k, gap in enumerate(wide, 1)], "org_id bigint, risk_score double, " + ", ".join(f"comp_{x} double" for x in parts))
    assert [r.org_id for r in spark.sql(texts(Spark)["q_edited_rows"], org_risk_now=edits).collect()] == [2, 1, 3]
