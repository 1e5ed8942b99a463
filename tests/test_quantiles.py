"""Exact quantiles against sorting, and the cohort lattice against one query for each choice of filters."""

import numpy as np
import pytest

from tallyworks.operators import quantiles as q
from tallyworks.plans import compile as plans

SF = "/root/testdata/sf0.001"
GROUPS = {
    "ties": [3.0] * 50 + [1.0, 2.0, 9.0] * 7,
    "wide": [10.0**k for k in range(-300, 300, 7)] + [-(10.0**k) for k in range(-300, 308, 11)],
    "near": [1.0, float(np.nextafter(1.0, 2)), float(np.nextafter(np.nextafter(1.0, 2), 2)), 1.5, 1e300],
    "random": np.random.default_rng(3).normal(size=400).tolist(),
    "one": [5.0],
}


@pytest.mark.parametrize("name", GROUPS)
@pytest.mark.parametrize("bins", [4, 4096])
def test_quantiles_are_those_of_sorting(spark, name, bins):
    if bins == 4 and name == "wide":
        pytest.skip("some hundred passes of four bins")
    values = GROUPS[name]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(3)
    ps = [0.0, 0.25, 0.5, 0.99, 1.0]
    assert q.exact_quantiles(df, "v", ps, bins) == pytest.approx(np.quantile(np.array(values), ps).tolist(), rel=1e-12)


def test_no_value(spark):
    assert q.exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]


def test_cohorts_keep_the_partitioning_of_people(spark):
    """After a person's facts are together no exchange moves rows by person: the one that is left is by cell."""
    plan = plans.run(spark, SF, "q_cohort_landscape")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert sum("choice" in m for m in moves) == 1 and not any("beneficiary_id" in m and "choice" in m for m in moves)
