"""The budget across sessions and threads, and the distribution of the noise."""

import math
import random
from concurrent.futures import ThreadPoolExecutor
from fractions import Fraction

import pytest

from tallyworks.functions.noise import discrete_laplace
from tallyworks.operators import privacy
from tallyworks.operators.budget import Budget


def test_sessions_cannot_overspend_together(spark, tmp_path):
    where = f"file://{tmp_path}/budget"
    sessions = [Budget(spark, where, 1.0) for _ in range(8)]
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda i: sessions[i % 8].spend(0.1, "dp", i), range(40)))
    assert sorted(n for n in got if n is not None) == list(range(1, 11)) and got.count(None) == 30
    again = Budget(spark, where, 1.0)  # a restart
    assert again.spent == 1.0 and again.spend(0.1, "dp", 0) is None and again.spend(0.0, "dp", 0) == 11
    rows = again.ledger().orderBy("query").collect()
    assert [round(r.spent, 6) for r in rows] == [round(0.1 * min(n, 10), 6) for n in range(1, 12)]
    assert not list((tmp_path / "budget").glob("draft-*"))
    (tmp_path / "budget" / "spent-000000003").unlink()
    with pytest.raises(RuntimeError):
        again.spend(0.0, "dp", 0)
    with pytest.raises(ValueError):
        Budget(spark, f"file://{tmp_path}/other", 1.0).spend(-0.1, "dp", 0)


def test_numbers_are_published_once_by_rename(spark, tmp_path):
    """The way of file systems other than the local one."""
    b = Budget(spark, f"file://{tmp_path}/budget", 1.0)
    b.links = False
    assert b._publish(1, {"spent": 1}) is True and b._publish(1, {"spent": 2}) is False
    assert b.last() == (1, 1) and not list((tmp_path / "budget").glob("draft-*"))


def test_facades_share_a_budget(spark, tmp_path):
    facts = spark.createDataFrame([(i, "x") for i in range(60)], "person int, district string")
    domains = {"district": privacy.Domain(values=frozenset("x"))}
    one, two = (privacy.Facade(facts, "person", domains, ledger=Budget(spark, f"file://{tmp_path}/b", 0.3)) for _ in range(2))
    one.noisy({})
    assert two.floored({"district": "x"}) == 60
    with pytest.raises(privacy.Refused):
        two.noisy({"name": "x"})  # not a question: costs nothing
    one.noisy({})
    for f in (one, two):
        assert f.spent == 0.3
        with pytest.raises(privacy.Refused):
            f.noisy({})
    assert [tuple(r)[1:4] for r in one.shared.ledger().orderBy("query").collect()] == [("dp", 0, 0.1), ("floor", 1, 0.1), ("dp", 0, 0.1)]


@pytest.mark.parametrize("scale", [Fraction(1, 3), Fraction(1), Fraction(6576, 1000)])
def test_noise_has_the_stated_distribution(scale):
    rng, n, q = random.Random(11), 40_000, math.exp(-1 / scale)
    draws = [discrete_laplace(scale, rng) for _ in range(n)]
    p = lambda k: (1 - q) / (1 + q) * q ** abs(k)
    top = next(k for k in range(1000) if n * p(k + 1) < 20)
    cells = {k: draws.count(k) for k in range(-top, top + 1)}
    rest = n - sum(cells.values())
    chi = sum((c - n * p(k)) ** 2 / (n * p(k)) for k, c in cells.items())
    tail = n * (1 - sum(map(p, cells)))
    chi += (rest - tail) ** 2 / max(tail, 1)
    assert chi < len(cells) + 4 * math.sqrt(2 * len(cells)) + 4
    assert abs(sum(draws) / n) < 5 * math.sqrt(2 * q / (1 - q) ** 2 / n)


def test_no_scale_no_noise():
    assert discrete_laplace(Fraction(0)) == 0 and isinstance(discrete_laplace(Fraction(3, 2)), int)
    with pytest.raises(ValueError):
        discrete_laplace(Fraction(-1))
