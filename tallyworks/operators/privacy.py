"""Privacy: minimum cohorts, a differentially private count, and a ledger. Rows never leave the façade.

Anyone who holds the SparkSession can read the tables; the façade protects those who are given only the façade.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.noise import discrete_laplace
from .budget import MICRO, Budget, micro

class Refused(Exception):
    """The question has a shape that the policy does not answer."""


def min_cohort(df: DataFrame, entity: str, keys: list[str], measures: dict[str, Column], k: int = 50) -> DataFrame:
    """Aggregates by ``keys``; below ``k`` distinct entities every measure is NULL and ``refused`` is true."""
    g = df.groupBy(*keys).agg(F.countDistinct(entity).alias("people"), *[c.alias(n) for n, c in measures.items()])
    ok = F.col("people") >= k
    return g.select(*keys, *[F.when(ok, F.col(n)).alias(n) for n in ("people", *measures)], (~ok).alias("refused"))


@dataclass
class Domain:
    """Allowed literals of a column: a range (open on a side without a bound) or a finite set."""

    low: float | None = None
    high: float | None = None
    values: frozenset = frozenset()

    def allows(self, x) -> bool:
        if self.values:
            return x in self.values
        return (self.low is None or x >= self.low) and (self.high is None or x <= self.high)


ANY = (None, "", "any")


def _used(filters: dict) -> int:
    return len([v for v in filters.values() if v not in ANY])


@dataclass
class Question:
    """What an analyst may send: one aggregate over filtered rows, perhaps by groups."""

    aggregate: str = "count_distinct"
    column: str = ""
    filters: dict = field(default_factory=dict)
    group_by: tuple[str, ...] = ()


class Facade:
    """Answers count-distinct questions about ``entity`` with filters over declared domains. The facts stay inside: only
    counts leave."""

    def __init__(self, facts: DataFrame, entity: str, domains: dict[str, Domain], floor: int = 50, epsilon: float = 0.1, budget: float = 300.0, noise_sd: float = 9.3, seed: int | None = None, ledger: Budget | None = None):
        """``ledger``: a budget that all sessions share; without one it lasts as long as this object. ``seed`` is for
        tests; without it noise comes from the operating system."""
        self.entity, self.domains, self.floor, self.epsilon, self.budget, self.noise_sd, self.seed = entity, domains, floor, epsilon, budget, noise_sd, seed
        self.shared, self._spent, self.log = ledger, 0, []
        self.scale = Fraction(noise_sd / math.sqrt(2)).limit_denominator(1000)
        self._frame = lambda rows, schema: facts.sparkSession.createDataFrame(rows, schema)
        self._count = lambda where: facts.where(where).agg(F.countDistinct(entity)).first()[0]

    def _where(self, filters: dict) -> Column:
        """The optional filters as one condition; a column without a domain, or a literal outside it, is refused."""
        out = F.lit(True)
        for c, v in filters.items():
            if c not in self.domains:
                raise Refused(f"no domain for {c}")
            if v in ANY:
                continue
            low, high = v if isinstance(v, tuple) else (v, v)
            if not (self.domains[c].allows(low) and self.domains[c].allows(high)):
                raise Refused(f"{v!r} is outside the domain of {c}")
            out &= F.col(c).between(low, high) if isinstance(v, tuple) else F.col(c) == F.lit(v)
        return out

    def validate(self, q: Question) -> None:
        """Only COUNT(DISTINCT entity) has bounded sensitivity: rows, COUNT(*), sums and groups without a domain have not."""
        if q.aggregate != "count_distinct" or q.column != self.entity:
            raise Refused(f"only count_distinct({self.entity}) is answered")
        for c in q.group_by:
            if not (c in self.domains and self.domains[c].values):
                raise Refused(f"groups by {c} are not bounded")
        self._where(q.filters)

    def rows(self, *_):
        raise Refused("rows are never released")

    @property
    def spent(self) -> float:
        return self.shared.spent if self.shared else self._spent / MICRO

    def _pay(self, mechanism: str, filters: dict) -> None:
        """Before the answer is made: what is paid for is never given back."""
        if self.shared:
            paid = self.shared.spend(self.epsilon, mechanism, _used(filters)) is not None
        elif paid := self._spent + micro(self.epsilon) <= micro(self.budget):
            self._spent += micro(self.epsilon)
        if not paid:
            raise Refused("the budget is spent")

    def _true(self, filters: dict) -> int:
        return self._count(self._where(filters))

    def _note(self, mechanism: str, filters: dict, answer, cost: float) -> None:
        self.log.append({"query": len(self.log) + 1, "mechanism": mechanism, "filters": _used(filters), "refused": answer is None, "epsilon": cost})

    def floored(self, filters: dict) -> int | None:
        """The exact count, or None (withheld, which is not zero) under the floor."""
        self._where(filters)
        self._pay("floor", filters)
        n = self._true(filters)
        out = n if n >= self.floor else None
        self._note("floor", filters, out, self.epsilon)
        return out

    def noisy(self, filters: dict) -> int:
        """The count and a whole-number Laplace draw, never negative; spends epsilon and is refused beyond the budget."""
        self._where(filters)
        self._pay("dp", filters)
        return self._draw(filters, self._true(filters))

    def _draw(self, filters: dict, exact: int) -> int:
        rng = None if self.seed is None else random.Random(self.seed * 1_000_003 + len(self.log))
        out = max(0, exact + discrete_laplace(self.scale, rng))
        self._note("dp", filters, out, self.epsilon)
        return out

    def ask(self, q: Question) -> dict[tuple, int]:
        """A validated question through the noisy mechanism: one draw for each group of the declared domains."""
        self.validate(q)
        groups = [()]
        for c in q.group_by:
            groups = [(*g, v) for g in groups for v in sorted(self.domains[c].values)]
        return {g: self.noisy(q.filters | dict(zip(q.group_by, g))) for g in groups}

    def compare(self, filters: dict) -> DataFrame:
        """The three regimes side by side."""
        exact = self._true(filters)
        self._note("true", filters, exact, 0.0)
        rows = [("true", exact, False), ("floor", f := self.floored(filters), f is None), ("dp", self.noisy(filters), False)]
        return self._frame(rows, "mechanism string, people bigint, refused boolean")

    def attack_trial(self, filters: dict, column: str, threshold: float, trials: int = 8) -> DataFrame:
        """The differencing attack, repeated: everyone, those at or above a threshold, and the difference of two draws."""
        sides = {k: v for k, v in filters.items() if k != column}, filters | {column: (threshold, self.domains[column].high)}
        exact, rows = [self._true(x) for x in sides], []  # counted once; every draw is paid for
        for n in range(trials):
            drawn = []
            for x, true in zip(sides, exact):
                self._pay("dp", x)
                drawn.append(self._draw(x, true))
            rows.append((n + 1, *drawn, drawn[0] - drawn[1]))
        return self._frame(rows, "trial int, everyone bigint, received_something bigint, recovered bigint")

    def ledger(self) -> DataFrame:
        return self._frame([tuple(x.values()) for x in self.log], "query int, mechanism string, filters int, refused boolean, epsilon double")


class Analyst:
    """A session with an analyst's rights: two mechanisms and the ledger, until it is closed."""

    def __init__(self, facade: Facade):
        self._facade: Facade | None = facade

    def _open(self) -> Facade:
        if self._facade is None:
            raise Refused("the session is closed")
        return self._facade

    def floored(self, filters: dict) -> int | None:
        return self._open().floored(filters)

    def noisy(self, filters: dict) -> int:
        return self._open().noisy(filters)

    def ask(self, q: Question) -> dict[tuple, int]:
        return self._open().ask(q)

    def rows(self, *_):
        self._open().rows()

    def close(self) -> None:
        self._facade = None


@contextmanager
def analyst(facade: Facade) -> Iterator[Analyst]:
    """The session ends with the block, however the block ends."""
    session = Analyst(facade)
    try:
        yield session
    finally:
        session.close()


def attack_cost(pair_sd: float = 18.2, epsilon: float = 0.1, budget: float = 300.0) -> dict[str, float]:
    """Queries that recover a leaked group by averaging paired draws, against the budget."""
    trials = round(pair_sd**2)
    return {"trials": trials, "queries": 2 * trials, "epsilon": 2 * trials * epsilon, "allowed": round(budget / epsilon)}
