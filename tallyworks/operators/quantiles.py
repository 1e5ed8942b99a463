"""Exact quantiles by refining histograms.

``percentile`` keeps every distinct value of a column in one task. Here each pass counts the values in BINS equal bins of
the range that still matters, with the least and greatest value of each bin, so a pass returns BINS rows at most, whatever
the table. The bin that holds a wanted rank is the next pass's range; a rank is found once its bin has one value. A pass
narrows the range by the number of bins, and all ranks are followed in the same pass.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096


def _bin(x, low: float, high: float, bins: int):
    # half of both sides first: the range of all doubles is no double
    part = (x / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
    return F.least(F.lit(bins - 1), F.floor(part * bins).cast("int"))


def order_statistics(df: DataFrame, column: str, ranks: list[int], bins: int = BINS) -> list[float]:
    """The values of the given ranks (from 0) among a column's values; nulls and NaN are left out."""
    x = F.expr(column).cast("double")
    rows = df.select(x.alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    low, high = rows.agg(F.min("x"), F.max("x")).first()
    found: dict[int, float] = {}
    todo = {r: (low, high, r) for r in ranks}  # rank -> (range, rank within it)
    while todo:
        for r, (a, b, _) in list(todo.items()):
            if a == b:
                found[r] = a
                del todo[r]
        ranges = sorted({(a, b) for a, b, _ in todo.values()})
        if not ranges:
            break
        inside = F.lit(None).cast("struct<k:int,bin:int>")
        for k, (a, b) in enumerate(ranges):
            inside = F.when(F.col("x").between(a, b), F.struct(F.lit(k).alias("k"), _bin(F.col("x"), a, b, bins).alias("bin"))).otherwise(inside)
        counted = rows.select("x", inside.alias("at")).where("at IS NOT NULL").groupBy("at").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
        hist: dict[int, list] = {}
        for r in sorted(counted.collect(), key=lambda r: (r["at"]["k"], r["at"]["bin"])):  # at most bins rows a range
            hist.setdefault(r["at"]["k"], []).append((r["n"], r["a"], r["b"]))
        for r, (a, b, rank) in list(todo.items()):
            for n, lo, hi in hist[ranges.index((a, b))]:
                if rank < n:
                    if (lo, hi) == (a, b):  # neighbouring doubles that no bin parts
                        lo, hi, rank = _split(rows, a, b, rank)
                    todo[r] = (lo, hi, rank)
                    break
                rank -= n
    return [found[r] for r in ranks]


def _split(rows: DataFrame, a: float, b: float, rank: int) -> tuple[float, float, int]:
    """The half of a range that holds a rank; the halves meet between ``a`` and the next value above it."""
    least = rows.where(F.col("x") == a).count()
    if rank < least:
        return a, a, rank
    low, high = rows.where((F.col("x") > a) & (F.col("x") <= b)).agg(F.min("x"), F.max("x")).first()
    return low, high, rank - least


def exact_quantiles(df: DataFrame, column: str, ps: list[float], bins: int = BINS) -> list[float | None]:
    """Quantiles with linear interpolation between neighbours, as ``percentile`` defines them; None without any value."""
    n = df.select(F.expr(column).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)").count()
    if not n:
        return [None] * len(ps)
    at = [p * (n - 1) for p in ps]
    ranks = sorted({r for x in at for r in (math.floor(x), math.ceil(x))})
    value = dict(zip(ranks, order_statistics(df, column, ranks, bins)))
    return [value[math.floor(x)] + (value[math.ceil(x)] - value[math.floor(x)]) * (x - math.floor(x)) if math.floor(x) != math.ceil(x) else value[math.floor(x)] for x in at]
