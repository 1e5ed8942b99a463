"""Pairs of unit vectors at or above a cosine, within blocks that share keys.

Each side of a block is dealt into parts of about ``part`` vectors by a hash of the id, so a block that holds a third of
all rows is as many units of work as its size asks for, and both of its sides are split. A unit is a part of the left
side against a part of the right side, one matrix product. The dimensions are put in order of falling variance first and
the product is taken in two steps: after the first half a pair can still gain at most the product of what is left of its
two lengths (Cauchy-Schwarz), and only rows and columns in which some pair can reach the floor go on.

Vectors of length zero, or null, are similar to nothing and take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 512
SLACK = 1e-9  # rounding of the bound; survivors are compared exactly


def near(a: np.ndarray, b: np.ndarray, floor: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows, columns and cosines of the pairs at or above the floor, and how many pairs were multiplied out."""
    if floor is None:
        full = a @ b.T
        x, y = np.divmod(np.arange(full.size), full.shape[1])
        return x, y, full.ravel(), full.size
    half = a.shape[1] // 2
    first = a[:, :half] @ b[:, :half].T
    rest = lambda v: np.sqrt(np.maximum(0.0, (v[:, half:] ** 2).sum(axis=1)))
    can = first + np.outer(rest(a), rest(b)) >= floor - SLACK
    rows, cols = np.flatnonzero(can.any(axis=1)), np.flatnonzero(can.any(axis=0))
    if not len(rows):
        return rows, rows, np.zeros(0), 0
    full = a[rows] @ b[cols].T
    x, y = np.nonzero(full >= floor)
    return rows[x], cols[y], full[x, y], full.size


def _matrix(items: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, tags, vectors) of a list of structs."""
    unit = items.field("unit")
    return items.field("id").to_numpy(zero_copy_only=False), items.field("tag").fill_null(-1).to_numpy(zero_copy_only=False), unit.flatten().to_numpy(zero_copy_only=False).reshape(len(items), -1)


def _score(batches: Iterator[pa.RecordBatch], order: list[int], floor: float | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            (a_id, tag, a), (b_id, _, b) = (_matrix(batch.column(k)[r].values) for k in (0, 1))
            x, y, cosine, _ = near(a[:, order], b[:, order], floor)
            yield pa.RecordBatch.from_arrays([pa.array(a_id[x]), pa.array(b_id[y]), pa.array(tag[x] == b_id[y]), pa.array(cosine)], names=["left_id", "right_id", "tagged", "cosine"])


def by_variance(vectors: DataFrame, size: int) -> list[int]:
    """The dimensions in order of falling variance over all vectors: ``size`` numbers reach the driver."""
    spread = vectors.agg(*[F.var_pop(F.col("unit")[k]) for k in range(size)]).first()
    return sorted(range(size), key=lambda k: (-(spread[k] or 0.0), k))


def cosine_pairs(left: DataFrame, right: DataFrame, keys: list[str], floor: float | None = None, part: int = PART) -> DataFrame:
    """left_id, right_id, tagged (the left row's tag is the right id), cosine of the pairs that share all keys.

    Both sides have the keys, ``id`` (bigint), ``tag`` (bigint or null) and ``unit`` (array of doubles).
    """
    left, right = (side.where("unit IS NOT NULL") for side in (left, right))
    one = left.select(F.size("unit")).first() or right.select(F.size("unit")).first()
    order = by_variance(left.select("unit").unionByName(right.select("unit")), one[0]) if one and floor is not None else list(range(one[0] if one else 0))

    def parts(side: DataFrame, name: str) -> DataFrame:
        many = side.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(part)).alias("parts"))
        dealt = side.join(many, keys).withColumn("part", F.expr("pmod(xxhash64(id), parts)"))
        return dealt.groupBy(*keys, "part").agg(F.collect_list(F.struct("id", "tag", "unit")).alias(name)).drop("part")  # about ``part`` rows

    units = parts(left, "l").join(parts(right, "r"), keys).select("l", "r")
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(n).mapInArrow(lambda b: _score(b, order, floor), "left_id bigint, right_id bigint, tagged boolean, cosine double")
