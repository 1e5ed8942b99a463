"""Jaro-Winkler similarity, as an Arrow-batched function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    swaps = sum(x != y for x, y in zip(left, (y for j, y in enumerate(b) if used[j]))) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str | None, b: str | None, boost_threshold: float = 0.7) -> float | None:
    """None if either side is. The prefix bonus (0.1 a character, up to four) applies above ``boost_threshold``; with 0.0
    it always applies."""
    if a is None or b is None:
        return None
    s = jaro(a, b)
    if s <= boost_threshold:
        return s
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return s + prefix * 0.1 * (1 - s)


def title(c: Column) -> Column:
    """Every run of letters with a capital first letter, whatever stands before it (``initcap`` knows spaces alone)."""
    runs = F.split(F.lower(c), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


#: Characters of the padded matrices that are worked at a time.
CHUNK = 1 << 20


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row a word, padded with zeros behind its length; and the lengths."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    out = np.zeros((len(words), max(1, lengths.max(initial=0))), dtype=np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return out, lengths


def jaro_winkler_batch(a: list[str], b: list[str], boost_threshold: float = 0.7) -> np.ndarray:
    """``jaro_winkler`` of many pairs at once: a step a position for all pairs of a chunk, not a step a character."""
    (x, nx), (y, ny) = _codes(a), _codes(b)
    rows, reach = np.arange(len(a)), np.maximum(0, np.maximum(nx, ny) // 2 - 1)
    used, found, at = np.zeros(y.shape, dtype=bool), np.zeros(x.shape, dtype=bool), np.arange(y.shape[1])
    widest = int(reach.max(initial=0))
    for i in range(x.shape[1]):
        low, high = max(0, i - widest), min(y.shape[1], i + widest + 1)
        if low >= high:
            break
        j = at[low:high]
        free = ~used[:, low:high] & (y[:, low:high] == x[:, i, None]) & (np.abs(j - i) <= reach[:, None]) & (j < ny[:, None]) & (i < nx)[:, None]
        hit, first = free.any(axis=1), free.argmax(axis=1) + low
        used[rows[hit], first[hit]] = True
        found[hit, i] = True
    m = found.sum(axis=1)
    owner = np.repeat(rows, m)  # the matched characters of both sides, in order, word after word
    swaps = np.bincount(owner, weights=x[found] != y[used], minlength=len(a)) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(m == 0, 0.0, (m / nx + m / ny + (m - swaps) / m) / 3)
    k = min(4, x.shape[1], y.shape[1])
    alike = (x[:, :k] == y[:, :k]) & (np.arange(k) < np.minimum(nx, ny)[:, None])
    same = np.array([p == q for p, q in zip(a, b)], dtype=bool)
    s[same] = 1.0
    prefix = np.cumprod(alike, axis=1).sum(axis=1)
    return np.where(s > boost_threshold, s + prefix * 0.1 * (1 - s), s)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null if either side is. Pairs of like lengths are worked together, so that one long word does not widen all."""
    out = np.full(len(a), np.nan)
    known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    if len(known):
        p, q = a.to_numpy(dtype=object)[known], b.to_numpy(dtype=object)[known]
        length = np.maximum([len(w) for w in p], [len(w) for w in q])
        order = np.argsort(length, kind="stable")
        start = 0
        while start < len(order):
            end = min(len(order), start + 4096)
            while end > start + 1 and (end - start) * int(length[order[end - 1]]) > CHUNK:
                end = start + (end - start) // 2
            part = order[start:end]
            out[known[part]] = jaro_winkler_batch(p[part].tolist(), q[part].tolist())
            start = end
    return pd.Series(out).astype("Float64").mask(np.isnan(out))


def register_jaro_winkler(spark: SparkSession) -> None:
    spark.udf.register("jaro_winkler", jaro_winkler_udf)
