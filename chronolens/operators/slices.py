"""Products of a large table with a small one of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slices_of(small: DataFrame, most: int) -> list[DataFrame]:
    """``small`` itself if it has ``most`` rows or fewer, else parts of about half as many, by a hash of all columns."""
    n = small.count()
    if n <= most:
        return [small]
    parts = -(-2 * n // most)
    return [small.where(F.pmod(F.xxhash64(*small.columns), F.lit(parts)) == k) for k in range(parts)]


def times(big: DataFrame, small: DataFrame, most: int) -> DataFrame:
    """Every row of ``big`` with every row of ``small``: a broadcast of bounded size for each slice, ``big`` stays where it is."""
    out = None
    for part in slices_of(small, most):
        j = big.crossJoin(F.broadcast(part))
        out = j if out is None else out.unionByName(j)
    return out
