"""What users extend: derived parameters and averages by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import col

AVERAGES: dict[str, Callable[[Column], Column]] = {
    "median": F.median,
    "mean": F.avg,
    "hmean": lambda c: F.count(c) / F.sum(1 / c),
    "max": F.max,
    "min": F.min,
}
_derived: dict[str, tuple[Callable[[], Column], tuple[str, Callable[[], Column]] | None]] = {}


def register_average(name: str, build: Callable[[Column], Column]) -> None:
    AVERAGES[name] = build


def add_alias(name: str, build: Callable[[], Column], real: str | None = None, inverse: Callable[[], Column] | None = None) -> None:
    """Register a derived parameter; ``inverse`` gives the real parameter from it."""
    _derived[name] = (build, (real, inverse) if real and inverse else None)


def with_alias(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, _derived[name][0]())


def without_alias(df: DataFrame, name: str) -> DataFrame:
    """Set the real parameter from the derived one and drop the latter."""
    real = _derived[name][1]
    if real is None:
        raise KeyError(f"{name} has no inverse")
    return df.withColumn(real[0], real[1]()).drop(name)


add_alias("N_BRAKING", lambda: col("F0") * col("F2") / (col("F1") * col("F1")), "F2", lambda: col("N_BRAKING") * col("F1") * col("F1") / col("F0"))
