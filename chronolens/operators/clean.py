"""The load order: what every series goes through before it is used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .changepoints import change_points, chunk_variance
from .series import KEY, dedupe_times, normalise_series, remove_outliers, subtract_running_median, time_step
from .storage import written


def clean(df: DataFrame, pos: str, key: list[str] = KEY, thresh: float | None = 3.5, window: int = 30, limit: str | float | None = "default",
          minlength: int = 5, maxlength: int | None = None) -> DataFrame:
    """Repeated times, outliers, time step, running median, change points, variance: in this order.

    Returns the kept samples as (key, t, re, im[, sigma]) with dt (null for a single sample), chunk
    (0 from the first), n (samples of the chunk) and var (of the chunk; given sigmas win). Change
    points are sought in the series less its running median; the samples themselves keep it.
    ``pos`` gives the input order of repeated times; thresh None keeps outliers; limit None leaves
    each series one chunk. An empty table stays empty.
    """
    first = normalise_series(dedupe_times(df, pos, key), key)
    kept = remove_outliers(first, thresh, key) if thresh is not None else first
    kept = written(kept.join(time_step(kept, key), key), "cleaned")
    if limit is None:
        chunks = kept.withColumn("chunk", F.lit(0))
    else:
        flat = subtract_running_median(kept, window, key).select(*key, "t", "re", "im")
        found = change_points(flat, key, ["t"], limit, minlength, maxlength).select(*key, "t", F.col("chunk").cast("int").alias("chunk"))
        chunks = kept.join(found, [*key, "t"])
    return chunks.join(chunk_variance(chunks, [*key, "chunk"]), [*key, "chunk"]).select(*kept.columns, "chunk", "n", "var")
