"""Rolling robust background and anomaly screening of daily pixel stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.screening import exceeds, modified_z, qa_pass


def array_median(a: Column) -> Column:
    """Median of a sorted array without missing items; NULL when empty."""
    n = F.size(a)
    lo = F.try_element_at(a, F.floor((n + 1) / 2).cast("int"))
    hi = F.try_element_at(a, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n > 0, (lo + hi) / 2.0)


def rolling_background(
    pixels: DataFrame, key: list[str], window: int = 30, exclude_center: bool = True, value: str = "value"
) -> DataFrame:
    """Per-pixel median and MAD over neighbouring frames.

    One shuffle on the pixel key; each row carries at most ``2*half+1`` values.
    ``key`` names stack, row and column; ``frame`` orders the stack and has the
    stack's own length in ``n_frames`` when a one-frame stack must keep its centre.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    half = max(1, window // 2)
    w = Window.partitionBy(*key).orderBy("frame")
    if exclude_center:
        # collect_list skips NULLs, so two half frames leave out centre and gaps at once.
        before = F.collect_list(value).over(w.rangeBetween(-half, -1))
        after = F.collect_list(value).over(w.rangeBetween(1, half))
        sample = F.concat(before, after)
        if "n_frames" in pixels.columns:
            sample = F.when(F.col("n_frames") > 1, sample).otherwise(F.array_compact(F.array(value)))
    else:
        sample = F.collect_list(value).over(w.rangeBetween(-half, half))
    out = pixels.withColumn("_vals", F.sort_array(sample))
    out = out.withColumn("median", array_median(F.col("_vals")))
    spread = F.sort_array(F.transform("_vals", lambda v: F.abs(v - F.col("median"))))
    return out.withColumn("mad", array_median(spread)).drop("_vals")


def screen_anomalies(
    pixels: DataFrame, key: list[str], window: int = 30, min_qa: float = 0.5, threshold: float = 3.0
) -> DataFrame:
    """Quality filter, rolling background, modified z-score and threshold flag."""
    good = pixels.withColumn("value", F.when(qa_pass("qa", "value", min_qa=min_qa), F.col("value")))
    scored = rolling_background(good, key, window).withColumn("z", modified_z("value", "median", "mad"))
    return scored.withColumn("anomalous", exceeds("z", threshold))


def background_composite(
    pixels: DataFrame, key: list[str], window_days: int = 30, day: str = "obs_date", value: str = "value"
) -> DataFrame:
    """Per-pixel median over calendar days around each day, the centre included."""
    half = window_days // 2
    w = Window.partitionBy(*key).orderBy(F.unix_date(day)).rangeBetween(-half, half)
    vals = F.sort_array(F.collect_list(value).over(w))
    return pixels.withColumn("_v", vals).withColumn("composite", array_median(F.col("_v"))).drop("_v")
