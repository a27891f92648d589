"""Band-pair retrieval over pixel tables: masks, reference medians, noise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import Axis, bucket_join
from .stencil import robust_sigma


def combine_masks(target: DataFrame, reference: DataFrame, key: list[str]) -> DataFrame:
    """Reference pixels joined to their target pixel with ``usable`` = all four masks hold."""
    t = target.select(*key, F.col("valid").alias("_tv"), F.col("clear").alias("_tc"))
    usable = F.col("_tv") & F.col("_tc") & F.col("valid") & F.col("clear")
    return reference.join(t, key).withColumn("usable", F.coalesce(usable, F.lit(False))).drop("_tv", "_tc")


def reference_median(u: DataFrame, key: list[str], value: str = "u") -> DataFrame:
    """Per-pixel median of the log ratio over the reference passes, gaps ignored."""
    return u.groupBy(*key).agg(F.percentile(value, F.lit(0.5)).alias("u_ref"))


def log_ratio_noise(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Robust and plain spread of the same field; the robust one has no floor."""
    plain = df.groupBy(*key).agg(F.stddev_pop(value).alias("plain_std"))
    return robust_sigma(df, key, value, floor=0.0, name="robust_sigma").join(plain, key)


def winds_window_median(
    passes: DataFrame, winds: DataFrame, before_days: int = 2, after_days: int = 1, site: str = "site"
) -> DataFrame:
    """Median wind around each pass; calendar days ``[-before, +after]``.

    ``passes`` has ``pass_id, site, date``; ``winds`` has ``site, time, speed, u10, v10``.
    """
    w = winds.select(site, F.unix_date(F.to_date("time")).alias("_w"), "speed", "u10", "v10")
    p = passes.select("pass_id", site, F.unix_date("date").alias("_p"))
    gap = F.col("_w") - F.col("_p")
    reach = float(max(before_days, after_days))
    near = bucket_join(w, p, [Axis(F.col("_w"), F.col("_p"), reach)], gap.between(-before_days, after_days), equal=[site])
    return near.groupBy("pass_id").agg(
        *[F.percentile(c, F.lit(0.5)).alias(c) for c in ("speed", "u10", "v10")], F.count(F.lit(1)).alias("n_hours")
    )


def wind_product_delta(a: DataFrame, b: DataFrame, key: list[str], site: str) -> DataFrame:
    """Per-site difference of two wind products at the same hours."""
    d = F.col("speed") - F.col("_other")
    both = a.join(b.select(*key, F.col("speed").alias("_other")), key)
    return both.groupBy(site).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_delta"), F.max(F.abs(d)).alias("max_delta")
    )
