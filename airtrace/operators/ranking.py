"""Running totals, global ranks and exact quantiles without single-task windows.

Rows are range-partitioned on the sort key, each partition is summed on its
own, and per-partition totals (one row per partition and group) are prefix
summed. A group holding most of the table is therefore still spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running_total(
    df: DataFrame, order: list[Column], measures: dict[str, Column], group: list[str] | None = None
) -> DataFrame:
    """Add inclusive running sums named by ``measures``; ``order`` must be a total order within a group."""
    group = group or []
    keys = [F.col(g) for g in group]
    placed = df
    for name, expr in measures.items():
        placed = placed.withColumn(f"_m_{name}", expr)
    placed = materialize(
        placed.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges"
    )
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = placed.select("*", *[F.sum(f"_m_{n}").over(inside).alias(f"_l_{n}") for n in measures])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        placed.groupBy("_part", *group)
        .agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in measures])
        .select(
            "_part", *group,
            *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in measures],
        )
    )
    out = local.join(totals, ["_part", *group])
    for n in measures:
        out = out.withColumn(n, F.col(f"_l_{n}") + F.col(f"_o_{n}"))
    drop = ["_part"] + [f"_{p}_{n}" for n in measures for p in "mlo"]
    return out.drop(*drop)


def row_numbers(df: DataFrame, order: list[Column], name: str, group: list[str] | None = None) -> DataFrame:
    """1-based position in ``order``."""
    return running_total(df, order, {name: F.lit(1).cast("long")}, group)


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per group, for groups of any size.

    Equal values are counted before the sort, so copies never travel twice.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_total(counts, [F.col(value).asc()], {"_cum": F.col("_n")}, group)
    sizes = counts.groupBy(*group).agg(F.sum("_n").alias("_size"))
    # Only the rows that cover a wanted rank survive the filter before the final aggregate.
    joined = ranked.join(sizes, group) if group else ranked.crossJoin(F.broadcast(sizes))
    low, high = F.col("_cum") - F.col("_n"), F.col("_cum") - 1
    aggs, covers = [], F.lit(False)
    for name, p in probs.items():
        pos = (F.col("_size") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        at_lo, at_hi = lo.between(low, high), hi.between(low, high)
        covers = covers | at_lo | at_hi
        vlo = F.max(F.when(at_lo, F.col(value)))
        vhi = F.max(F.when(at_hi, F.col(value)))
        frac = F.max(pos - lo)
        aggs.append((vlo + (vhi - vlo) * frac).alias(name))
    aggs.append(F.max("_size").alias("n"))
    return joined.where(covers).groupBy(*group).agg(*aggs)
