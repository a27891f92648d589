"""Registration of a reference pass on its target and sub-pixel resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align_shift(target: DataFrame, reference: DataFrame, key: list[str], pair: list[str], reach: int = 3) -> DataFrame:
    """Displacement ``dy, dx`` of each reference that best correlates with its target.

    Correlations of all integer shifts within ``reach`` are one map-side
    combined aggregate; the peak is refined by a parabola along each axis.
    Pixels meet in squares of ``4 * reach`` pixels: a reference pixel is shuffled
    once, a target pixel to the squares that it is in reach of (2.25 on average),
    and shifts are told apart after the join.
    ``target``: key, row, col, value. ``reference``: key, pair, row, col, value.
    """
    side = max(4 * reach, 1)
    r = reference.where(F.col("value").isNotNull()).select(
        *key, *pair, F.floor(F.col("row") / side).alias("_br"), F.floor(F.col("col") / side).alias("_bc"), "row", "col", "value"
    )
    t = target.where(F.col("value").isNotNull()).select(*key, F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("value").alias("_t"))
    for name, v in (("_br", F.col("_row")), ("_bc", F.col("_col"))):
        t = t.withColumn(name, F.explode(F.sequence(F.floor((v - reach) / side), F.floor((v + reach) / side))))
    dy, dx = F.col("_row") - F.col("row"), F.col("_col") - F.col("col")
    # Sizes estimated from files know nothing of the copies, so the targets are not broadcast.
    met = r.join(t.hint("merge"), [*key, "_br", "_bc"]).where((F.abs(dy) <= reach) & (F.abs(dx) <= reach))
    surface = met.groupBy(*key, *pair, dy.cast("int").alias("dy"), dx.cast("int").alias("dx")).agg(F.corr("value", "_t").alias("c"))
    surface = surface.where(F.col("c").isNotNull() & ~F.isnan("c"))
    order = F.struct(
        F.round("c", 9), (-(F.abs("dy") + F.abs("dx"))).alias("a"), (-F.col("dy")).alias("b"), (-F.col("dx")).alias("d")
    )
    peak = surface.groupBy(*key, *pair).agg(F.max_by(F.struct("dy", "dx", "c"), order).alias("p"))
    near = surface.join(peak, [*key, *pair])

    def at(y: int, x: int):
        return F.max(F.when((F.col("dy") == F.col("p.dy") + y) & (F.col("dx") == F.col("p.dx") + x), F.col("c")))

    def vertex(low, high, mid):
        bend = low - mid * 2.0 + high
        return F.coalesce(F.when(bend < 0, (low - high) / bend * 0.5), F.lit(0.0))

    g = near.groupBy(*key, *pair).agg(
        F.first("p").alias("p"), at(-1, 0).alias("n"), at(1, 0).alias("s"), at(0, -1).alias("w"), at(0, 1).alias("e")
    )
    return g.select(
        *key, *pair, F.round(F.col("p.dy") + vertex(F.col("n"), F.col("s"), F.col("p.c")), 2).alias("dy"),
        F.round(F.col("p.dx") + vertex(F.col("w"), F.col("e"), F.col("p.c")), 2).alias("dx"), F.col("p.c").alias("peak"),
    )


def resample_shift(pixels: DataFrame, shifts: DataFrame, shape: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """Content moved by ``(dy, dx)`` with bilinear weights and nearest edges.

    Shifts below 0.05 pixel in both axes leave the pixels untouched. The pixel
    set (the validity mask) stays in place; a missing neighbour gives NULL.
    """
    p = pixels.join(shifts.select(*key, "dy", "dx"), key).join(shape.select(*key, "n_rows", "n_cols"), key)
    still = (F.abs("dy") < 0.05) & (F.abs("dx") < 0.05)
    y = F.col("row") - F.when(still, 0.0).otherwise(F.col("dy"))
    x = F.col("col") - F.when(still, 0.0).otherwise(F.col("dx"))
    fy, fx = y - F.floor(y), x - F.floor(x)

    def corner(a: int, b: int):
        wy = fy if a else 1.0 - fy
        wx = fx if b else 1.0 - fx
        r = F.least(F.greatest(F.floor(y) + a, F.lit(0)), F.col("n_rows") - 1)
        c = F.least(F.greatest(F.floor(x) + b, F.lit(0)), F.col("n_cols") - 1)
        return F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"), (wy * wx).alias("w"))

    need = p.select(
        *key, "row", "col", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("k")
    ).where(F.col("k.w") > 0)
    src = pixels.select(*key, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("_v"))
    hit = need.select(*key, "row", "col", F.col("k.r").alias("_r"), F.col("k.c").alias("_c"), F.col("k.w").alias("_w")).join(
        src, [*key, "_r", "_c"], "left"
    )
    whole = F.count(F.lit(1)) == F.count("_v")
    return hit.groupBy(*key, "row", "col").agg(F.when(whole, F.sum(F.col("_v") * F.col("_w"))).alias(value))
