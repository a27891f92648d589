"""Response-curve calibration: validation, interpolation and fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_col, clamp
from ..functions.retrieval import cubic_ppb


def grid_completeness(table: DataFrame) -> DataFrame:
    """Per satellite: rows found, rows a full grid needs, and whether it is complete."""
    n, need = F.count(F.lit(1)), F.count_distinct("sza") * F.count_distinct("vza")
    return table.groupBy("satellite").agg(
        n.alias("n_rows"), need.alias("n_expected"), (n == need).alias("complete")
    )


def curve_cells(table: DataFrame) -> DataFrame:
    """One row per grid cell with its four corner coefficient sets.

    A calibration holds tens of rows per satellite, so the windows and the
    broadcast in ``attach_curve`` work on a table of fixed size.
    """
    along_sza = Window.partitionBy("satellite", "vza").orderBy("sza")
    along_vza = Window.partitionBy("satellite", "sza").orderBy("vza")
    whole = Window.partitionBy("satellite")
    return (
        table.select("satellite", "sza", "vza", F.struct("c1", "c2", "c3").alias("k00"))
        .withColumn("sza1", F.lead("sza").over(along_sza))
        .withColumn("k10", F.lead("k00").over(along_sza))
        .select(
            "satellite", F.col("sza").alias("sza0"), F.col("vza").alias("vza0"), "sza1", "k00", "k10",
            F.lead("vza").over(along_vza).alias("vza1"),
            F.lead("k00").over(along_vza).alias("k01"),
            F.lead("k10").over(along_vza).alias("k11"),
            F.min("sza").over(whole).alias("sza_lo"), F.max("sza").over(whole).alias("sza_hi"),
            F.min("vza").over(whole).alias("vza_lo"), F.max("vza").over(whole).alias("vza_hi"),
        )
        .where(F.col("sza1").isNotNull() & F.col("vza1").isNotNull())
    )


def attach_curve(
    scenes: DataFrame, table: DataFrame, satellite="satellite", sza="sza", vza="vza", fallback: str = "S2B"
) -> DataFrame:
    """Add ``c1, c2, c3`` interpolated at each scene's geometry, clamped to the grid.

    An unknown satellite uses ``fallback`` when the table has it, else the first.
    """
    names = table.agg(
        F.collect_set("satellite").alias("_known"),
        F.coalesce(F.max(F.when(F.col("satellite") == fallback, fallback)), F.min("satellite")).alias("_default"),
    )
    cells = curve_cells(table).withColumnRenamed("satellite", "_sat")
    s = scenes.crossJoin(F.broadcast(names)).withColumn("_upper", F.upper(as_col(satellite)))
    s = s.withColumn(
        "_sat", F.when(F.array_contains("_known", F.col("_upper")), F.col("_upper")).otherwise(F.col("_default"))
    ).drop("_known", "_default", "_upper")
    s, c = s.alias("s"), cells.alias("c")
    zs = clamp(F.col(f"s.{sza}"), F.col("c.sza_lo"), F.col("c.sza_hi"))
    zv = clamp(F.col(f"s.{vza}"), F.col("c.vza_lo"), F.col("c.vza_hi"))

    def inside(v, axis):
        lo, hi = F.col(f"c.{axis}0"), F.col(f"c.{axis}1")
        return ((v > lo) & (v <= hi)) | ((v == F.col(f"c.{axis}_lo")) & (lo == v))

    on = (F.col("s._sat") == F.col("c._sat")) & inside(zs, "sza") & inside(zv, "vza")
    ts = (zs - F.col("sza0")) / (F.col("sza1") - F.col("sza0"))
    tv = (zv - F.col("vza0")) / (F.col("vza1") - F.col("vza0"))

    def mix(k):
        low = F.col(f"k00.{k}") + (F.col(f"k01.{k}") - F.col(f"k00.{k}")) * tv
        high = F.col(f"k10.{k}") + (F.col(f"k11.{k}") - F.col(f"k10.{k}")) * tv
        return (low + (high - low) * ts).alias(k)

    return s.join(F.broadcast(c), on).select(
        *[F.col(f"s.{n}") for n in scenes.columns], mix("c1"), mix("c2"), mix("c3")
    )


def rtm_enhancement(df: DataFrame, u_target: str, u_reference: str) -> DataFrame:
    """Add ``ppb`` from a log-ratio change; the curve columns come from ``attach_curve``."""
    return df.withColumn("ppb", cubic_ppb(F.col(u_target) - F.col(u_reference), "c1", "c2", "c3"))


def fit_curves(samples: DataFrame, key: list[str], x: str = "x", y: str = "ppb") -> DataFrame:
    """Least-squares cubic through the origin per key, with its worst relative residual.

    Moment sums combine map-side; ``x`` is scaled by its largest magnitude so
    the 3x3 normal equations stay well conditioned.
    """
    span = samples.groupBy(*key).agg(F.max(F.abs(x)).alias("_s"))
    scaled = samples.join(span, key).withColumn("_x", F.col(x) / F.col("_s"))
    sums = [F.sum(F.pow("_x", F.lit(p))).alias(f"_x{p}") for p in range(2, 7)]
    sums += [F.sum(F.pow("_x", F.lit(p)) * F.col(y)).alias(f"_y{p}") for p in (1, 2, 3)]
    m = scaled.groupBy(*key, "_s").agg(*sums)
    a, b, c, d, e = (F.col(f"_x{p}") for p in range(2, 7))
    u, v, w = (F.col(f"_y{p}") for p in (1, 2, 3))

    def det(p, q, r, s, t, z, g, h, i):
        return p * (t * i - z * h) - q * (s * i - z * g) + r * (s * h - t * g)

    whole = det(a, b, c, b, c, d, c, d, e)
    fit = m.select(
        *key,
        (F.try_divide(det(u, b, c, v, c, d, w, d, e), whole) / F.col("_s")).alias("c1"),
        (F.try_divide(det(a, u, c, b, v, d, c, w, e), whole) / F.pow("_s", F.lit(2))).alias("c2"),
        (F.try_divide(det(a, b, u, b, c, v, c, d, w), whole) / F.pow("_s", F.lit(3))).alias("c3"),
    )
    pred = F.col(x) * (F.col("c1") + F.col(x) * (F.col("c2") + F.col(x) * F.col("c3")))
    worst = samples.join(fit, key).where(F.col(y) > 1.0).groupBy(*key).agg(
        F.max(F.abs(pred - F.col(y)) / F.col(y)).alias("max_relative_residual")
    )
    return fit.join(worst, key, "left").fillna(0.0, ["max_relative_residual"])
