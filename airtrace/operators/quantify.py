"""Emission quantification: integrated mass, resampled rates, honesty gates, flux audit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions.numeric import as_col, clamp, fixed_text, gaussian, pick, uniform32
from ..functions.retrieval import (
    ALT_KG_M2_PER_PPB, AMBIENT_COLUMN_PPB, PPM_M_PER_PPB, column_mass, effective_wind, plume_length, source_rate,
)
from ..functions.screening import scale_name
from .ranking import exact_quantiles
from .stencil import robust_sigma

#: Mask pixels that are perturbed at a time.
PIXEL_CHUNK = 256
#: Side of the squares by which a scene's mask pixels come together.
SQUARE_SIDE = 64


def integrated_mass(
    df: DataFrame, key: list[str], area: float, mask: str = "in_mask", value: str = "value", pressure=1013.0
) -> DataFrame:
    """``ime_kg`` over finite mask pixels and ``n_pixels`` over all mask pixels."""
    mass = F.sum(F.when(F.col(mask), column_mass(value, pressure)))
    return df.groupBy(*key).agg(
        (F.coalesce(mass, F.lit(0.0)) * area).alias("ime_kg"), F.count_if(F.col(mask)).alias("n_pixels")
    )


def rate_estimate(mass: DataFrame, u10: Column, area: float) -> DataFrame:
    """Point estimate from ``ime_kg`` and ``n_pixels``."""
    length = plume_length(F.greatest("n_pixels", F.lit(1)), area)
    ueff = effective_wind(u10)
    return mass.select(
        "*", length.alias("length_m"), ueff.alias("ueff_ms"), source_rate("ime_kg", ueff, length).alias("q_kg_h")
    )


def _perturbed(draws: int, seed_columns: int, keep_probability: float, noise_ppb: float):
    """Partial sums of perturbed pixels: the kept values with noise, and their number, as arrays over the draws.

    A row per scene and chunk of ``PIXEL_CHUNK`` pixels; nothing is held per pixel and draw beyond the chunk.
    """
    slot = np.arange(draws, dtype=np.uint64) * np.uint64(3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [f.name for f in b.schema][:seed_columns]
            scenes = b["_s"].dictionary_encode()
            code = scenes.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            base = b["_base"].to_numpy().astype(np.uint64)[order]
            value = b["_v"].to_numpy(zero_copy_only=False).astype(float)[order]
            cuts = np.flatnonzero(np.diff(code[order], prepend=-1))
            starts = sorted({*cuts.tolist(), *range(0, len(order), PIXEL_CHUNK)})
            rows, sums, counts = [], [], []
            for a, z in zip(starts, [*starts[1:], len(order)]):
                key, at = base[a:z, None], value[a:z, None]
                keep = uniform32(key, slot) < keep_probability
                noise = np.sqrt(-2 * np.log(uniform32(key, slot + np.uint64(1)))) * np.cos(2 * np.pi * uniform32(key, slot + np.uint64(2)))
                rows.append(order[a])
                sums.append(np.where(keep & ~np.isnan(at), at + noise * noise_ppb, 0.0).sum(0))
                counts.append(keep.sum(0))
            first = b.select(names).take(pa.array(rows, pa.int64()))
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * draws)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*x, np.zeros(0, t)]).astype(t))) for x, t in ((sums, np.float64), (counts, np.int64))]
            yield pa.RecordBatch.from_arrays([*first.columns, *lists], names=[*names, "_m", "_n"])

    return run


def rate_monte_carlo(
    df: DataFrame, key: list[str], u10: DataFrame, area: float, *, draws: int = 500, seed: int = 20270307,
    wind_noise: float = 0.25, keep_probability: float = 0.9, noise_ppb: float = 15.0,
    low: float = 0.025, high: float = 0.975, pressure: float = 1013.0, mask: str = "in_mask", value: str = "value",
) -> DataFrame:
    """Percentile interval of the rate under wind, mask and retrieval perturbations.

    ``u10`` has the key columns and ``u10``. A mask pixel has a key from seed,
    scene and position; its draws are counted up from there (``uniform32``), so
    they do not depend on partitioning. Pixels come together by scene and square
    of ``SQUARE_SIDE`` and are perturbed in chunks as arrays over the draws; the
    sums of a chunk are shuffled as one row, and draws are told apart only after that.
    """
    scene = F.concat_ws("_", *key)
    base = pick(F.lit(1 << 32), F.lit(seed), scene, F.col("row"), F.col("col"), F.lit("pixel"))
    square = [F.floor(F.col(c) / SQUARE_SIDE).alias(f"_{c}") for c in ("row", "col")]
    px = df.where(F.col(mask)).select(*key, scene.alias("_s"), base.alias("_base"), F.col(value).cast("double").alias("_v"), *square)
    px = px.repartition(*key, "_row", "_col").sortWithinPartitions(*key, "_row", "_col")
    schema = StructType([*df.select(*key).schema.fields, StructField("_m", ArrayType(DoubleType())), StructField("_n", ArrayType(LongType()))])
    parts = px.mapInArrow(_perturbed(draws, len(key), keep_probability, noise_ppb), schema)
    # A chunk lists every draw, also one that lost all its pixels. The winds meet chunks, and all draws of a scene stay where they met.
    # Told apart they are ``draws`` rows a scene, so partitions must not be put together by their size before that.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = parts.repartition(n, *key).join(u10, key).select(*key, "u10", F.posexplode(F.arrays_zip("_m", "_n")).alias("draw", "_p"))
    sums = each.groupBy(*key, "draw").agg(
        column_mass(F.sum("_p._m"), pressure).alias("_m"), F.sum("_p._n").alias("_n"), F.first("u10").alias("u10")
    )
    factor = clamp(
        1.0 + gaussian(F.lit(seed), scene, F.col("draw"), F.lit("wind")) * wind_noise,
        1.0 - 2 * wind_noise, 1.0 + 2 * wind_noise,
    )
    q = source_rate(F.col("_m") * area, effective_wind("u10") * factor, plume_length(F.greatest("_n", F.lit(1)), area))
    return sums.select(*key, q.alias("q")).groupBy(*key).agg(
        F.percentile("q", F.lit(low)).alias("ci_low"), F.percentile("q", F.lit(high)).alias("ci_high"),
        F.avg("q").alias("q_mean"), F.count(F.lit(1)).alias("draws"),
    )


def rate_record(
    df: DataFrame, key: list[str], u10: DataFrame, area: float, *, pressure: float = 1013.0, mask: str = "in_mask", value: str = "value", **options,
) -> DataFrame:
    """The rate of every scene as one record: ``q_kg_h, ci_low, ci_high, ime_kg, ueff_ms, length_m, n_pixels``.

    The point estimate comes from the unperturbed pixels; a scene without mask
    pixels has a rate and an interval of zero. ``options`` go to ``rate_monte_carlo``.
    """
    point = rate_estimate(integrated_mass(df, key, area, mask, value, pressure).join(u10, key), F.col("u10"), area)
    interval = rate_monte_carlo(df, key, u10, area, pressure=pressure, mask=mask, value=value, **options).select(*key, "ci_low", "ci_high")
    zero = F.lit(0.0)
    return point.join(interval, key, "left").select(
        *key, "q_kg_h", F.coalesce("ci_low", zero).alias("ci_low"), F.coalesce("ci_high", zero).alias("ci_high"), "ime_kg", "ueff_ms", "length_m", "n_pixels",
    )


# Verdict sentences.
ARTIFACT_VERDICT = "ARTIFACT-DOMINATED — quantification withheld"
CLEAN_VERDICT = "gates passed — quantification permitted"


def honesty_gates(
    df: DataFrame, key: list[str], *, mask: str = "in_mask", valid: str = "valid", value: str = "value",
    sigma_limit: float = 80.0, fraction_limit: float = 0.15, mean_ratio: float = 1.0,
) -> DataFrame:
    """Noise, mask share and mean enhancement per scene with the reasons that withhold a rate."""
    usable = df.where(F.col(valid))
    background = usable.where(~F.col(mask) & F.col(value).isNotNull())
    sigma = robust_sigma(background, key, value)
    stats = df.groupBy(*key).agg(
        F.count_if(F.col(valid)).alias("n_window_px"),
        F.count_if(F.col(valid) & F.col(mask)).alias("n_mask_px"),
        F.avg(F.when(F.col(valid) & F.col(mask), F.col(value))).alias("mean_enhancement_ppb"),
    )
    out = stats.join(sigma, key, "left").withColumn("sigma_col_ppb", F.coalesce("sigma", F.lit(float("inf")))).drop("sigma")
    share = F.coalesce(F.try_divide("n_mask_px", "n_window_px"), F.lit(0.0))
    out = out.withColumn("mask_fraction", share)
    mean_limit = mean_ratio * AMBIENT_COLUMN_PPB
    reasons = F.array_compact(F.array(
        F.when(
            F.col("mean_enhancement_ppb") > mean_limit,
            F.concat(
                F.lit("mean in-mask enhancement "), fixed_text("mean_enhancement_ppb", 0), F.lit(" ppb is "),
                fixed_text(F.col("mean_enhancement_ppb") / AMBIENT_COLUMN_PPB, 1),
                F.lit(f"x the ambient column — unphysical for a point source (limit {mean_limit:.0f} ppb)"),
            ),
        ),
        F.when(
            F.col("sigma_col_ppb") > sigma_limit,
            F.concat(F.lit("sigma_col "), fixed_text("sigma_col_ppb", 1), F.lit(f" ppb > {sigma_limit:.0f} ppb limit")),
        ),
        F.when(
            F.col("mask_fraction") > fraction_limit,
            F.concat(F.lit("plume mask "), fixed_text(F.col("mask_fraction") * 100, 1), F.lit(f"% of window > {fraction_limit:.0%} limit")),
        ),
    ))
    return out.withColumn("reasons", reasons).withColumn("artifact_dominated", F.size("reasons") > 0).withColumn(
        "verdict", F.when(F.col("artifact_dominated"), ARTIFACT_VERDICT).otherwise(CLEAN_VERDICT)
    )


def flux_audit(runs: DataFrame) -> DataFrame:
    """Decompose recorded flux outputs ``q, l, npix, ime, sum_enhancement, pixel_size, u_eff``.

    Optional context: ``catalog_t_h`` and ``window_px``.
    """
    n, area = F.col("npix"), F.col("pixel_size")
    mean = F.try_divide(F.col("sum_enhancement") / PPM_M_PER_PPB, n)
    q = F.col("q") / 1000.0
    ratio = F.when(F.col("catalog_t_h") != 0, q / F.col("catalog_t_h"))
    ime = mean * ALT_KG_M2_PER_PPB * n * area
    length = F.sqrt(n * area)
    notes = F.array_compact(F.array(
        F.when(
            (F.col("ime") != 0) & (F.abs(ime - F.col("ime")) / F.col("ime") > 0.01),
            F.format_string("IME reconstruction mismatch: recorded %.0f kg vs reconstructed %.0f kg", F.col("ime"), ime),
        ),
        F.when(
            F.abs(length - F.col("l")) > 1.0,
            F.format_string("L is not sqrt(plume area): recorded %.1f m vs sqrt(A) %.1f m", F.col("l"), length),
        ),
    ))
    return runs.select(
        "event_id", q.alias("q_t_h"), mean.alias("mean_enhancement_ppb"), (n * area / 1e6).alias("plume_area_km2"),
        ime.alias("ime_recomputed_kg"), length.alias("length_recomputed_m"), notes.alias("notes"),
        ratio.alias("ratio_to_catalog"),
        F.when(F.col("window_px") > 0, n / F.col("window_px")).alias("mask_fraction"),
        (mean / AMBIENT_COLUMN_PPB).alias("column_enhancement_factor"),
        F.try_divide(mean, ratio).alias("mean_ppb_for_catalog_rate"),
        (ratio * ratio).alias("mask_shrink_for_catalog_rate"),
    )


def scale_verdict(df: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """Reflectance convention per scene and band from the 99th percentile of finite pixels."""
    g = df.groupBy(*key).agg(
        F.percentile(value, F.lit(0.99)).alias("p99"),
        (F.count(value) / F.count(F.lit(1))).alias("finite_fraction"),
    )
    return g.withColumn("scale", scale_name("p99"))


def require_dn(verdicts: DataFrame) -> DataFrame:
    """The same rows, failing the job on any scene that is not on the DN scale."""
    bad = F.concat(F.lit("DN scale required, found "), F.col("scale"))
    return verdicts.withColumn(
        "scale", F.when(F.col("scale") == "dn", F.col("scale")).otherwise(F.raise_error(bad).cast("string"))
    )


def zero_control_summary(runs: DataFrame) -> DataFrame:
    """Runs with a retrieved value on metered zeros: how many fired and how large."""
    zero = runs.where(F.col("kind").isin("zero_control", "no_release") & F.col("retrieved_kg_h").isNotNull())
    hit = F.when(F.col("is_plume"), F.col("retrieved_kg_h"))
    median = exact_quantiles(zero.select(hit.alias("_hit")), [], "_hit", {"false_median": 0.5}).select("false_median")
    return zero.agg(
        F.count(F.lit(1)).alias("n_runs"), F.count(hit).alias("n_false"), F.min(hit).alias("false_min"), F.max(hit).alias("false_max"),
    ).crossJoin(F.broadcast(median)).select("n_runs", "n_false", "false_min", "false_median", "false_max")


def truth_compare(truth: DataFrame, runs: DataFrame) -> DataFrame:
    """Metered truth next to the retrieved result of the same campaign and day.

    ``runs``: ``campaign, det_date, q_kg_h`` (quotable) and ``q_withheld``.
    """
    got = F.coalesce("q_kg_h", "q_withheld")
    joined = truth.join(
        runs, (truth["campaign"] == runs["campaign"]) & (truth["date"] == runs["det_date"]), "left"
    ).drop(runs["campaign"])
    return joined.withColumn("retrieved_kg_h", got).withColumn(
        "quantification_withheld", F.col("q_kg_h").isNull() & F.col("q_withheld").isNotNull()
    ).withColumn("ratio", F.when((F.col("kg_h") != 0) & (got != 0), got / F.col("kg_h")))


def detection_limit(
    sigma_ppb, u10, *, k: float = 3.0, min_pixels=25, pixel_area=400.0, length=1000.0, pressure=1013.0
) -> Column:
    """Smallest rate (kg/h) whose mask stands ``k`` noise levels above zero."""
    n, area = as_col(min_pixels), as_col(pixel_area)
    mass = column_mass(as_col(sigma_ppb) * k, pressure) * n * area
    size = F.greatest(as_col(length), F.sqrt(n * area))
    return source_rate(mass, effective_wind(u10), size)
