"""Scene features, training tables, detectors and classifiers."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pick, uniform
from ..session import materialize
from .components import pixel_components
from .evaluate import binary_scores
from .fitting import margin_fit, margin_sums, newton_logistic
from .ranking import row_numbers
from .stencil import scene_normalize, tile_windows

# Feature names in model order.
FEATURE_NAMES = [
    "valid_frac", "xch4_std", "xch4_ptp", "norm_max", "frac_high", "blob_frac_largest", "blob_aspect",
    "wind_speed_mean", "wind_coherence", "chi2_mean", "qa_min", "aot_swir_mean", "albedo_swir_mean",
    "cloud_frac_mean", "abs_lat_center",
]
HIGH = 0.6


def blob_shape(high: DataFrame, key: list[str], n_valid: DataFrame) -> DataFrame:
    """Share of valid pixels in the largest 4-connected high region, and its elongation."""
    labelled = pixel_components(high, key)
    per = labelled.groupBy(*key, "label").agg(
        F.count(F.lit(1)).alias("n"), F.var_samp("row").alias("vr"), F.var_samp("col").alias("vc"), F.covar_samp("row", "col").alias("cv")
    )
    # The first label in raster order wins size ties.
    big = per.groupBy(*key).agg(
        F.max_by(F.struct("n", "vr", "vc", "cv"), F.struct("n", (-F.col("label")).alias("o"))).alias("b"), F.sum("n").alias("n_high")
    )
    mid = (F.col("b.vr") + F.col("b.vc")) / 2
    gap = F.sqrt(F.pow((F.col("b.vr") - F.col("b.vc")) / 2, F.lit(2)) + F.pow("b.cv", F.lit(2)))
    top, low = F.greatest(mid + gap, F.lit(1e-6)), F.greatest(mid - gap, F.lit(1e-6))
    aspect = F.when(F.col("b.n") >= 3, F.least(F.sqrt(top / low), F.lit(10.0))).otherwise(1.0)
    size = F.when(F.col("n_high") < 3, F.col("n_high")).otherwise(F.col("b.n"))
    joined = n_valid.join(big, key, "left")
    return joined.select(
        *key, F.least(F.coalesce(size / F.greatest("n_valid", F.lit(1)), F.lit(0.0)), F.lit(1.0)).alias("blob_frac_largest"),
        F.coalesce(F.when(F.col("n_high") >= 3, aspect), F.lit(1.0)).alias("blob_aspect"),
    )


def scene_features(pixels: DataFrame, key: list[str], lat_center: str | None = None) -> DataFrame:
    """The fifteen features per scene from one row per pixel.

    ``value`` is the column; context columns (``albedo_swir, aot_swir, chi2,
    qa_value, cloud_frac, u10, v10``) are optional and count as 0 when absent.
    A ``norm`` column, when present, is taken as the normalised value.
    """
    px = pixels if "norm" in pixels.columns else scene_normalize(pixels, key)
    seen = F.col("value").isNotNull()
    n = F.count("value")

    def mean(c: str) -> Column:
        if c not in pixels.columns:
            return F.lit(0.0)
        return F.coalesce(F.avg(F.when(seen, F.col(c))), F.lit(0.0))

    high = F.col("norm") > HIGH
    wind = {"u10", "v10"} <= set(pixels.columns)
    speed = F.coalesce(F.avg(F.hypot("u10", "v10")), F.lit(0.0)) if wind else F.lit(0.0)
    vector = F.hypot(F.coalesce(F.avg("u10"), F.lit(0.0)), F.coalesce(F.avg("v10"), F.lit(0.0))) if wind else F.lit(0.0)
    qa = F.coalesce(F.min(F.when(seen, F.col("qa_value"))), F.lit(0.0)) if "qa_value" in pixels.columns else F.lit(0.0)
    lat = F.abs(F.coalesce(F.avg(lat_center), F.lit(0.0))) if lat_center else F.lit(0.0)
    base = px.groupBy(*key).agg(
        n.alias("n_valid"), (n / F.count(F.lit(1))).alias("valid_frac"),
        F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("xch4_std"),
        F.coalesce(F.max("value") - F.min("value"), F.lit(0.0)).alias("xch4_ptp"),
        F.coalesce(F.max(F.when(seen, F.col("norm"))), F.lit(0.0)).alias("norm_max"),
        (F.count_if(high) / F.greatest(n, F.lit(1))).alias("frac_high"),
        speed.alias("wind_speed_mean"), F.when(speed > 1e-3, vector / speed).otherwise(0.0).alias("wind_coherence"),
        mean("chi2").alias("chi2_mean"), qa.alias("qa_min"), mean("aot_swir").alias("aot_swir_mean"),
        mean("albedo_swir").alias("albedo_swir_mean"), mean("cloud_frac").alias("cloud_frac_mean"), lat.alias("abs_lat_center"),
    )
    blobs = blob_shape(px.where(high & seen).select(*key, "row", "col"), key, base.select(*key, "n_valid"))
    return base.join(blobs, key).select(*key, *FEATURE_NAMES)


def feature_table(features: DataFrame, labels: DataFrame, key: list[str], label: str = "label") -> DataFrame:
    """Features of labelled scenes with ``y`` = 1 for plumes."""
    return features.join(labels, key).withColumn("y", (F.col(label) == "plume").cast("int")).drop(label)


def augment_dihedral(pixels: DataFrame, key: list[str], size: int, seed: int, epoch: Column | int) -> DataFrame:
    """One keyed flip and quarter-turn combination per scene and epoch, as coordinate arithmetic."""
    e = epoch if isinstance(epoch, Column) else F.lit(epoch)
    scene = F.concat_ws("_", *key)
    choice = pick(F.lit(16), F.lit(seed), scene, e)
    turn, flip_r, flip_c = choice % 4, F.floor(choice / 4) % 2, F.floor(choice / 8) % 2
    last = size - 1
    r = F.when(flip_r == 1, last - F.col("row")).otherwise(F.col("row"))
    c = F.when(flip_c == 1, last - F.col("col")).otherwise(F.col("col"))
    row = F.when(turn == 0, r).when(turn == 1, last - c).when(turn == 2, last - r).otherwise(c)
    col = F.when(turn == 0, c).when(turn == 1, r).when(turn == 2, last - c).otherwise(last - r)
    return pixels.withColumn("_row", row.cast("int")).withColumn("_col", col.cast("int")).drop("row", "col").withColumnsRenamed(
        {"_row": "row", "_col": "col"}
    )


def hash_split(df: DataFrame, id_col: str, seed: int, holdout: float = 0.15) -> DataFrame:
    """Add ``is_holdout`` by a keyed draw per row; no shuffle."""
    return df.withColumn("is_holdout", uniform(F.lit(seed), id_col) < holdout)


def stratified_split(df: DataFrame, id_col: str, label: str, seed: int, holdout: float = 0.15) -> DataFrame:
    """Add ``is_holdout``: the same share of every label, chosen by keyed order."""
    keyed = df.withColumn("_h", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(id_col).cast("string"))))
    ranked = row_numbers(keyed, [F.col("_h"), F.col(id_col)], "_rank", [label])
    sizes = df.groupBy(label).agg(F.round(F.count(F.lit(1)) * holdout).alias("_take"))
    return ranked.join(F.broadcast(sizes), label).withColumn("is_holdout", F.col("_rank") <= F.col("_take")).drop("_h", "_rank", "_take")


@dataclass(frozen=True)
class Stage:
    """One stage of a detector: a probability and the least value that passes.

    ``score`` is an expression over ``FEATURE_NAMES``, or over ``pixels`` (the
    window's normalised pixels in raster order, missing ones 0) where ``pixels`` is set.
    """

    score: Column
    threshold: float = 0.5
    pixels: bool = False


def logistic_stage(beta: np.ndarray, threshold: float = 0.5) -> Stage:
    """Stage of a fitted model over the window's pixels; the last coefficient is the constant's."""
    weights = F.array(*[F.lit(float(v)) for v in beta])
    dot = F.aggregate(F.zip_with(F.concat("pixels", F.array(F.lit(1.0))), weights, lambda x, v: x * v), F.lit(0.0), lambda a, v: a + v)
    return Stage(1.0 / (1.0 + F.exp(-dot)), threshold, True)


def run_detector(
    pixels: DataFrame, shape: DataFrame, key: list[str], stages: dict[str, Column | Stage], *, window: int = 32, stride: int = 16,
    min_finite: int = 64, threshold: float = 0.5, context: bool = False, lat_center: str | None = None,
) -> DataFrame:
    """Score overlapping tiles in a cascade: a stage sees the tiles alone that the stages before it keep.

    ``stages`` maps names to stages in order; a bare expression passes at
    ``threshold``. ``context`` must be True when a stage uses context features, and the context columns present.
    """
    if not stages:
        raise ValueError("a detector needs at least one stage")
    if context and not {"u10", "v10"} <= set(pixels.columns):
        raise ValueError("a context stage needs the context columns it was trained with")
    tiles = tile_windows(pixels, shape, key, window, stride)
    tkey = [*key, "r0", "c0"]
    enough = tiles.groupBy(*tkey).agg(F.count("value").alias("_n")).where(F.col("_n") >= min_finite).drop("_n")
    tiles = materialize(scene_normalize(tiles.join(enough, tkey, "left_semi"), tkey), "scan-tiles")
    kept: DataFrame | None = None
    for name, stage in stages.items():
        stage = stage if isinstance(stage, Stage) else Stage(stage, threshold)
        seen = tiles if kept is None else tiles.join(kept.select(*tkey), tkey, "left_semi")
        if stage.pixels:
            # A window's pixels are bounded by its size.
            norm = F.when(F.col("value").isNotNull(), F.col("norm")).otherwise(0.0)
            raster = F.array_sort(F.collect_list(F.struct("row", "col", F.coalesce(norm, F.lit(0.0)).alias("v"))))
            inputs = seen.groupBy(*tkey).agg(F.transform(raster, lambda p: p["v"]).alias("pixels"))
        else:
            inputs = scene_features(seen, tkey, lat_center)
        scored = inputs.select(*tkey, stage.score.alias(f"{name}_prob")).where(F.col(f"{name}_prob") >= stage.threshold)
        kept = materialize(scored if kept is None else kept.join(scored, tkey), "kept-tiles")
    probs = [F.col(f"{n}_prob") for n in stages]
    score = probs[0] if len(probs) == 1 else F.least(*probs)
    norm = tiles.where((F.col("norm") > HIGH) & F.col("value").isNotNull()).join(kept.select(*tkey), tkey, "left_semi")
    centre = norm.groupBy(*tkey).agg(F.avg("row").alias("_r"), F.avg("col").alias("_c"))
    half = window / 2
    return kept.join(centre, tkey, "left").select(
        *tkey, F.coalesce("_r", F.col("r0") + half).alias("row"), F.coalesce("_c", F.col("c0") + half).alias("col"),
        score.alias("score"), *[f"{n}_prob" for n in stages],
    )


def train_stage1(samples: DataFrame, width: int, seeds=(0, 1, 2), positive_weight: float = 2.0, holdout: float = 0.15) -> tuple[dict[int, np.ndarray], DataFrame]:
    """Weighted logistic model on normalised scene pixels, one fit per seed: ``(coefficients, holdout scores)``.

    ``samples``: ``id, pixels array<double>, y`` with ``width`` pixels. All seeds
    share the passes of ``newton_logistic``; only cross products visit the driver.
    """
    x = F.concat("pixels", F.array(F.lit(1.0)))
    weight = F.when(F.col("y") == 1, positive_weight).otherwise(1.0)
    every = reduce(DataFrame.unionByName, [
        hash_split(samples, "id", s, holdout).select(F.lit(s).alias("g"), x.alias("x"), "y", weight.alias("w"), "is_holdout") for s in seeds
    ])
    every = materialize(every, "stage1")
    found = newton_logistic(every.where("not is_holdout"), width + 1)

    def score(g: pa.Array, x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy().reshape(len(g), -1)
        beta = np.stack([found[k] for k in g.to_pylist()]) if len(g) else rows
        return pa.array(1 / (1 + np.exp(-(rows * beta).sum(1))))

    held = every.where("is_holdout").select(F.col("g").alias("seed"), "y", F.arrow_udf(score, "double")("g", "x").alias("p"))
    mean = held.groupBy("seed").agg(F.avg("p").alias("mean_p"))
    return found, binary_scores(held, ["seed"]).join(mean, "seed")


@dataclass(frozen=True)
class MarginModel:
    """Standardised inputs, random Fourier map, margin and sigmoid: a bounded set of numbers."""

    columns: list[str]
    mean: list[float]
    scale: list[float]
    frequency: np.ndarray
    phase: np.ndarray
    beta: np.ndarray | None = None
    slope: float = 1.0
    intercept: float = 0.0

    def inputs(self) -> Column:
        """The map's values and the constant one as an array."""
        parts = []
        for w, b in zip(self.frequency, self.phase):
            dot = F.lit(float(b))
            for c, v, m, s in zip(self.columns, w, self.mean, self.scale):
                dot = dot + (F.col(c) - m) / s * float(v)
            parts.append(F.cos(dot) * float(np.sqrt(2.0 / len(self.phase))))
        return F.array(*parts, F.lit(1.0))

    def prob(self) -> Column:
        """Probability of class 1 over the feature columns, as one expression."""
        beta = F.array(*[F.lit(float(v)) for v in self.beta])
        margin = F.aggregate(F.zip_with(self.inputs(), beta, lambda x, v: x * v), F.lit(0.0), lambda a, v: a + v)
        return 1.0 / (1.0 + F.exp(-(margin * self.slope + self.intercept)))


def fourier_map(columns: list[str], mean: list[float], scale: list[float], n: int, seed: int) -> MarginModel:
    """An RBF kernel of width 1 / number of columns, in expectation."""
    rng = np.random.default_rng(seed)
    frequency = rng.normal(0.0, np.sqrt(2 / len(columns)), (n, len(columns)))
    return MarginModel(columns, mean, scale, frequency, rng.uniform(0, 2 * np.pi, n))


def train_stage2(
    table: DataFrame, id_col: str, columns: list[str] = FEATURE_NAMES, seed: int = 0, c_values=(1.0, 10.0, 100.0), folds: int = 5,
    n_map: int = 32, holdout: float = 0.15,
) -> tuple[MarginModel, DataFrame]:
    """Balanced squared-margin classifier on a random Fourier map with sigmoid calibration: ``(model, metrics)``.

    ``metrics`` has one row per C with its cross-validated F1 and the chosen
    model's holdout scores. Statistics are summed once per fold; every fold and C is fitted from their differences.
    """
    spark = table.sparkSession
    split = materialize(stratified_split(table, id_col, "y", seed, holdout), "stage2")
    train = split.where("NOT is_holdout")
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns], F.avg("y").alias("rate")).first()
    base = fourier_map(columns, [stats[f"m_{c}"] for c in columns], [stats[f"s_{c}"] or 1.0 for c in columns], n_map, seed)
    balance = F.when(F.col("y") == 1, 0.5 / stats["rate"]).otherwise(0.5 / (1 - stats["rate"]))
    fold = pick(F.lit(folds), F.lit(seed), F.lit("fold"), id_col).cast("int")
    ready = materialize(train.select(fold.alias("g"), base.inputs().alias("x"), "y", balance.alias("w")), "stage2-map")
    sums = margin_sums(ready)
    fits = {(i, f): margin_fit(sums, c, f) for i, c in enumerate(c_values) for f in range(folds)}

    def margins(g: pa.Array, x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy().reshape(len(g), -1)
        each = [np.stack([fits[i, f] for f in g.to_pylist()]) if len(g) else rows for i in range(len(c_values))]
        return pa.array([list(r) for r in zip(*[(rows * b).sum(1) for b in each])], pa.list_(pa.float64()))

    held = materialize(ready.select("g", "y", F.arrow_udf(margins, "array<double>")("g", "x").alias("m")), "stage2-margins")
    scores = binary_scores(held.select("g", "y", F.posexplode("m").alias("c", "margin")), ["c", "g"], prob="margin", cut=0.0)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    mean = {r["c"]: r["f"] for r in scores.groupBy("c").agg(F.avg(f1).alias("f")).collect()}
    best = max(range(len(c_values)), key=lambda i: mean[i])
    sigmoid = newton_logistic(held.select(F.lit(0).alias("g"), F.array(F.col("m")[best], F.lit(1.0)).alias("x"), "y", F.lit(1.0).alias("w")), 2)[0]
    model = replace(base, beta=margin_fit(sums, c_values[best]), slope=float(sigmoid[0]), intercept=float(sigmoid[1]))
    hold = binary_scores(split.where("is_holdout").withColumn("prob", model.prob()).withColumn("g", F.lit(1)), ["g"], prob="prob").drop("g")
    metrics = spark.createDataFrame([(c, mean[i], i == best) for i, c in enumerate(c_values)], "c double, cv_f1 double, chosen boolean")
    return model, metrics.crossJoin(hold)
