"""Agreement statistics: precision and recall, ROC, block bootstrap, kappa, rates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bits32
from ..functions.policy import power_branch
from ..session import materialize
from .greedy import Reach, cluster_events, count_clusters
from .matching import match_events
from .ranking import exact_quantiles, running_total
from .spatial import basin_assign

#: Picks of one block in ``cluster_bootstrap``.
PICK_BLOCK = 1 << 17
#: Cluster distance factors and windows in days under which an agreement study is repeated.
FACTORS, WINDOWS = (0.5, 1.0, 1.5), (7, 14, 21)
# Sentence carried by every agreement report, and the note on its branch.
DUAL_MODE_SENTENCE = (
    "Strict mode benchmarks against operational human curation; lenient mode "
    "estimates the algorithmic ceiling; the strict-lenient gap is itself our "
    "quantification of curation effect."
)
BRANCH_NOTE = " (robustness: %d/%d combos land in 'full' branch)"
FULL_BRANCH = 30


def precision_recall(tp: Column, n_predicted: Column, n_actual: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, f1); undefined values are NULL, never zero."""
    p, r = F.try_divide(tp, n_predicted), F.try_divide(tp, n_actual)
    return p, r, F.try_divide(2.0 * p * r, p + r)


def roc_curve(scored: DataFrame, score: str = "score", truth: str = "is_true") -> DataFrame:
    """``threshold, tpr, fpr`` for every distinct score, from high to low."""
    steps = scored.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(truth)).alias("t"), F.count_if(~F.col(truth)).alias("f")
    )
    cum = running_total(steps, [F.col("threshold").desc()], {"tp": F.col("t"), "fp": F.col("f")})
    total = steps.agg(F.sum("t").alias("pos"), F.sum("f").alias("neg"))
    return cum.crossJoin(F.broadcast(total)).select(
        "threshold", F.try_divide("tp", "pos").alias("tpr"), F.try_divide("fp", "neg").alias("fpr")
    )


def cluster_bootstrap(
    clusters: DataFrame, draws: int = 2000, seed: int = 20270307, group: list[str] | None = None,
    low: float = 0.025, high: float = 0.975,
) -> DataFrame:
    """Percentile interval of sum(tp)/sum(n) over resampled clusters.

    ``clusters`` has one row per cluster: the group keys, ``cluster``, ``n``
    and ``tp``. Each draw picks as many clusters as there are, with picks keyed
    by seed, draw and slot, so the result does not depend on partitioning.
    Clusters are ordered by (n, tp), so a pick is looked up in a step function
    with a step per distinct pair. A task's row is a block of about
    ``PICK_BLOCK`` picks, of several draws or of a part of one; no pick is shuffled.
    The steps travel as plain arrays and a task takes one row at a time from its batch.
    """
    group = group or []
    steps = clusters.groupBy(*group, "n", "tp").agg(F.count(F.lit(1)).alias("c"))
    table = steps.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct(F.col("n").cast("long").alias("n"), F.col("tp").cast("long").alias("tp"), "c"))).alias("steps"), F.sum("c").alias("k")
    ).withColumn("per", F.greatest(F.lit(1).cast("long"), F.floor(F.lit(PICK_BLOCK) / F.col("k"))))
    flat = table.select(*group, "k", "per", *[F.col(f"steps.{f}").alias(f"_{f}") for f in ("n", "tp", "c")])
    blocks = flat.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"), "per"))).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("k") - 1) / PICK_BLOCK)))
    )
    schema = table.select(*group).schema.add("draw", "long").add("n", "long").add("tp", "long")

    def sums(batches):
        for b in batches:
            names = b.schema.names
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                n, tp, c = (one[f].flatten().to_numpy() for f in ("_n", "_tp", "_c"))
                draw, per, block, k = (one[f][0].as_py() for f in ("draw", "per", "block", "k"))
                own = np.arange(draw, min(draws, draw + per), dtype=np.uint64)
                slots = np.arange(block * PICK_BLOCK, min(k, (block + 1) * PICK_BLOCK), dtype=np.uint64)
                picks = bits32(seed, own[:, None], slots) % np.uint64(k)
                at = np.searchsorted(np.cumsum(c).astype(np.uint64), picks, "right")
                keys = [one.column(names.index(g)).take(pa.array(np.zeros(len(own), np.int64))) for g in group]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(x.astype(np.int64)) for x in (own, n[at].sum(1), tp[at].sum(1)))], names=[*group, "draw", "n", "tp"])

    # A row is much work and few bytes, so partitions must not be put together by their size.
    spread = blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group, "draw", "block")
    shares = spread.mapInArrow(sums, schema).groupBy(*group, "draw").agg((F.sum("tp") / F.sum("n")).alias("_share"))
    return shares.groupBy(*group).agg(
        F.percentile("_share", F.lit(low)).alias("ci_low"), F.percentile("_share", F.lit(high)).alias("ci_high")
    )


def agreement_study(
    detections: DataFrame, references: DataFrame, *, radius_km: float = 25.0, window_days: int = 3,
    cluster_km: float = 25.0, cluster_days: int = 14, draws: int = 2000, seed: int = 20270307,
    factors=FACTORS, windows=WINDOWS,
) -> DataFrame:
    """One row per reference ``mode``: matches, precision, recall, cluster intervals and power branch.

    ``references`` carries a ``mode`` column; both modes go through every
    step together. ``sensitivity`` has the number of reference clusters under
    every factor and window, in that order (``sensitivity_table`` gives them as
    rows); ``branch`` says how many of them reach the full branch.
    """
    modes = references.select("mode").distinct()
    det = detections.select("id", "date", "lon", "lat").crossJoin(F.broadcast(modes))
    ref = references.select("mode", "id", "date", "lon", "lat")
    matches = materialize(match_events(det, ref, radius_km, window_days, ["mode"]), "matches")
    # Detections are the same in every mode, so are their clusters.
    det_clusters = cluster_events(detections.select("id", "date", "lon", "lat"), cluster_km, cluster_days, number=False).crossJoin(F.broadcast(modes))
    clustered = det_clusters.withColumn("side", F.lit("det")).unionByName(
        cluster_events(ref, cluster_km, cluster_days, ["mode"], number=False).withColumn("side", F.lit("ref"))
    )
    used = matches.select("mode", F.lit("det").alias("side"), F.col("det_id").alias("id")).unionByName(
        matches.select("mode", F.lit("ref").alias("side"), F.col("ref_id").alias("id"))
    ).withColumn("hit", F.lit(1))
    per_cluster = materialize(
        clustered.join(used, ["mode", "side", "id"], "left")
        .groupBy("mode", "side", F.col("anchor_id").alias("cluster"))
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("tp")),
        "per-cluster",
    )
    ci = cluster_bootstrap(per_cluster, draws, seed, ["mode", "side"])
    totals = per_cluster.groupBy("mode", "side").agg(
        F.sum("n").alias("n"), F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("k")
    ).join(ci, ["mode", "side"])

    def of(side, col):
        return F.max(F.when(F.col("side") == side, F.col(col)))

    wide = totals.groupBy("mode").agg(
        of("det", "n").alias("n_det"), of("ref", "n").alias("n_ref"), of("ref", "tp").alias("n_matched"),
        of("det", "k").alias("n_det_clusters"), of("ref", "k").alias("n_ref_clusters"),
        of("det", "ci_low").alias("precision_low"), of("det", "ci_high").alias("precision_high"),
        of("ref", "ci_low").alias("recall_low"), of("ref", "ci_high").alias("recall_high"),
    )
    grid = cluster_grid(ref, cluster_km, cluster_days, factors, windows, ["mode"]).groupBy("mode").agg(
        F.array_sort(F.collect_list(F.struct("cluster_dist_factor", "cluster_window_days", "n_ref_clusters"))).alias("sensitivity")
    )
    full = F.size(F.filter("sensitivity", lambda s: s["n_ref_clusters"] >= FULL_BRANCH))
    note = F.format_string(BRANCH_NOTE, full, F.size("sensitivity"))
    p, r, f1 = precision_recall(F.col("n_matched"), F.col("n_det"), F.col("n_ref"))
    return wide.join(grid, "mode").select(
        "*", p.alias("precision"), r.alias("recall"), f1.alias("f1"),
        F.concat(power_branch("n_ref_clusters"), note).alias("branch"), F.lit(DUAL_MODE_SENTENCE).alias("interpretation"),
    )


def sensitivity_table(study: DataFrame) -> DataFrame:
    """The rows of ``sensitivity`` of every mode with its precision and recall, which do not depend on the setting."""
    return study.select("mode", F.explode("sensitivity").alias("s"), "precision", "recall").select("mode", "s.*", "precision", "recall")


def agreement_sensitivity(
    detections: DataFrame, references: DataFrame, *, radius_km: float = 25.0, window_days: int = 3,
    cluster_km: float = 25.0, cluster_days: int = 14, factors=FACTORS, windows=WINDOWS,
) -> DataFrame:
    """``sensitivity_table`` of the study without its intervals, which need clusters of detections and a bootstrap."""
    modes = references.select("mode").distinct()
    det = detections.select("id", "date", "lon", "lat")
    ref = references.select("mode", "id", "date", "lon", "lat")
    tp = match_events(det.crossJoin(F.broadcast(modes)), ref, radius_km, window_days, ["mode"]).groupBy("mode").agg(F.count(F.lit(1)).alias("tp"))
    n = ref.groupBy("mode").agg(F.count(F.lit(1)).alias("nr")).join(tp, "mode", "left").crossJoin(det.agg(F.count(F.lit(1)).alias("nd")))
    p, r, _ = precision_recall(F.coalesce("tp", F.lit(0)), F.col("nd"), F.col("nr"))
    grid = cluster_grid(ref, cluster_km, cluster_days, factors, windows, ["mode"])
    return grid.join(n, "mode").select("mode", "cluster_dist_factor", "cluster_window_days", "n_ref_clusters", p.alias("precision"), r.alias("recall"))


def strict_lenient_gap(study: DataFrame) -> DataFrame:
    """Lenient minus strict precision and recall."""
    wide = study.groupBy().pivot("mode", ["strict", "lenient"]).agg(
        F.first("precision").alias("p"), F.first("recall").alias("r")
    )
    return wide.select(
        (F.col("lenient_p") - F.col("strict_p")).alias("precision_gap"),
        (F.col("lenient_r") - F.col("strict_r")).alias("recall_gap"),
    )


def cluster_grid(
    events: DataFrame, cluster_km: float, cluster_days: int, factors=FACTORS, windows=WINDOWS, group: list[str] | None = None,
) -> DataFrame:
    """``n_ref_clusters`` for every factor and window (and group); all settings are settled in the same rounds."""
    group = group or []
    settings, labels = [], []
    for f in factors:
        for w in windows:
            days = max(int(cluster_days * w / 14), 1)
            # Named by number: two windows may round to the same days.
            settings.append(Reach(cluster_km * f, days, str(len(labels))))
            labels.append((str(len(labels)), float(f), days))
    counts = count_clusters(events, settings, group)
    grid = events.sparkSession.createDataFrame(labels, "setting string, cluster_dist_factor double, cluster_window_days int")
    # A group without events has no row in the counts; it has no clusters.
    listed = grid.crossJoin(events.select(*group).distinct()) if group else grid
    return listed.join(counts, [*group, "setting"], "left").select(
        *group, "cluster_dist_factor", "cluster_window_days", F.coalesce("n_clusters", F.lit(0)).alias("n_ref_clusters")
    )


def sensitivity_grid(
    detections: DataFrame, reference: DataFrame, *, radius_km: float = 25.0, window_days: int = 3,
    cluster_km: float = 25.0, cluster_days: int = 14, factors=FACTORS, windows=WINDOWS,
) -> DataFrame:
    """Reference clusters under nine settings; precision and recall do not depend on them."""
    counts = cluster_grid(reference, cluster_km, cluster_days, factors, windows)
    m = match_events(detections, reference, radius_km, window_days).agg(F.count(F.lit(1)).alias("tp"))
    nd = detections.agg(F.count(F.lit(1)).alias("nd"))
    nr = reference.agg(F.count(F.lit(1)).alias("nr"))
    p, r, _ = precision_recall(F.col("tp"), F.col("nd"), F.col("nr"))
    pr = m.crossJoin(nd).crossJoin(nr).select(p.alias("precision"), r.alias("recall"))
    return counts.crossJoin(pr)


def full_branch_combos(grid: DataFrame, full: int = FULL_BRANCH) -> DataFrame:
    """How many of the settings reach the full power branch."""
    return grid.agg(F.count_if(F.col("n_ref_clusters") >= full).alias("n_full"))


def power_assessment(events: DataFrame, basins: DataFrame, km: float = 25.0, days: int = 14) -> DataFrame:
    """Events and clusters per basin, and the pooled champion set with its branch."""
    placed = basin_assign(events, basins).select("basin", "role", "id", "date", "lon", "lat")
    pooled = placed.where("role = 'champion'").withColumn("basin", F.lit("CHAMPION SET"))
    both = placed.unionByName(pooled)
    n = both.groupBy("basin", "role").agg(F.count(F.lit(1)).alias("n_events"))
    k = count_clusters(both, [Reach(km, days)], ["basin"]).drop("setting")
    return n.join(k, "basin").select("*", power_branch("n_clusters").alias("branch"))


def cohen_kappa(pairs: DataFrame, a: str, b: str, group: list[str] | None = None) -> DataFrame:
    """Chance-corrected agreement; missing labels agree with nothing but count in n. Fails without pairs."""
    group = group or []
    n = pairs.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce((F.col(a) == F.col(b)).cast("double"), F.lit(0.0))).alias("po"),
    )
    # One scan gives both marginals.
    sides = F.explode(F.array(
        F.struct(F.lit("a").alias("s"), F.col(a).alias("c")), F.struct(F.lit("b").alias("s"), F.col(b).alias("c"))
    ))
    marg = (
        pairs.select(*group, sides.alias("x")).where(F.col("x.c").isNotNull())
        .groupBy(*group, F.col("x.c").alias("c"))
        .agg(F.count_if(F.col("x.s") == "a").alias("na"), F.count_if(F.col("x.s") == "b").alias("nb"))
        .groupBy(*group).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("_cross"))
    )
    joined = n.join(marg, group) if group else n.crossJoin(marg)
    pe = F.col("_cross") / (F.col("n").cast("double") * F.col("n"))
    kappa = F.when(
        F.abs(1.0 - pe) < 1e-12, F.when(F.col("po") > 1 - 1e-12, 1.0).otherwise(0.0)
    ).otherwise((F.col("po") - pe) / (1.0 - pe))
    kappa = F.when(F.col("n") == 0, F.raise_error("no pairs to compare").cast("double")).otherwise(kappa)
    return joined.select(*group, "n", "po", pe.alias("pe"), kappa.alias("kappa"))


def control_hit_rate(labels: DataFrame, queue: DataFrame, positive: str = "real_plume") -> DataFrame:
    """Share of hidden controls labelled positive, with the recalibration flag; fails without labelled controls."""
    controls = queue.where("is_control").select("id")
    rate = F.avg(F.coalesce((F.col("pass2_final") == positive).cast("double"), F.lit(0.0)))
    hit = labels.join(controls, "id", "left_semi").agg(F.count(F.lit(1)).alias("n_controls"), rate.alias("hit_rate"))
    some = F.when(F.col("n_controls") == 0, F.raise_error("no labelled controls").cast("double")).otherwise(F.col("hit_rate"))
    return hit.select("n_controls", some.alias("hit_rate")).select("*", (F.col("hit_rate") < 0.85).alias("recalibrate"))


def fp_rates(ratings: DataFrame) -> DataFrame:
    """False-positive share by batch and rater with all subtotals; input ``batch, rater, is_fp``.

    ``all_batches`` and ``all_raters`` tell a subtotal from a missing name.
    """
    return ratings.cube("batch", "rater").agg(
        (F.grouping("batch") == 1).alias("all_batches"), (F.grouping("rater") == 1).alias("all_raters"),
        F.count(F.lit(1)).alias("n"), F.avg(F.col("is_fp").cast("double")).alias("fp_rate")
    )


def binary_scores(pred: DataFrame, group: list[str], prob: str = "p", label: str = "y", cut: float = 0.5) -> DataFrame:
    hit = F.col(prob) >= cut
    true = F.col(label) == 1
    c = pred.groupBy(*group).agg(
        F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn")
    )
    return c.select(
        "*", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"),
    )


def seed_spread(scores: DataFrame) -> DataFrame:
    """Mean and population deviation over seeds; undefined scores are skipped."""
    return scores.agg(
        F.avg("precision").alias("precision_mean"), F.stddev_pop("precision").alias("precision_std"),
        F.avg("recall").alias("recall_mean"), F.stddev_pop("recall").alias("recall_std"),
    )


def wind_rose(winds: DataFrame, month: int, site: str = "site") -> DataFrame:
    """Mean speed and modal 30-degree sector per site for one calendar month."""
    sector = F.pmod(F.floor(F.col("direction_from") / 30), F.lit(12)).cast("int")
    per_sector = (
        winds.where(F.month("time") == month)
        .groupBy(site, sector.alias("sector"))
        .agg(F.count(F.lit(1)).alias("c"), F.sum("speed").alias("s"))
    )
    return per_sector.groupBy(site).agg(
        F.round(F.sum("s") / F.sum("c"), 3).alias("mean_speed_ms"),
        (F.max(F.struct("c", (-F.col("sector")).alias("m")))["m"] * -30.0 + 15.0).alias("modal_direction_deg"),
        F.sum("c").alias("n_samples"),
    )


def expected_counts(detections: DataFrame, rates: DataFrame, clear: DataFrame) -> DataFrame:
    """Clear-sky share times historical rate against observed counts per basin."""
    seen = detections.groupBy("basin").agg(F.count(F.lit(1)).alias("observed"))
    expected = F.col("clear_share") * F.col("historical_rate")
    return rates.join(clear, "basin").join(seen, "basin", "left").select(
        "basin", expected.alias("expected"), F.coalesce("observed", F.lit(0)).alias("observed"),
        F.greatest(expected - F.coalesce("observed", F.lit(0)), F.lit(0.0)).alias("deficit"),
    )


def target_rates(truth: DataFrame, catalog: DataFrame, basins: DataFrame) -> DataFrame:
    """Published rates the study aims at: metered releases and the catalog per basin.

    A basin may hold most of the catalog, so medians come from ranked counts.
    """
    metered = truth.where((F.col("kind") == "release") & (F.col("kg_h") > 0)).select(
        F.lit("metered").alias("basin"), (F.col("kg_h") / 1000.0).alias("rate")
    )
    listed = basin_assign(catalog.where(F.col("rate_t_h").isNotNull()), basins).select(
        "basin", F.col("rate_t_h").alias("rate")
    )
    return exact_quantiles(
        metered.unionByName(listed), ["basin"], "rate", {"low": 0.0, "median": 0.5, "high": 1.0}
    )
