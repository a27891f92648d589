"""Labelling queues: hidden controls, keyed order, manifest hash, subsampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashtree import FAN, tree_roots
from .ranking import row_numbers


def render_pack(candidates: DataFrame, controls: DataFrame, seed: int = 20270307) -> DataFrame:
    """Queue ``position, id, is_control`` in a keyed order that hides the controls."""
    mixed = candidates.select("id", F.lit(False).alias("is_control")).unionByName(
        controls.select("id", F.lit(True).alias("is_control"))
    ).groupBy("id").agg(F.max("is_control").alias("is_control"))
    keyed = mixed.withColumn("_h", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"))))
    return row_numbers(keyed, [F.col("_h"), F.col("id")], "position").select("position", "id", "is_control")


def pack_hash(queue: DataFrame, fan: int = FAN) -> DataFrame:
    """Sixteen hex digits of a hash tree over the ordered queue, so no row holds more than ``fan`` entries."""
    entry = F.concat_ws(":", "position", F.col("id").cast("string"), F.col("is_control").cast("string"))
    leaves = queue.select((F.col("position") - 1).alias("at"), F.sha2(entry, 256).alias("hash"))
    return tree_roots(leaves, [], fan).select("n", F.substring("root", 1, 16).alias("pack_sha256"))


def label_subsample(ids: DataFrame, size: int = 150, when_over: int = 300, seed: int = 20270307) -> DataFrame:
    """A keyed subsample of ``size`` once there are more than ``when_over`` candidates."""
    keyed = ids.select("id", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"))).alias("_h"))
    total = keyed.agg(F.count(F.lit(1)).alias("_n"))
    ranked = row_numbers(keyed, [F.col("_h"), F.col("id")], "_rank").crossJoin(F.broadcast(total))
    return ranked.where((F.col("_n") <= when_over) | (F.col("_rank") <= size)).select("id")


def cue_log(decisions: DataFrame, target: str) -> None:
    """Append every decision with its counterfactuals as JSON lines."""
    decisions.withColumn("det_date", F.date_format("det_date", "yyyy-MM-dd")).write.mode("append").json(target)
