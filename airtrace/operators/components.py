"""Connected components.

``graph_components`` is the distributed primitive (partition-local contraction,
then large-star and small-star rounds on edge tables). ``pixel_components`` labels masks: each tile
of at most ``tile*tile`` pixels is labelled in one task, and only label pairs
that touch across tile borders enter the distributed step, so the size of a
scene or of a component never decides the size of a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import discard, materialize

TILE = 256
# Tiles start this far outside the raster, so that padding around a scene stays in its first tile.
MARGIN = 2
HALF4 = [(0, 1), (1, 0)]
HALF8 = [(0, 1), (1, 0), (1, 1), (1, -1)]


def graph_components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` with label = smallest node of the component; edges are ``(a, b)`` pairs.

    One path for every size: each partition first replaces its edges by stars
    around its local minima, then large-star and small-star rounds run on edge
    tables until a round changes nothing. No round holds more edges than the
    one before it, and grouped minima combine before the shuffle.
    """
    kind = edges.schema["a"].dataType
    schema = StructType([StructField("a", kind), StructField("b", kind)])
    given = materialize(edges.select("a", "b"), "edges")
    stars = materialize(given.mapInPandas(_local_stars, schema).distinct(), "stars")
    mark = _fingerprint(stars)
    while True:
        both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        sym = stars.select(both.alias("e")).select("e.a", "e.b")
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sym.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "stars")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(low, "a").select(F.explode(pair).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        small = materialize(small, "stars")
        discard(stars)
        discard(large)
        stars, before, mark = small, mark, _fingerprint(small)
        if mark == before:
            break
    nodes = given.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(stars.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select(
        "node", F.coalesce("label", "node").alias("label")
    )


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _local_stars(frames):
    """Union-find over one partition's edges; yields each node with its local minimum."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for pdf in frames:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            ra, rb = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
            if ra < rb:
                parent[rb] = ra
            elif rb < ra:
                parent[ra] = rb
    nodes = [x for x in parent if parent[x] != x]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pd.DataFrame({"a": part, "b": [root(x) for x in part]})


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index per node, for the bounded graph inside one task."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def pixel_components(
    mask: DataFrame, key: list[str], eight: bool = False, tile: int = TILE, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``label`` = ``row<<32 | col`` of the component's first pixel in raster order.

    ``mask`` holds one row per true pixel: the ``key`` columns, ``row``, ``col``
    and any columns to ``carry`` along.
    """
    offsets = HALF8 if eight else HALF4

    where = [*key, "_tr", "_tc"]
    width = 2 * tile + 2

    def label_tiles(pdf: pd.DataFrame) -> pd.DataFrame:
        """Label all complete tiles of a frame at once; the padded code keeps tiles and rows apart."""
        row, col = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
        group = pdf.groupby(where, sort=False).ngroup().to_numpy(np.int64)
        code = (group * width + (row + MARGIN) % tile + 1) * width + (col + MARGIN) % tile + 1
        order = np.argsort(code)
        ordered = code[order]
        starts, ends = [], []
        for dr, dc in offsets:
            want = ordered + dr * width + dc
            at = np.minimum(np.searchsorted(ordered, want), len(code) - 1)
            hit = ordered[at] == want
            starts.append(np.flatnonzero(hit))
            ends.append(at[hit])
        root = min_labels(len(code), np.concatenate(starts), np.concatenate(ends))
        label = np.empty(len(code), np.int64)
        label[order] = ((row << 32) + col)[order][root]
        return pdf.assign(label=label)

    def label_stream(frames):
        """Sorted tiles arrive in frames; only a tile still being read is held back."""
        held = None
        for pdf in frames:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            same = np.ones(len(pdf), bool)
            for c in where:
                same &= (pdf[c] == pdf[c].iloc[-1]).to_numpy()
            first = int(same.argmax())
            held = pdf.iloc[first:]
            if first:
                yield label_tiles(pdf.iloc[:first])
        if held is not None and len(held):
            yield label_tiles(held)

    base = mask.select(
        *key, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *carry
    )
    tiled = base.withColumn("_tr", F.floor((F.col("row") + MARGIN) / tile).cast("int")).withColumn(
        "_tc", F.floor((F.col("col") + MARGIN) / tile).cast("int")
    )
    schema = StructType([*tiled.schema.fields, StructField("label", LongType())])
    arranged = tiled.repartition(*where).sortWithinPartitions(*where)
    local = materialize(arranged.mapInPandas(label_stream, schema), "tiles")

    rim = F.pmod(F.col("row") + MARGIN, F.lit(tile)).isin(0, tile - 1) | F.pmod(
        F.col("col") + MARGIN, F.lit(tile)
    ).isin(0, tile - 1)
    border = local.where(rim)
    node = F.to_json(F.struct(*key, "label"))
    here = border.select(*key, "row", "col", "_tr", "_tc", node.alias("_na"))
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in offsets])
    there = here.withColumn("_step", F.explode(steps)).select(
        *key, (F.col("row") + F.col("_step.dr")).alias("row"), (F.col("col") + F.col("_step.dc")).alias("col"),
        F.col("_tr").alias("_tr2"), F.col("_tc").alias("_tc2"), F.col("_na").alias("_nb"),
    )
    edges = (
        here.join(there, [*key, "row", "col"])
        .where((F.col("_tr") != F.col("_tr2")) | (F.col("_tc") != F.col("_tc2")))
        .select(F.col("_na").alias("a"), F.col("_nb").alias("b"))
        .distinct()
    )
    local = local.drop("_tr", "_tc")
    if edges.isEmpty():
        return local
    merged = graph_components(edges)
    return (
        local.withColumn("_node", node)
        .join(merged.withColumnRenamed("label", "_root"), F.col("_node") == F.col("node"), "left")
        .withColumn("label", F.coalesce(F.get_json_object("_root", "$.label").cast("long"), "label"))
        .drop("_node", "node", "_root")
    )


def drop_small(labelled: DataFrame, key: list[str], min_pixels: int) -> DataFrame:
    """Keep pixels of components with at least ``min_pixels`` pixels."""
    sizes = labelled.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("_n"))
    keep = sizes.where(F.col("_n") >= min_pixels).select(*key, "label")
    return labelled.join(keep, [*key, "label"], "left_semi")


def extract_blobs(
    values: DataFrame, key: list[str], mask: str = "in_mask", value: str = "value", min_pixels: int = 3
) -> DataFrame:
    """Summaries of 4-connected components of a mask: size, peak, mean, weighted centre, half-open box."""
    true_px = values.where(F.col(mask)).select(*key, "row", "col", F.col(value).alias("_v"))
    labelled = pixel_components(true_px, key, carry=("_v",))
    weight = F.greatest(F.coalesce(F.col("_v"), F.lit(0.0)), F.lit(0.0))
    total = F.sum(weight)

    def centre(axis: str):
        return F.when(total > 0, F.sum(F.col(axis) * weight) / total).otherwise(F.avg(axis))

    return (
        labelled.groupBy(*key, "label")
        .agg(
            F.count(F.lit(1)).alias("n_pixels"),
            F.max("_v").alias("peak_value"),
            F.avg("_v").alias("mean_value"),
            centre("row").alias("row"),
            centre("col").alias("col"),
            F.struct(
                F.min("row").alias("r0"), (F.max("row") + 1).alias("r1"),
                F.min("col").alias("c0"), (F.max("col") + 1).alias("c1"),
            ).alias("bbox"),
        )
        .where(F.col("n_pixels") >= min_pixels)
    )


def source_component(
    mask: DataFrame, sources: DataFrame, key: list[str], eight: bool = True, pixel_size_m: float = 20.0
) -> tuple[DataFrame, DataFrame]:
    """Pixels of the component at (or nearest to) each scene's source, and the offset per scene.

    ``sources`` has the key columns, ``src_row``, ``src_col`` and optionally
    the raster size ``n_rows``, ``n_cols`` used to clamp the source pixel.
    """
    labelled = pixel_components(mask, key, eight)
    joined = labelled.join(sources, key)
    d2 = F.pow(F.col("row") - F.col("src_row"), 2) + F.pow(F.col("col") - F.col("src_col"), 2)

    def cell(axis: str, size: str):
        c = F.bround(axis)
        if size in sources.columns:
            c = F.least(c, F.col(size) - 1)
        return F.greatest(c, F.lit(0.0))

    at_source = (F.col("row") == cell("src_row", "n_rows")) & (F.col("col") == cell("src_col", "n_cols"))
    chosen = joined.groupBy(*key).agg(
        F.max(F.when(at_source, F.col("label"))).alias("_at"),
        F.min(F.struct(d2.alias("d2"), "row", "col", "label")).alias("_near"),
    ).select(
        *key,
        F.coalesce("_at", "_near.label").alias("label"),
        F.when(F.col("_at").isNull(), F.sqrt("_near.d2") * pixel_size_m).otherwise(0.0).alias("offset_m"),
    )
    kept = labelled.join(chosen.select(*key, "label"), [*key, "label"], "left_semi")
    return kept, chosen


def row_gaps(mask: DataFrame, key: list[str], max_pixels: int) -> DataFrame:
    """Background between mask pixels of a row: ``g0, g1`` (columns), at most ``max_pixels`` wide, and whether it is ``_open``.

    A row with mask pixels is one record with its gaps; rows without any have
    none. A gap is open where the row above or below has no mask pixels, ends
    short of it, or has a wider gap there, as those cannot be enclosed within ``max_pixels``.
    """
    cols = F.array_sort(F.collect_set("col"))
    rows = mask.groupBy(*key, "row").agg(cols.alias("_cols"))
    ends = F.arrays_zip(F.slice("_cols", 1, F.size("_cols") - 1).alias("a"), F.slice("_cols", 2, F.size("_cols")).alias("b"))
    gaps = F.transform(F.filter(ends, lambda e: e["b"] - e["a"] > 1), lambda e: F.struct((e["a"] + 1).alias("g0"), (e["b"] - 1).alias("g1")))
    rows = rows.select(*key, "row", F.array_min("_cols").alias("_low"), F.array_max("_cols").alias("_high"), gaps.alias("_gaps"))
    rows = rows.withColumn("_wide", F.filter("_gaps", lambda g: g["g1"] - g["g0"] >= max_pixels))
    order = Window.partitionBy(*key).orderBy("row")
    near = F.struct("row", "_low", "_high", "_wide")
    rows = rows.select("*", F.lag(near).over(order).alias("_up"), F.lead(near).over(order).alias("_down"))
    one = rows.select(*key, "row", F.explode(F.filter("_gaps", lambda g: g["g1"] - g["g0"] < max_pixels)).alias("_g"), "_up", "_down")

    def beside(side: str, step: int) -> Column:
        there = F.col(f"{side}.row") == F.col("row") + step
        covered = (F.col(f"{side}._low") <= F.col("_g.g0")) & (F.col(f"{side}._high") >= F.col("_g.g1"))
        wide = F.exists(f"{side}._wide", lambda w: (w["g0"] <= F.col("_g.g1")) & (w["g1"] >= F.col("_g.g0")))
        return F.coalesce(there & covered & ~wide, F.lit(False))

    return one.select(*key, "row", "_g.g0", "_g.g1", (~(beside("_up", -1) & beside("_down", 1))).alias("_open"))


def fill_holes(mask: DataFrame, key: list[str], max_pixels: int = 25) -> DataFrame:
    """Mask plus enclosed 4-connected background regions of at most ``max_pixels`` pixels.

    Only the gaps between mask pixels of a row are looked at, and of those only
    what may be filled becomes pixels, so the work follows the mask's border and not its bounding box.
    """
    gaps = row_gaps(mask, key, max_pixels)
    background = gaps.select(*key, "row", F.explode(F.sequence("g0", "g1")).alias("col"), "_open")
    labelled = pixel_components(background, key, carry=("_open",))
    holes = (
        labelled.groupBy(*key, "label")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_open").alias("_any"))
        .where(~F.col("_any") & (F.col("_n") <= max_pixels))
        .select(*key, "label")
    )
    added = labelled.join(holes, [*key, "label"], "left_semi").select(*key, "row", "col")
    return mask.select(*key, "row", "col").unionByName(added)
