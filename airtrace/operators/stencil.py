"""Neighbourhood operators on sparse true-pixel tables.

Opening and closing work on words: the true pixels of 64 columns of a row are
the bits of one long, and neighbours meet by shifts of words and of copies to the
rows beside. The majority copies each true pixel to its neighbours and counts the
copies. Partial results combine map-side, and no operator needs the raster shape
unless its border rule does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SQUARE = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]
CROSS = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]


def _spread(mask: DataFrame, key: list[str], offsets) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in offsets])
    return mask.select(*key, "row", "col", F.explode(steps).alias("_step")).select(
        *key, (F.col("row") + F.col("_step.dr")).alias("row"), (F.col("col") + F.col("_step.dc")).alias("col")
    )


def _to_words(mask: DataFrame, key: list[str]) -> DataFrame:
    """``key..., row, _at, _bits``: bit b of word w is column 64 w + b."""
    bit = F.expr("shiftleft(1L, cast(pmod(col, 64) as int))")
    return mask.groupBy(*key, "row", F.floor(F.col("col") / 64).alias("_at")).agg(F.bit_or(bit).alias("_bits"))


def _to_pixels(words: DataFrame, key: list[str], like: DataFrame) -> DataFrame:
    """The true pixels of words, rows and columns of the types they have in ``like``."""
    kinds = dict(like.dtypes)
    set_bits = F.expr("filter(sequence(0, 63), b -> getbit(_bits, b) = 1)")
    return words.where("_bits <> 0").select(*key, F.col("row").cast(kinds["row"]).alias("row"), "_at", F.explode(set_bits).alias("_b")).select(
        *key, "row", (F.col("_at") * 64 + F.col("_b")).cast(kinds["col"]).alias("col")
    )


def _near_words(words: DataFrame, key: list[str]) -> DataFrame:
    """Each word at its own place, in the rows beside, and where its end columns have neighbours in the next word.

    ``_dr`` is the word's row less the place's. ``_mid`` is the word itself, ``_ends``
    its end columns as bits at the near end of the place's word: bit 0 for the word before, bit 63 for the next.
    """
    def copy(step, mid, ends):
        return f"named_struct('step', {step}, 'mid', {mid}, 'ends', {ends})"

    low = f"if(getbit(_bits, 0) = 1, {copy(-1, '0L', 'shiftleft(1L, 63)')}, null)"
    high = f"if(getbit(_bits, 63) = 1, {copy(1, '0L', '1L')}, null)"
    wide = words.select(*key, "row", "_at", F.expr(f"explode(array_compact(array({copy(0, '_bits', '0L')}, {low}, {high})))").alias("_w"))
    return wide.select(*key, "row", (F.col("_at") + F.col("_w.step")).alias("_at"), F.col("_w.mid").alias("_mid"), F.col("_w.ends").alias("_ends"), F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)])).alias("_dr")).select(
        *key, (F.col("row") - F.col("_dr")).alias("row"), "_at", "_dr", "_mid", "_ends"
    )


def _step(words: DataFrame, key: list[str], eight: bool, grow: bool) -> DataFrame:
    """One dilation (``grow``) or erosion of words."""
    parts = [F.bit_or(F.when(F.col("_dr") == d, F.col(c))).alias(f"{c}{n}") for d, n in ((-1, "a"), (0, "b"), (1, "c")) for c in ("_mid", "_ends")]
    met = _near_words(words, key).groupBy(*key, "row", "_at").agg(*parts).na.fill(0, [f"{c}{n}" for c in ("_mid", "_ends") for n in "abc"])
    sign = "|" if grow else "&"

    def across(n):
        left, right = f"(shiftleft(_mid{n}, 1) | (_ends{n} & 1L))", f"(shiftrightunsigned(_mid{n}, 1) | (_ends{n} & shiftleft(1L, 63)))"
        return f"({left} {sign} _mid{n} {sign} {right})"

    beside = [across(n) if eight else f"_mid{n}" for n in "ac"]
    return met.select(*key, "row", "_at", F.expr(f" {sign} ".join([across("b"), *beside])).alias("_bits")).where("_bits <> 0")


def _steps(mask: DataFrame, key: list[str], eight: bool, grows: list[bool]) -> DataFrame:
    words = _to_words(mask, key)
    for grow in grows:
        words = _step(words, key, eight, grow)
    return _to_pixels(words, key, mask)


def dilate(mask: DataFrame, key: list[str], eight: bool = True) -> DataFrame:
    return _steps(mask, key, eight, [True])


def erode(mask: DataFrame, key: list[str], eight: bool = True) -> DataFrame:
    """Outside the stored pixels everything counts as false."""
    return _steps(mask, key, eight, [False])


def binary_open(mask: DataFrame, key: list[str], radius: int = 1, eight: bool = True) -> DataFrame:
    return _steps(mask, key, eight, [False] * radius + [True] * radius)


def binary_close(mask: DataFrame, key: list[str], radius: int = 1, eight: bool = True) -> DataFrame:
    """Closing on an unbounded plane: it only ever adds pixels."""
    return _steps(mask, key, eight, [True] * radius + [False] * radius)


def majority_3x3(mask: DataFrame, shape: DataFrame, key: list[str]) -> DataFrame:
    """Pixels whose 3x3 neighbourhood is mostly true, borders reflected.

    ``shape`` gives ``n_rows`` and ``n_cols`` per key. Reflection at distance
    one repeats the edge, so an edge pixel also votes for its outside twin.
    """
    votes = _spread(mask, key, SQUARE)
    edge = mask.join(shape, key)
    twins = (
        F.array_compact(F.array(
            F.when(F.col("row") == 0, F.lit(-1)), F.col("row"),
            F.when(F.col("row") == F.col("n_rows") - 1, F.col("n_rows")),
        )).cast("array<int>"),
        F.array_compact(F.array(
            F.when(F.col("col") == 0, F.lit(-1)), F.col("col"),
            F.when(F.col("col") == F.col("n_cols") - 1, F.col("n_cols")),
        )).cast("array<int>"),
    )
    outside = (
        edge.withColumn("_r", F.explode(twins[0])).withColumn("_c", F.explode(twins[1]))
        .where((F.col("_r") != F.col("row")) | (F.col("_c") != F.col("col")))
        .select(*key, F.col("_r").alias("row"), F.col("_c").alias("col"))
    )
    votes = votes.unionByName(_spread(outside, key, SQUARE))
    return (
        votes.groupBy(*key, "row", "col").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 5)
        .join(shape, key)
        .where(
            F.col("row").between(0, F.col("n_rows") - 1) & F.col("col").between(0, F.col("n_cols") - 1)
        )
        .select(*key, "row", "col")
    )


def robust_sigma(
    df: DataFrame, key: list[str], value: str, floor: float | None = 2.0, name: str = "sigma"
) -> DataFrame:
    """1.4826 times the MAD per key, clamped below at ``floor``; all-missing gives the floor."""
    med = df.groupBy(*key).agg(F.percentile(value, F.lit(0.5)).alias("_med"))
    dev = df.join(med, key).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    sigma = F.percentile("_dev", F.lit(0.5)) * 1.4826
    low = F.lit(0.0 if floor is None else float(floor))
    return dev.groupBy(*key).agg(F.greatest(F.coalesce(sigma, low), low).alias(name))


def plume_mask(df: DataFrame, shape: DataFrame, key: list[str], value: str = "value", k: float = 3.0) -> DataFrame:
    """Despeckled pixels at or above ``k`` noise levels above zero."""
    sigma = robust_sigma(df, key, value)
    raw = df.join(sigma, key).where(F.col(value) >= k * F.col("sigma")).select(*key, "row", "col")
    seen = df.where(F.col(value).isNotNull()).select(*key, "row", "col")
    return majority_3x3(raw, shape, key).join(seen, [*key, "row", "col"], "left_semi")


def tile_windows(
    pixels: DataFrame, shape: DataFrame, key: list[str], window: int = 32, stride: int = 16
) -> DataFrame:
    """Each pixel once per full window covering it, as ``r0, c0``; partial edge windows are dropped."""
    def origins(axis: str, size: str):
        first = F.greatest(F.ceil((F.col(axis) - window + 1) / stride), F.lit(0))
        last = F.least(F.floor(F.col(axis) / stride), F.floor((F.col(size) - window) / stride))
        starts = F.sequence((first * stride).cast("int"), (last * stride).cast("int"), F.lit(stride))
        return F.when(last >= first, starts)

    return (
        pixels.join(shape, key)
        .withColumn("r0", F.explode(origins("row", "n_rows")))
        .withColumn("c0", F.explode(origins("col", "n_cols")))
        .drop("n_rows", "n_cols")
    )


def scene_normalize(df: DataFrame, key: list[str], value: str = "value", name: str = "norm") -> DataFrame:
    """Contrast stretch from one deviation below the mean over 100 units; thin scenes and gaps give 0."""
    stats = df.groupBy(*key).agg(
        F.count(value).alias("_n"), (F.avg(value) - F.stddev_pop(value)).alias("_lo")
    )
    stretched = F.least(F.greatest(F.col(value) - F.col("_lo"), F.lit(0.0)), F.lit(100.0)) / 100.0
    use = (F.col("_n") >= 10) & F.col(value).isNotNull()
    return df.join(stats, key).withColumn(name, F.when(use, stretched).otherwise(0.0)).drop("_n", "_lo")
