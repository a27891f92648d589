"""Linear classifiers fitted by sufficient statistics.

A step sums weighted cross products once over all rows, as arrays inside the
tasks and by position after them, and solves a system of the size of the model
on the driver: what travels there is a fixed number of values per group
(``width * (width + 1) + 1``), whatever the number of rows. Fits of several
groups (seeds, folds) share one pass. The last input of every row is the
constant one; it is not shrunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Sums = dict[int, tuple[np.ndarray, np.ndarray, float]]
Weigh = Callable[[int, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def cross_products(rows: DataFrame, weigh: Weigh) -> Sums:
    """Per group ``g``: the sums of ``a * x * x'``, ``b * x`` and ``w``.

    ``rows``: ``g`` (int), ``x`` (array of doubles of one width), ``y`` and ``w``
    (doubles). ``weigh(g, x, y, w)`` gives ``a`` and ``b`` of a group's rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1)
            g, y, w = (batch[c].to_numpy() for c in ("g", "y", "w"))
            groups = np.unique(g)
            sums = []
            for k in groups.tolist():
                own, at = x[g == k], g == k
                a, b = weigh(k, own, y[at], w[at])
                sums.append(np.concatenate([((own * a[:, None]).T @ own).ravel(), own.T @ b, [w[at].sum()]]).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array(sums, pa.list_(pa.float64()))], names=["g", "sums"])

    parts = rows.select(F.col("g").cast("int").alias("g"), "x", F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"))
    totals = (
        parts.mapInArrow(run, "g int, sums array<double>").select("g", F.posexplode("sums").alias("at", "v"))
        .groupBy("g", "at").agg(F.sum("v").alias("v")).toPandas().sort_values(["g", "at"])
    )
    out: Sums = {}
    for k, part in totals.groupby("g"):
        v = part["v"].to_numpy()
        d = int((np.sqrt(4 * len(v) - 3) - 1) / 2)
        out[int(k)] = (v[: d * d].reshape(d, d), v[d * d : -1], float(v[-1]))
    return out


def shrunk(width: int, ridge: float) -> np.ndarray:
    return np.diag(np.append(np.full(width - 1, ridge), 0.0))


def newton_logistic(rows: DataFrame, width: int, steps: int = 6, ridge: float = 1e-3) -> dict[int, np.ndarray]:
    """Coefficients of a weighted logistic model per group: a fixed number of Newton steps from zero on the mean loss."""
    found: dict[int, np.ndarray] = {}
    for _ in range(steps):

        def weigh(g, x, y, w):
            p = 1 / (1 + np.exp(-(x @ found.get(g, np.zeros(width)))))
            return w * p * (1 - p), w * (y - p)

        penalty = shrunk(width, ridge)
        sums = cross_products(rows, weigh)
        found = {g: at + np.linalg.solve(h / n + penalty, v / n - penalty @ at) for g, (h, v, n) in sums.items() for at in [found.get(g, np.zeros(width))]}
    return found


def margin_sums(rows: DataFrame) -> Sums:
    """Statistics of the squared-margin classifier: targets -1 and 1."""
    return cross_products(rows, lambda g, x, y, w: (w, w * (2 * y - 1)))


def margin_fit(sums: Sums, c: float, without: int | None = None) -> np.ndarray:
    """Coefficients at cost ``c`` from the statistics of all groups but one: no further pass over the rows."""
    used = [s for g, s in sums.items() if g != without]
    h, v = sum(s[0] for s in used), sum(s[1] for s in used)
    return np.linalg.solve(h + shrunk(len(v), 1.0 / c), v)
