"""Fits by sufficient statistics, and the cascade, against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airtrace.operators import features, fitting


def samples(spark, n=400, width=5, groups=3):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=(n, width - 1)), np.ones(n)])
    y = (x @ rng.normal(size=width) + rng.normal(size=n) > 0).astype(float)
    w, g = rng.uniform(0.5, 2, n), rng.integers(0, groups, n)
    rows = [(int(k), [float(v) for v in a], float(b), float(c)) for k, a, b, c in zip(g, x, y, w)]
    return x, y, w, g, spark.createDataFrame(rows, "g int, x array<double>, y double, w double").repartition(7)


def test_sums_and_newton_steps_equal_numpy(spark):
    x, y, w, g, rows = samples(spark)
    found = fitting.newton_logistic(rows, 5, steps=12)
    for k in range(3):
        a, b, c = x[g == k], y[g == k], w[g == k]
        p = 1 / (1 + np.exp(-(a @ found[k])))
        # The optimum: the gradient of the shrunk mean loss is zero.
        assert np.abs(a.T @ (c * (b - p)) / c.sum() - 1e-3 * found[k] * [1, 1, 1, 1, 0]).max() < 1e-9
    sums = fitting.margin_sums(rows)
    for without in (None, 1):
        keep = np.ones(len(g), bool) if without is None else g != without
        a, t, c = x[keep], 2 * y[keep] - 1, w[keep]
        want = np.linalg.lstsq(np.vstack([a * np.sqrt(c)[:, None], np.sqrt(0.1) * np.eye(5)[:4]]), np.append(t * np.sqrt(c), np.zeros(4)), rcond=None)[0]
        np.testing.assert_allclose(fitting.margin_fit(sums, 10.0, without), want, atol=1e-9)


def test_probability_expression_equals_numpy_and_tells_classes_apart(spark):
    rng = np.random.default_rng(5)
    n = 300
    y = rng.integers(0, 2, n)
    values = np.column_stack([rng.normal(size=n), rng.normal(size=n) + 3 * y, np.full(n, 7.0)])
    table = spark.createDataFrame([(i, int(k), *map(float, v)) for i, (k, v) in enumerate(zip(y, values))], "id long, y int, a double, b double, c double")
    model, metrics = features.train_stage2(table, "id", ["a", "b", "c"])
    got = table.select("id", model.prob().alias("p")).toPandas().sort_values("id")["p"].to_numpy()
    z = (values - model.mean) / model.scale
    x = np.column_stack([np.cos(z @ model.frequency.T + model.phase) * np.sqrt(2 / 32), np.ones(n)])
    np.testing.assert_allclose(got, 1 / (1 + np.exp(-(x @ model.beta * model.slope + model.intercept))), atol=1e-9)
    m = metrics.collect()
    assert len(m) == 3 and sum(r["chosen"] for r in m) == 1 and all(r["precision"] > 0.8 and r["recall"] > 0.8 for r in m)
    best = max(m, key=lambda r: r["cv_f1"])
    assert best["chosen"] and np.mean((got >= 0.5) == y) > 0.9


def test_stage1_on_separable_scenes(spark):
    rng = random.Random(1)
    rows = [(i, i % 2, [rng.random() * 0.3 + (0.5 if i % 2 and j < 3 else 0.0) for j in range(8)]) for i in range(240)]
    found, scores = features.train_stage1(spark.createDataFrame(rows, "id long, y int, pixels array<double>"), 8)
    assert set(found) == {0, 1, 2} and all(r["precision"] > 0.9 and r["recall"] > 0.9 for r in scores.collect())


def test_a_stage_sees_only_what_the_stage_before_keeps(spark):
    px = spark.createDataFrame(
        [(s, r, c, 1800.0 + 10 * ((r * 7 + c * 3) % 11) + (150.0 if s == 1 and 2 <= r < 5 and 2 <= c < 5 else 0.0)) for s in range(3) for r in range(8) for c in range(8)],
        "s int, row int, col int, value double",
    )
    shape = spark.createDataFrame([(s, 8, 8) for s in range(3)], "s int, n_rows int, n_cols int")
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(len(x))
        return x

    second = F.pandas_udf(lambda x: count(x), "double").asNondeterministic()("norm_max")
    beta = np.append(np.zeros(64), -7.5)  # passes where nearly all of a block is bright
    beta[:64].reshape(8, 8)[2:5, 2:5] = 1.0
    run = lambda a, b: features.run_detector(px, shape, ["s"], {"one": a, "two": b}, window=8, stride=8)
    got = run(features.logistic_stage(beta, 0.5), features.Stage(second, 0.9)).collect()
    assert [r["s"] for r in got] == [1] and seen.value == 1
    assert got[0]["score"] == min(got[0]["one_prob"], got[0]["two_prob"])
    assert run(features.logistic_stage(beta, 0.5), features.Stage(F.lit(0.8), 0.9)).count() == 0
    with pytest.raises(ValueError):
        features.run_detector(px, shape, ["s"], {})
    with pytest.raises(ValueError):
        features.run_detector(px, shape, ["s"], {"one": F.lit(1.0)}, context=True)
