"""LOWESS trends over partitions against the version for one place, and the panels of a Cox fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lifegrid.operators import cox, encode, trends


def table(spark, x, y):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double").repartition(3)


@pytest.mark.parametrize("kind", ["spread", "ties", "skewed"])
def test_trend_equals_lowess(spark, kind, monkeypatch):
    monkeypatch.setattr(trends, "STEPS", 5)
    rng = np.random.default_rng(4)
    n = 150
    x = {"spread": rng.normal(size=n), "ties": rng.integers(0, 40, n).astype(float), "skewed": rng.exponential(size=n) ** 3}[kind]
    y = np.sin(x) + rng.normal(size=n)
    order = np.lexsort((y, x))
    want = trends.lowess(x[order], y[order])
    got = trends.trend(table(spark, x, y), F.col("x"), F.col("y"))
    assert [g["value"] for g in got] == x[order].tolist()
    np.testing.assert_allclose([g["trend"] for g in got], want, rtol=1e-8, atol=1e-9)
    some = trends.trend(table(spark, x, y), F.col("x"), F.col("y"), places=12)
    own = np.round(np.linspace(0, n - 1, 12)).astype(int)
    np.testing.assert_allclose([g["trend"] for g in some], want[own], rtol=1e-8, atol=1e-9)


def test_trend_of_few_or_constant_rows(spark):
    assert trends.trend(table(spark, [1, 2, 3], [1, 1, 1]), F.col("x"), F.col("y")) == []
    assert trends.trend(table(spark, [2] * 9, range(9)), F.col("x"), F.col("y")) == []
    hot = trends.trend(table(spark, [1.0] * 60 + [2.0] * 3, list(range(60)) + [5, 6, 7]), F.col("x"), F.col("y"))
    assert hot[0]["trend"] == pytest.approx(29.5)
    odd = spark.createDataFrame([(1.0, None), (None, 1.0), (float("inf"), 1.0), (float("nan"), 2.0), *[(float(i), float(2 * i)) for i in range(9)]], "x double, y double")
    assert [r["trend"] for r in trends.trend(odd, F.col("x"), F.col("y"))] == pytest.approx([2 * i for i in range(9)])


def test_cox_panels_and_condition_number(spark):
    rng = np.random.default_rng(6)
    n = 120
    x = rng.normal(size=n)
    t, e = rng.exponential(np.exp(-0.5 * x)) + 0.01, rng.integers(0, 2, n)
    df = spark.createDataFrame([(i, float(a), int(b), float(c), float(c + 0.01 * rng.normal()), ["u", "v"][i % 2]) for i, (a, b, c) in enumerate(zip(t, e, x, strict=True))], "_row_id long, time double, event int, x double, near double, kind string")
    out = cox.analyse(df, ["x", "kind"])
    assert [p["term"] for p in out["martingale_panels"]] == ["x"] and {p["term"] for p in out["ph_panels"]} == {"x", "kind[v]"}
    coded, names = cox.design(df, ["x", "kind"])
    res = cox.martingale_residuals(coded, cox.fit(coded, names)).toPandas().sort_values("x")
    np.testing.assert_allclose([p["trend"] for p in out["martingale_panels"][0]["trend"]], trends.lowess(res.x.to_numpy(), res.residual.to_numpy()), rtol=1e-7, atol=1e-9)
    assert len(out["ph_panels"][0]["trend"]) == e.sum() and out["stability"]["condition_number"] < 2
    assert encode.condition_number(df, ["x", "near"]) == pytest.approx(np.linalg.cond(np.corrcoef(df.toPandas()[["x", "near"]].T)) ** 0.5, rel=1e-6)
    assert encode.condition_number(df.withColumn("one", F.lit(1.0)), ["x", "one"]) == float("inf")
