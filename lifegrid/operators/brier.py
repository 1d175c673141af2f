"""Prediction error: inverse-probability-of-censoring Brier scores, skill and calibration, all from grids.

Predictions come as a table of (_row_id, t, surv), or as a Column of the linear predictor with a baseline.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UserInputError
from ..scratch import written
from .timegrid import beside, curves_at, grid, like, survival

TINY = 1e-12
#: Predictions that a task joins with their rows.
JOIN_ROWS = 500_000


def step(df: DataFrame, groups: list[str] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Times and values of the product-limit curve of an ungrouped cohort, for look-ups; one value per distinct event time."""
    rows = survival(grid(df, list(groups)), list(groups)).filter(F.col("d") > 0).select("time", "surv").orderBy("time").toPandas()
    return rows.time.to_numpy(float), rows.surv.to_numpy(float)


def at(curve: tuple[np.ndarray, np.ndarray], t: np.ndarray, before: bool = False) -> np.ndarray:
    """The curve's value at t (just before it, if asked); 1 before the first event."""
    times, values = curve
    k = np.searchsorted(times, t, side="left" if before else "right")
    return np.concatenate([[1.0], values])[k]


def evaluation_times(support: DataFrame, points: int = 100) -> list[float]:
    end = support.filter("event = 1").agg(F.max("time")).first()[0]
    return [] if end is None else list(np.linspace(0, end, points))


def brier_table(cohort: DataFrame, predictions: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """t, n, brier, null_brier: for each t of the predictions.

    A row with an event by t adds S^2 / G(time), one still at risk after t adds (1 - S)^2 / G(t), others 0, over all rows; G is
    the censoring curve of the support cohort, at least 1e-12. The null prediction is the support's own curve.
    G and the null curve are taken on time grids that hold the asked times too and joined by equal times; none reaches the driver.
    Predictions and rows meet in as many tasks as their count asks for, so that a task's memory doesn't grow with them.
    """
    predictions = predictions.select("_row_id", F.col("t").cast("double").alias("t"), "surv")
    asked = written(predictions.groupBy(F.col("t").alias("time")).count())
    parts = math.ceil((asked.agg(F.sum("count")).first()[0] or 0) / JOIN_ROWS)
    base, own = support_curves(cohort, asked.select("time"), support)
    rows = cohort.select("_row_id", F.col("time").cast("double").alias("time"), "event").join(beside(own), "time")
    if parts > 1:
        predictions, rows = predictions.repartition(parts, "_row_id"), rows.repartition(parts, "_row_id")
    return scores(predictions.join(rows, "_row_id").join(base, "t"))


def support_curves(cohort: DataFrame, asked: DataFrame, support: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """t, gt and s0 at the asked times, and time and gi at the cohort's times, of the support's curves along one grid."""
    own = cohort.select(F.col("time").cast("double").alias("time")).distinct()
    curves = curves_at(cohort if support is None else support, asked if support is None else asked.union(own))
    g = F.greatest("cens", F.lit(TINY))
    values = like(curves, curves.select("time", g.alias("gt"), F.col("surv").alias("s0")))
    base = asked.join(beside(values), "time").withColumnRenamed("time", "t")
    return beside(like(curves, base)), like(curves, curves.select("time", g.alias("gi")))


def scores(x: DataFrame) -> DataFrame:
    """t, n, brier and null_brier from rows of t, time, event, surv, gi, gt and s0."""
    dead, alive = (F.col("time") <= F.col("t")) & (F.col("event") == 1), F.col("time") > F.col("t")
    score = lambda s: F.when(dead, s * s / F.col("gi")).when(alive, (1 - s) ** 2 / F.col("gt")).otherwise(0.0)
    return x.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.avg(score(F.col("surv"))).alias("brier"), F.avg(score(F.col("s0"))).alias("null_brier"))


def brier_of_curves(rows: DataFrame, times: list[float], support: DataFrame | None = None) -> DataFrame:
    """``brier_table`` for predictions that stand with their rows: time, event and surv, an array with a value for each of the times.
    The rows are joined once, by time; a row a time exists only within a task."""
    spark = rows.sparkSession
    asked = spark.createDataFrame([(i, float(t)) for i, t in enumerate(times)], "k int, time double")
    base, own = support_curves(rows, asked.select("time").distinct(), support)
    base = base.join(asked.withColumnRenamed("time", "t"), "t")
    x = rows.select(F.col("time").cast("double").alias("time"), "event", "surv").join(beside(own), "time")
    x = x.select("time", "event", "gi", F.posexplode("surv").alias("k", "surv")).join(F.broadcast(base), "k")  # as many rows as times
    return scores(x)


def integrated(rows: list[dict]) -> dict:
    """Trapezoid means over t of the scores, and skill = 1 - ibs / null ibs."""
    rows = sorted(rows, key=lambda r: r["t"])
    t = np.array([r["t"] for r in rows])
    if not len(t):
        raise UserInputError("no evaluation times within the support")
    mean = lambda k: float(np.trapezoid([r[k] for r in rows], t) / (t[-1] - t[0])) if t[-1] > t[0] else float(rows[0][k])
    ibs, null = mean("brier"), mean("null_brier")
    return {"ibs": ibs, "null_ibs": null, "skill": 1 - ibs / null if null > 0 else None, "points": len(t), "mode": "integrated" if t[-1] > t[0] else "single_point"}


def within_support(times: list[float], support: DataFrame) -> list[float]:
    """The times up to the last event of the support; the last event time alone if none is."""
    end = support.filter("event = 1").agg(F.max("time")).first()[0]
    return [t for t in times if end is not None and t <= end]


def calibration(df: DataFrame, t: float, bins: int = 10) -> DataFrame:
    """bin, n, events, predicted, observed: right-closed quantile bins of the prediction surv, with each bin's
    product-limit value at t (1 in a bin without events by then)."""
    from .grouping import bin_label, quantiles

    edges = sorted(set(quantiles(df, "surv", [k / bins for k in range(bins + 1)])))
    inner = edges[1:-1]
    x = bin_label(df, "surv", "bin", inner, [f"{k:03d}" for k in range(len(inner) + 1)]).withColumn("bin", F.col("bin").cast("int"))
    s = survival(grid(x, ["bin"]), ["bin"]).filter((F.col("time") <= t) & (F.col("d") > 0))
    seen = s.groupBy("bin").agg(F.min_by("surv", F.struct(-F.col("time"))).alias("s"))
    means = x.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("event").cast("long").alias("events"), F.avg("surv").alias("predicted"))
    return means.join(seen, "bin", "left").select("bin", "n", "events", "predicted", F.coalesce("s", F.lit(1.0)).alias("observed"))
