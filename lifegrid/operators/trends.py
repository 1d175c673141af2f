"""LOWESS trends of any number of points, and the residual panels of a Cox fit.

A local linear fit at one point uses a third of all rows or more, so halos of neighbours don't help. A panel is drawn at
a few hundred places, though: the rows evenly spaced along x, or all of them where they are fewer. The radius of each place, the distance of
its k-th nearest row, is found by narrowing down the first row of its window, 64 steps at a time, over numbered rows; one pass then adds up
the five weighted sums of every place's fit, in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .positions import numbered

#: Places of a panel.
PLACES = 200
#: Steps of a window's first row that are looked up in one round.
STEPS = 64


def fraction(n: int) -> float:
    """The share of rows in a window. 0.35, 0.8 and 6 rows."""
    return min(0.8, max(0.35, 6 / max(n, 1)))


def lowess(x: np.ndarray, y: np.ndarray, frac: float | None = None) -> np.ndarray:
    """Local linear fits with tricube weights at each sorted x, for rows in one place."""
    n = len(x)
    k = max(2, int((fraction(n) if frac is None else frac) * n + 1e-10))
    out, left = np.empty(n), 0
    for i in range(n):
        while left + k < n and x[left + k] - x[i] < x[i] - x[left]:
            left += 1
        xs, ys = x[left : left + k], y[left : left + k]
        width = max(abs(x[i] - xs[0]), abs(xs[-1] - x[i]))
        if width <= 0:
            xs, ys = x[x == x[i]], y[x == x[i]]
        w = (1 - np.minimum(np.abs(xs - x[i]) / width, 1) ** 3) ** 3 if width > 0 else np.ones(len(xs))
        out[i] = fitted(*(np.sum(v) for v in (w, w * (xs - x[i]), w * (xs - x[i]) ** 2, w * ys, w * (xs - x[i]) * ys)))
    return out


def fitted(w, wx, wxx, wy, wxy):
    """The local line's value at its own place, from weighted sums of x less the place."""
    m, ym = wx / w, wy / w
    v = wxx - wx * m
    slope = np.where(v > 1e-12, (wxy - wx * ym) / np.where(v > 1e-12, v, 1.0), 0.0)
    return ym - slope * m


def trend(df: DataFrame, x: Column, y: Column, places: int = PLACES, frac: float | None = None) -> list[dict]:
    """value and trend at evenly spaced rows along x, or at all rows, for rows of finite x and y; empty under four rows or for a constant x.

    Equal to ``lowess`` at these rows. Where more than a window of rows share a place's x, the trend is their mean.
    """
    rows = df.select(x.cast("double").alias("x"), y.cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y) and abs(x) < double('infinity') and abs(y) < double('infinity')")
    rows = numbered(rows, [], [F.col("x"), F.col("y")])
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    n = ends.n
    if n < 4 or ends.lo == ends.hi:
        return []
    k = max(2, int((fraction(n) if frac is None else frac) * n + 1e-10))

    def at(positions: np.ndarray) -> dict[int, float]:
        wanted = df.sparkSession.createDataFrame([(int(p),) for p in np.unique(positions)], "position long")
        # at most 2 * places * (STEPS + 1) positions
        return {r.position: r.x for r in rows.join(F.broadcast(wanted), "position").select("position", "x").collect()}

    own = np.unique(np.round(np.linspace(0, n - 1, min(n, places))).astype(np.int64))
    found = at(own)
    here = np.array([found[p] for p in own])
    # the window's first row: the least one from which the k-th row behind is no nearer than itself
    lo, hi = np.zeros(len(own), np.int64), np.full(len(own), n - k)
    while (lo < hi).any():
        steps = np.unique(np.concatenate([np.linspace(a, b, STEPS + 1).astype(np.int64) for a, b in zip(lo, hi, strict=True)]))
        values = at(np.concatenate([steps, steps[steps + k < n] + k]))
        holds = np.array([values.get(s + k, np.inf) + values[s] for s in steps])
        for i, v in enumerate(here):
            mine = (steps >= lo[i]) & (steps <= hi[i])
            s, ok = steps[mine], holds[mine] >= 2 * v
            first = int(np.argmax(ok)) if ok.any() else len(s) - 1
            hi[i] = s[first]
            lo[i] = min(hi[i], s[first - 1] + 1) if first else s[0]
    values = at(np.concatenate([lo, lo + k - 1]))
    radius = np.array([max(abs(v - values[a]), abs(values[a + k - 1] - v)) for v, a in zip(here, lo, strict=True)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((5, len(here)))
        for b in batches:
            xs, ys = b.column("x").to_numpy(), b.column("y").to_numpy()
            for i in range(0, len(xs), 2_000):
                d = xs[i : i + 2_000, None] - here
                w = np.where(radius > 0, (1 - np.minimum(np.abs(d) / np.where(radius > 0, radius, 1.0), 1) ** 3) ** 3, d == 0)
                wx, v = w * d, ys[i : i + 2_000]
                total += np.stack([w.sum(axis=0), wx.sum(axis=0), (wx * d).sum(axis=0), v @ w, v @ wx])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    total = np.sum([np.frombuffer(bytes(r.sums)) for r in rows.select("x", "y").mapInArrow(sums, "sums binary").collect()], axis=0).reshape(5, -1)
    return [{"value": float(a), "trend": float(b)} for a, b in zip(here, fitted(*total), strict=True)]


def schoenfeld_panels(df: DataFrame, fit) -> list[dict]:
    """For each term of at least four events, the trend of its scaled residual over the logarithm of time."""
    from .cox import schoenfeld

    residuals = schoenfeld(df, fit)
    panels = [{"term": c, "trend": trend(residuals, F.log("time"), F.col(f"r{i}"))} for i, c in enumerate(fit.names)]
    return [p for p in panels if p["trend"]]


def martingale_panels(df: DataFrame, fit, covariates: list[str]) -> list[dict]:
    """For each numeric covariate that varies, the trend of the martingale residual along it."""
    from .cox import martingale_residuals

    residuals = martingale_residuals(df, fit)
    panels = [{"term": c, "trend": trend(residuals, F.col(f"`{c}`"), F.col("residual"))} for c in covariates]
    return [p for p in panels if p["trend"]]
