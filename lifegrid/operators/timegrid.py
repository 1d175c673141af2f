"""The event-time grid: the one aggregation of raw rows that the estimators share.

Rows shrink to one per (group, distinct time) with d events and c rows. Risk sets, products and
sums are windows over that grid, partitioned by group and range of times, never over raw rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import written

#: Rows that a range of values is made for, and the most ranges of a column.
RANGE_ROWS = 50_000
MAX_RANGES = 1_000


def range_cuts(df: DataFrame, columns: list[str], rows: int | None = None) -> list[list[float]]:
    """Quantiles of each column that cut df, of about so many rows, into ranges of about RANGE_ROWS rows; they only spread work,
    no result depends on them."""
    rows = df.count() if rows is None else rows
    parts = min(MAX_RANGES, math.ceil(rows / RANGE_ROWS))
    if parts < 2:
        return [[] for _ in columns]
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    got = df.agg(*[F.percentile_approx(c, shares, F.lit(10_000)).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    return [sorted({float(x) for x in got[f"q{i}"] or []}) for i in range(len(columns))]


#: Cuts up to which a range is found by comparisons in the plan.
PLAN_CUTS = 16


def range_number(value: Column, cuts: list[float]) -> Column:
    """Twice the cuts below the value, one more at a cut itself: a value that many rows share is a range of its own. A
    balanced tree of comparisons; more cuts are searched in tasks, so that plans don't grow with them."""
    v = value.cast("double")
    if len(cuts) > PLAN_CUTS:
        at = np.array(cuts)

        @F.pandas_udf("int")
        def searched(x: pd.Series) -> pd.Series:
            v = x.to_numpy(float)  # a null is behind all cuts, as a NaN is
            return pd.Series((np.searchsorted(at, v) + np.searchsorted(at, v, "right")).astype(np.int32))

        return searched(v)

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(2 * low)
        middle = (low + high) // 2
        return F.when(v < cuts[middle], among(low, middle)).when(v == cuts[middle], 2 * middle + 1).otherwise(among(middle + 1, high))

    return among(0, len(cuts))


def grid(cohort: DataFrame, groups: list[str], time: str = "time", event: str = "event") -> DataFrame:
    """groups, time, d (events) and c (rows); the partial aggregation runs before the shuffle."""
    return cohort.groupBy(*groups, F.col(time).alias("time")).agg(F.sum(event).cast("long").alias("d"), F.count(F.lit(1)).alias("c"))


def by(groups: list[str]):
    return Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))


#: Ranges of times in each doubling.
OCTAVE_RANGES = 1_024


def time_range(t: Column) -> Column:
    """A number that never falls as t grows: ranges of equal width within each doubling, all times up to 0 in one. It needs no
    look at the data, so it is the same in every evaluation."""
    power = F.floor(F.log2(t))
    return F.when(t > 0, F.floor(OCTAVE_RANGES * (power + t / F.pow(F.lit(2.0), power)))).otherwise(F.lit(-(2**40)))


def running(g: DataFrame, groups: list[str], sums: dict[str, Column], least: dict[str, Column] | None = None, back: bool = False) -> DataFrame:
    """Adds running sums and minima along time, or from the last time back, this row included.

    A group's times may be any number, so they don't go through one window: ranges of times are summed first, and each range
    starts from the sums of those before it. Where it is known that no group has more than RANGE_ROWS times (see ``kept``), one window
    a group does.
    """
    least = least or {}
    way = F.desc if back else F.asc
    if is_small(g):
        upto = by(groups).orderBy(way("time")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return like(g, g.withColumns({**{k: F.sum(c).over(upto) for k, c in sums.items()}, **{k: F.min(c).over(upto) for k, c in least.items()}}))
    x = g.withColumn("_range", time_range(F.col("time").cast("double")))
    whole = x.groupBy(*groups, "_range").agg(*[F.sum(c).alias(k) for k, c in sums.items()], *[F.min(c).alias(k) for k, c in least.items()])
    window = Window.partitionBy(*groups) if groups else Window
    before = window.orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = whole.select(*[F.col(k).alias(f"_of_{k}") for k in (*groups, "_range")], *[F.sum(k).over(before).alias(f"_from_{k}") for k in sums], *[F.min(k).over(before).alias(f"_from_{k}") for k in least])
    upto = Window.partitionBy(*groups, "_range").orderBy(way("time")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("_range") == F.col("_of__range")
    for k in groups:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    x = x.join(starts, same).withColumns({
        **{k: F.coalesce(F.col(f"_from_{k}"), F.lit(0)) + F.sum(c).over(upto) for k, c in sums.items()},
        **{k: F.least(F.col(f"_from_{k}"), F.min(c).over(upto)) for k, c in least.items()},
    })
    return x.drop("_range", *[f"_of_{k}" for k in (*groups, "_range")], *[f"_from_{k}" for k in (*sums, *least)])


def kept(g: DataFrame, groups: list[str]) -> DataFrame:
    """The grid, a row per group and distinct time, as a written table, so that the cohort is read once however often running()
    reads its grid; it knows whether all groups are small."""
    out = written(g)
    out._rows = out._most_times = out.count()
    if out._rows > RANGE_ROWS and groups:
        out._most_times = out.groupBy(*groups).count().agg(F.max("count")).first()[0]
    return out


def is_small(g: DataFrame) -> bool:
    return getattr(g, "_most_times", RANGE_ROWS + 1) <= RANGE_ROWS


def like(g: DataFrame, new: DataFrame) -> DataFrame:
    """new, made of g by columns and filters alone, with what is known of the size of g's groups."""
    for known in ("_rows", "_most_times"):
        if hasattr(g, known):
            setattr(new, known, getattr(g, known))
    return new


def beside(g: DataFrame) -> DataFrame:
    """g for a join with rows by time: sent to all tasks where it is known to have at most RANGE_ROWS rows."""
    return F.broadcast(g) if getattr(g, "_rows", RANGE_ROWS + 1) <= RANGE_ROWS else g


def at_risk(g: DataFrame, groups: list[str]) -> DataFrame:
    """Adds n, the rows with time >= this time."""
    return running(g if is_small(g) else kept(g, groups), groups, {"n": F.col("c")}, back=True)


def survival(g: DataFrame, groups: list[str]) -> DataFrame:
    """Adds n, surv (after the time), surv_before, and gw, Greenwood's running sum (null once a risk set is exhausted).

    surv is the product of 1 - d / n, zero from the first exhausted risk set on.
    """
    s = at_risk(g, groups)
    n, d = F.col("n"), F.col("d")
    log, left = product_parts(d, n)
    term = F.coalesce(F.when(n > d, d / (n.cast("double") * (n - d))), F.lit(0.0))
    s = running(s, groups, {"_log": log, "_gw": term}, {"_left": left})
    gone, now = F.coalesce(F.col("_left") <= 0, F.lit(False)), F.coalesce(left <= 0, F.lit(False))
    out = s.withColumns({"surv": F.when(gone, 0.0).otherwise(F.exp("_log")), "surv_before": F.when(gone & ~now, 0.0).otherwise(F.exp(F.col("_log") - log)), "gw": F.when(~gone, F.col("_gw"))})
    return like(s, out.drop("_log", "_gw", "_left"))


def product_parts(d: Column, n: Column) -> tuple[Column, Column]:
    """log(1 - d / n) where something is left, and what is left at event times."""
    return F.when(d < n, F.log1p(-d / n)).otherwise(0.0), F.when(d > 0, n - d)


def curves_at(cohort: DataFrame, times: DataFrame) -> DataFrame:
    """time, surv and cens, the cohort's curves of events and of censoring, at its own times and at those of the table times, which needn't be its
    own. Both are taken along one grid."""
    slots = times.select(F.col("time").cast("double").alias("time"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("c"))
    own = grid(cohort, []).withColumn("time", F.col("time").cast("double"))
    g = at_risk(own.unionByName(slots).groupBy("time").agg(F.sum("d").alias("d"), F.sum("c").alias("c")), [])
    n = F.col("n")
    (log_s, left_s), (log_c, left_c) = product_parts(F.col("d"), n), product_parts(F.col("c") - F.col("d"), n)
    s = running(g, [], {"_s": log_s, "_c": log_c}, {"_ls": left_s, "_lc": left_c})
    value = lambda left, log: F.when(F.coalesce(F.col(left) <= 0, F.lit(False)), 0.0).otherwise(F.exp(log))
    return like(s, s.select("time", value("_ls", "_s").alias("surv"), value("_lc", "_c").alias("cens")))


def survival_at(cohort: DataFrame, times: DataFrame) -> DataFrame:
    """time and surv of ``curves_at``."""
    return curves_at(cohort, times).select("time", "surv")
